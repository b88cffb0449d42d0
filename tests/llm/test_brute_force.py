"""Operators that SQL cannot express, against plain Python."""

import hashlib
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from test_text_operators import labelled, table, words

from candela.llm import imatch, linededup, quality, simhash, warc


def test_scores_of_quality_are_those_of_the_formula(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, carry=["doc_id", "source", "lang"])
    got = {r["row"]["doc_id"]: r for r in quality.score(docs, model).collect()}
    x = {r["__row"]["doc_id"]: r["__x"] for r in model.rows.collect()}
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = docs.collect()
    z = {i: max(-quality.CLIP, min(quality.CLIP, model.bias + sum(a * b for a, b in zip(v, model.weights)))) for i, v in x.items()}
    good = {r["doc_id"]: told.get(r["doc_id"], 1 / (1 + math.exp(-z[r["doc_id"]]))) for r in rows}
    assert abs(model.base - sum(good.values()) / len(good)) < 1e-9
    sites = {}
    for r in rows:
        sites.setdefault((r["source"], r["lang"]), []).append(good[r["doc_id"]])
    rate = {r["__site"]: r for r in model.sites.collect()}
    assert len(rate) == len(sites) and sum(r["__n"] for r in rate.values()) == len(rows)
    for r in rows:
        out = got[r["doc_id"]]
        p = out["path_score"]
        odds = z[r["doc_id"]] + math.log(p / (1 - p)) - math.log(model.base / (1 - model.base))
        assert abs(out["score"] - 1 / (1 + math.exp(-odds))) < 1e-9 and out["keep"] == (out["score"] >= 0.5)
        raw = sites[(r["source"], r["lang"])]
        low, high = sorted((out["host_score"], sum(raw) / len(raw)))
        assert low - 1e-9 <= p <= high + 1e-9  # a path lies between its own rate and its host's


def test_the_described_corpus_scores_as_its_texts_do(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, carry=docs.columns)
    a, b = ({r["row"]: (r["score"], r["keep"]) for r in x.collect()} for x in (quality.score(docs, model), quality.score_corpus(model)))
    assert a == b


def xx(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def as_long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def brute_prints(texts):
    split = lambda t: sorted(set(w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split(" ") if w))
    bags = [split(t) for t in texts]
    df = {}
    for b in bags:
        for w in b:
            df[w] = df.get(w, 0) + 1
    low, high = max(imatch.LEAST_DOCS, math.ceil(imatch.LEAST_SHARE * len(texts))), max(imatch.LEAST_DOCS, imatch.MOST_SHARE * len(texts))
    out = []
    for b in bags:
        held = [w for w in b if low <= df[w] <= high]
        hs = [xx(w.encode()) for w in (held if len(held) >= imatch.FEW else b)]
        parts = []
        for k, m in enumerate(imatch.LEVELS):
            place = [as_long(xx((imatch.SEED + k).to_bytes(4, "little"), xx(h.to_bytes(8, "little")))) % m for h in hs]
            for s in range(min(imatch.PARTS, m)):
                seed = 42
                own = [h for h, p in zip(hs, place) if p == s]
                for h in own:
                    seed = xx(h.to_bytes(8, "little"), seed)
                parts.append(f"{seed:016x}" if own else "-")
        out.append(f"{len(hs)}:{'.'.join(parts)}")
    return out


def test_imatch_prints_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_BYTES", 2_000)
    r = random.Random(4)
    texts = [words(r, r.randint(0, 60)) for _ in range(120)]
    texts[7], texts[8] = texts[9], ""
    ids = r.sample(range(1000), 120)
    rows = {x["doc_id"]: x for x in imatch.edited(table(spark, list(zip(ids, texts))).repartition(5)).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    prints = dict(zip(ids, brute_prints(texts)))
    for k, (i, t) in enumerate(order):
        j, after = order[(k + 1) % len(order)]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        assert rows[i]["fingerprint"] == prints[i] and 0 <= rows[i]["near_edited"] <= 1
        if prints[i] == prints[j]:
            assert rows[i]["near_next"] == 1


def test_imatch_rows_without_ids_are_cut_and_kept(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_BYTES", 500)
    r = random.Random(8)
    docs = [(None, words(r, 30)) for _ in range(40)] + [(i, words(r, 30)) for i in range(40)] + [(5, "same"), (5, "same")]
    out = imatch.edited(table(spark, docs)).collect()
    assert len(out) == len(docs) and sum(x["doc_id"] is None for x in out) == 40


def test_the_place_among_many_bounds(spark):
    bounds = sorted(random.Random(2).sample(range(-5000, 5000), 777))
    rows = spark.range(-5100, 5100, 7)
    got = rows.select("id", imatch._place(F.col("id"), bounds).alias("n")).collect()
    assert all(x["n"] == sum(b < x["id"] for b in bounds) for x in got)


def brute_pairs(fps, bits):
    return {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits}


def test_close_pairs_of_small_and_large_groups():
    r = random.Random(6)
    refs = simhash.pivots()
    for n, free in ((40, 64), (700, 12), (1500, 22)):
        places = r.sample(range(64), free)
        fps = sorted({sum(1 << k for k in places if r.random() < 0.5) for _ in range(n)})
        for bits in (0, 2, 3):
            got = {(min(int(x), int(y)), max(int(x), int(y))) for a, b in simhash.close_pairs(np.array(fps, np.uint64), refs, bits) for x, y in zip(a, b)}
            assert got == brute_pairs(fps, bits)


def test_a_column_named_removed_stays(spark):
    passage = "\n".join(words(random.Random(i), 12) for i in range(3))
    docs = spark.createDataFrame([(1, passage, "a"), (2, passage, "b"), (2, passage, "b"), (3, "alone", None)], "doc_id long, text string, __removed string")
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "__removed", "__removed_"]
    got = sorted((r[0], r[1], r[2], r[3]) for r in out.collect() if r[0] != 3)
    assert got == [(1, passage, "a", 0), (2, "", "b", 3), (2, "", "b", 3)]


def test_revisits_against_hashes(spark):
    r = random.Random(1)
    payloads = [words(r, 40) for _ in range(12)] + ["short", ""]
    rows = [(i, f"u{i}", r.choice(payloads)) for i in range(300)]
    first = {}
    for i, _, p in rows:
        first.setdefault(p, i)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {x["page_id"]: x for x in warc.read_archives(warc.write_archives(pages, archive_bytes=5_000), payloads=False, split_bytes=1_000).collect()}
    assert len(got) == 300
    for i, _, p in rows:
        again = len(p) >= 100 and first[p] != i
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", first[p]) if again else ("response", None))
        assert got[i]["payload_digest"] == hashlib.sha256(p.encode()).hexdigest() and got[i]["payload_bytes"] == len(p)


def test_a_damaged_record_fails_the_read():
    parts = [warc.member(i, "u", b"%d" % i * 400, hashlib.sha256(b"%d" % i * 400).hexdigest(), None) for i in range(12)]
    bad = list(parts)
    bad[5] = bad[5][:60] + bytes([bad[5][60] ^ 0xFF]) + bad[5][61:]

    def read(blob, step):
        class Memory:
            def seek(self, at):
                self.at = at

            def read(self, n):
                return blob[self.at : self.at + n]

        return sum(len(list(warc._Range(Memory(), len(blob), a, min(a + step, len(blob)), True).records())) for a in range(0, len(blob), step))

    for step in (37, 150, 400, 10_000):
        assert read(b"".join(parts), step) == 12
        for blob in (b"".join(bad), b"".join(parts)[:-30]):
            try:
                read(blob, step)
            except ValueError:
                continue
            raise AssertionError("a damaged archive was read")
