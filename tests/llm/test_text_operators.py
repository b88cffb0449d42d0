"""Operators on documents against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candela.llm import bpe, imatch, linededup, packing, quality, simhash, toxicity
from candela.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, __id string, score double, h string"


def table(spark, texts, **other):
    rows = [(i, t, other.get("lang"), other.get("source", f"s{(i or 0) % 3}"), None, 7, "x", 0.5, "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [(None, None), (None, "no id"), (1, ""), (2, None), (3, "  \n\t "), (4, "x" * 20_000), (5, "same text here"), (6, "same text here"), (6, "same text here"), (7, "é " * 5_000)]


# --- SimHash


def brute_fingerprint(text):
    ws = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@pytest.mark.parametrize("text", [None, "", " \x0b\x0c ", "One", "One TWO", "a b c d É é", "a\x1cb c d", "A b  c\nd e f g " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root = {k: low if v in (root[a], root[b]) else v for k, v in root.items()}
                    changed = True
    return root


def test_links_give_all_components(spark):
    r = random.Random(4)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):  # chains of neighbours, and strays three bits off
            fps.add(x)
            for _ in range(r.choice((1, 2, 2, 3))):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {(row["node"] % (1 << 64)): row["root"] % (1 << 64) for row in components(simhash.links(frame)).collect()}
    want = brute_components(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({f: found.get(f, f) for f in fps}) == groups(want)


def test_dense_group_is_one_component():
    base = 0x0123456789ABCDEF
    fps = np.array([base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)], np.uint64)
    linked = {(min(int(x), int(y)), max(int(x), int(y))) for a, b in simhash.close_pairs(np.unique(fps), simhash.pivots()) for x, y in zip(a, b)}
    want = sorted(fps.tolist())
    assert linked == {(a, b) for i, a in enumerate(want) for b in want[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert set(brute_components(want).values()) == {want[0]}


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert by[1, zero] == by[2, zero] == by[3, zero] == by[None, zero] == 1
    assert [r["component_id"] for r in rows if r["doc_id"] == 6] == [5, 5]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_one_of_each_keeps_one_row_a_component(spark):
    kept = simhash.one_of_each(table(spark, ODD))
    assert kept.columns == table(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "7", "None"]
    twice = simhash.one_of_each(table(spark, [(9, "the very same"), (9, "the very same")]))
    assert twice.count() == 1


# --- packing


def test_packing_is_gapless_and_exact(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(1)
    docs = [*ODD, *((100 + i, words(r, r.randint(0, 400), "abcéß Σ'sİ1\x1c\x85")) for i in range(40))]
    pieces = packing.pack(table(spark, docs).repartition(5), path, length=64).collect()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    place = {}
    for p in pieces:
        for k in range(p["length"]):
            assert place.setdefault((p["sequence_id"], p["offset"] + k), p) is p
        assert p["offset"] + p["length"] <= 64
        options = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]]
        assert any(zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for x in options)
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sorted(place) == [divmod(k, 64) for k in range(total)]
    assert packing.pack(table(spark, []), path).count() == 0


# --- byte-pair encoding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    pieces = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})


def test_bpe_round_trip(spark, reference):
    r = random.Random(2)
    docs = [*ODD, *((50 + i, words(r, 30, "abcdeéñ你🙂 '\x1c\x85　t123")) for i in range(30)), (99, "a" * 3000), (98, "<|endoftext|>")]
    rows = bpe.round_trip(table(spark, docs), RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((str(i), len(x := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)
    assert sorted((str(a["doc_id"]), a["n_tokens"], a["ids_sha256"], a["decoded_sha256"]) for a in rows) == want
    back = bpe.decode(bpe.encode(table(spark, docs), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((str(a["doc_id"]), bytes(a["bytes"]).decode()) for a in back) == sorted((str(i), t or "") for i, t in docs)


def test_fold_by_expressions_equals_the_library(spark, reference):
    r = random.Random(3)
    ws = sorted({words(r, 1, "thonreisa é") for _ in range(150)} | {" the", "zzzzqqq", "\n\n", "ñññ", "x"})
    ws = [w for w in ws if w]
    rows = bpe.fold_words(spark.createDataFrame([(w,) for w in ws], "word string"), bpe.Ranks(bpe.read_ranks(RANKS))).collect()
    for row in rows:
        got = list(row["ids"])
        assert b"".join(reference.decode_single_token_bytes(i) for i in got) == row["word"].encode()
        assert got == reference._encode_single_piece(row["word"])


def test_bpe_of_nothing(spark):
    assert bpe.round_trip(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# --- lines


def passages(r):
    """Documents of lines of their own, with a passage that some share."""
    shared = [words(r, 22) for _ in range(3)]
    docs = []
    for i in range(30):
        lines = [words(r, r.randint(5, 40)) for _ in range(r.randint(3, 9))]
        if i % 3 == 0:
            at = r.randint(0, len(lines))
            lines[at:at] = shared
        docs.append((i, "\n".join(lines)))
    return shared, docs


def test_shared_passages_stay_once(spark):
    shared, docs = passages(random.Random(5))
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table(spark, docs)).collect()}
    for i, text in docs:
        if i and i % 3 == 0:
            assert out[i].split("\n") == [x for x in text.split("\n") if x not in shared]
        else:
            assert out[i] == text


def test_lines_of_odd_rows(spark):
    long = "\n".join(words(random.Random(6), 12) for _ in range(200))
    rows = [*ODD, (20, long), (21, long), (22, "short line\n" + long), (23, "short line\nother"), (20, long)]
    done = linededup.dedup_lines(table(spark, rows))
    assert done.columns == [*table(spark, []).columns, "__removed"]
    out = sorted(((r["doc_id"], r["text"]) for r in done.collect()), key=str)
    assert out == sorted([*ODD, (20, long), (20, long), (21, ""), (22, "short line"), (23, "short line\nother")], key=str)
    assert linededup.dedup_lines(table(spark, [])).count() == 0


# --- I-Match


def test_edited_texts_and_fingerprints(spark):
    r = random.Random(7)
    common = [words(r, 1) for _ in range(60)]
    docs = [(10 * i, " ".join(r.sample(common, 25) + [words(r, 20)])) for i in range(60)]
    docs += [(5, docs[0][1]), (7, ""), (8, None)]
    rows = {x["doc_id"]: x for x in imatch.edited(table(spark, docs)).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()
    assert rows[5]["fingerprint"] == rows[0]["fingerprint"] and rows[7]["fingerprint"] == rows[8]["fingerprint"]
    assert np.mean([x["near_edited"] > x["near_next"] for x in rows.values()]) > 0.8
    assert rows[8]["near_edited"] == 1.0


def test_imatch_of_odd_rows(spark):
    rows = imatch.edited(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in rows)
    assert imatch.edited(table(spark, [])).count() == 0
    assert imatch.edited(table(spark, [(1, "alone again")])).collect()[0]["near_next"] == 1.0


def test_lexicon_table_holds_its_terms_only(spark):
    inside = [xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(500)]
    lex = imatch.Lexicon([x - (1 << 64) if x >> 63 else x for x in inside])
    frame = spark.range(1000).select(F.col("id"), F.xxhash64(F.col("id").cast("string")).alias("h")).select("id", lex.holds(F.col("h")).alias("in"))
    assert {r["id"] for r in frame.filter("in").collect()} == set(range(500))


# --- quality


def labelled(spark, n=400):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in words(r, 30).split()) if bad else words(r, 40)
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_tells_shouts_from_prose(spark):
    docs, labels = labelled(spark)
    out = quality.score(docs, quality.fit(docs, labels)).select("row.doc_id", "score", "keep").collect()
    assert all(r["keep"] == (r["doc_id"] % 5 != 0) for r in out)


def test_sparse_sites_shrink_to_the_rate_of_all(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 5, "tiny").when(F.col("doc_id") % 5 == 0, "bad").otherwise("good"))
    model = quality.fit(docs, labels)
    rate = {r["row"]["source"]: r["path_score"] for r in quality.score(docs, model).collect()}
    assert rate["bad"] < 0.3 < 0.7 < rate["good"] and rate["bad"] < rate["tiny"] < model.base


def test_quality_of_odd_rows(spark):
    _, labels = labelled(spark)
    docs = table(spark, ODD, source=None)
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(ODD) and out[0]["row"].asDict().keys() == set(docs.columns)
    assert quality.score(table(spark, []), quality.fit(table(spark, []), labels)).count() == 0


# --- toxicity


def brute_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    """Every pair of equal subsequences of up to `order` letters, by enumeration."""
    from itertools import combinations

    total = 0.0
    for q in range(1, order + 1):
        for a in combinations(range(len(s)), q):
            for b in combinations(range(len(t)), q):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += decay ** (a[-1] - a[0] + 1 - q + b[-1] - b[0] + 1 - q)
    return total


def test_kernel_counts_gapped_subsequences():
    ws, ms = ["idiot", "ixdiot", "abc", "toidi", "i"], ["idiot", "clown", "moronic"]
    got = toxicity.Landmarks(ms).kernel(ws)
    want = np.array([[brute_kernel(w, m) for m in ms] for w in ws])
    assert np.allclose(got, want, rtol=1e-4) and np.allclose(toxicity.self_kernel(ws), [brute_kernel(w, w) for w in ws], rtol=1e-4)


def insulting(spark):
    r = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        ws = words(r, 40, "abcdefghijklmnop").split()
        if i % 4 == 0:
            for _ in range(3):
                ws[r.randrange(len(ws))] = r.choice(("idiot", "wretched", "scumbag"))
        docs.append((i, " ".join(ws[:20]) + ". " + " ".join(ws[20:]) + "."))
        labels.append((i, 1, int(i % 4 == 0)))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_documents_held_out(spark):
    docs, labels = insulting(spark)
    machine = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    gapped = table(spark, [(1, "you are an i d i o t indeed"), (2, "some id-iot said"), (3, "what a scum.bag he is"), (4, "plain words about nothing"), (5, "an idxiot here")])
    score = {r["doc_id"]: r["score"] for r in toxicity.score(gapped, machine).collect()}
    assert min(score[1], score[2], score[3]) > 0.5 > score[4] and score[5] > score[4]
    assert toxicity.without_toxic(gapped, machine).columns == gapped.columns
    assert 4 in {r["doc_id"] for r in toxicity.without_toxic(gapped, machine).collect()}


def test_toxicity_of_odd_rows(spark):
    docs, labels = insulting(spark)
    machine = toxicity.fit(docs, labels)
    rows = toxicity.score(table(spark, ODD), machine).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert toxicity.score(table(spark, []), machine).count() == 0
    assert toxicity.fit(table(spark, []), labels) is None and toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r["predicted"] for r in toxicity.score(docs, None).collect()} == {0}
