"""Pages, archives, vectors and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from candela.llm import ann, html, warc

# --- pages


@pytest.fixture(scope="module")
def field():
    return html.trained()


def test_field_on_pages_held_out(field):
    r = random.Random(99)
    right = total = 0
    for _ in range(150):
        page, labels = html.labelled_page(r)
        found = html.blocks(page, field.known)
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(field.decode(found), labels))
        total += len(labels)
    assert right / total > 0.99


def brute_viterbi(field, found):
    from itertools import product

    fs_ = html.features(found)
    emit = [[sum(field.weights.get(f, (0.0, 0.0))[y] for f in x) for y in (0, 1)] for x in fs_]
    return max(product((0, 1), repeat=len(found)), key=lambda ys: sum(e[y] for e, y in zip(emit, ys)) + sum(field.moves[a][b] for a, b in zip(ys, ys[1:])))


def test_viterbi_is_the_best_of_all(field):
    r = random.Random(98)
    done = 0
    while done < 8:
        page, labels = html.labelled_page(r)
        if len(labels) <= 11:
            found = html.blocks(page, field.known)
            assert tuple(field.decode(found)) == brute_viterbi(field, found)
            done += 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now, it is the best thing there is.</div>
<div class="cookie-notice">We use cookies on this site.</div>
<article><h1>The&nbsp;title &amp; more</h1><p>First <b>bold</b>
 paragraph, with words &lt;enough&gt; to be read&hellip;<p>Second one &copy without an end, but quite some words in it.<br>After the break.
<ul><li>a point that is made in the text</li><li>another point, with some more words</li></ul></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I don't agree with this at all, says a reader.</p></div></section>
<form><label>Name</label><button>Send</button></form><aside class="sidebar"><p>Related <a href="/c">stories</a></p></aside><footer>&copy; 2020 Site</footer></body></html>"""


def test_article_of_a_page(field):
    assert field.main_text(PAGE).split("\n") == ["The title & more", "First bold paragraph, with words <enough> to be read…", "Second one © without an end, but quite some words in it. After the break.", "a point that is made in the text", "another point, with some more words"]


def test_pages_of_odd_rows(spark, field):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", "<<<>>&&&amp;"), (4, "u", "<div>" * 3000 + "deep words in here"), (5, "u", "plain text, no tags at all in this one."), (5, "u", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html.main_texts(pages, field).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] in (1, 2)] == ["", ""]
    assert html.main_texts(pages.limit(0), field).count() == 0


# --- archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", 3) for r in rows], "page_id long, url string, html string, digest string, n int")


def test_archives_round_trip_in_any_ranges(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abc é<>\n") for _ in range(r.randint(0, 4000))) for _ in range(40)]
    rows = [(i, f"http://x/{i}", texts[i % 25]) for i in range(60)] + [(70, None, None), (71, "a\r\nb\\c", ""), (None, "http://n", texts[0]), (3, "http://again", texts[3])]
    archives = warc.write_archives(pages(spark, rows).repartition(3), archive_bytes=20_000)
    for split in (700, 5_000, 1 << 30):
        got = sorted(((x["page_id"], x["url"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.read_archives(archives, split_bytes=split).collect()), key=str)
        want = []
        for i, u, t in rows:
            b = (t or "").encode()
            first = min((k for k, _, x in rows if k is not None and (x or "") == (t or "")), default=None)
            again = len(b) >= 100 and i is not None and first != i
            want.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
        assert got == sorted(want, key=str)


def test_archives_are_plain_gzip_and_keep_payloads(spark):
    archives = warc.write_archives(pages(spark, [(1, "u", "x" * 200), (2, "v", "y")]).coalesce(1))
    path = archives.first()["path"]
    store, at = fs.FileSystem.from_uri(path)
    data = gzip.decompress(store.open_input_file(at).read())
    assert data.count(b"WARC/1.1\r\n") == 2 and b"x" * 200 in data
    assert {x["page_id"]: bytes(x["payload"]) for x in warc.read_archives(archives).collect()} == {1: b"x" * 200, 2: b"y"}


def test_magic_inside_a_payload_is_no_record():
    fake = warc.MAGIC + b"\0" * 30
    a = warc.member(1, "u", b"q" * 50, hashlib.sha256(b"q" * 50).hexdigest(), None)
    blob = fake + a + fake + a + warc.MAGIC

    class Memory:
        def seek(self, at):
            self.at = at

        def read(self, n):
            return blob[self.at : self.at + n]

    for cut in range(0, len(blob), 7):
        n = sum(len(list(warc._Range(Memory(), len(blob), x, y).records())) for x, y in ((0, cut), (cut, len(blob))))
        assert n == 2


def test_no_pages_no_archives(spark):
    archives = warc.write_archives(pages(spark, []))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


# --- vectors


def vectors(spark, x, ids=None):
    rows = [(i, v, 1, 0.5) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, score double")


def exact(x, ids, q, k):
    x = np.array(x, np.float32).astype(float)
    s = x @ x[list(ids).index(q)]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q]
    return [ids[i] for i in order[:k]]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = ann.nearest(vectors(spark, x.tolist()), lambda i: i % 100 == 0).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    f32 = np.array(x, np.float32).astype(float)
    hits = 0
    for q, by in found.items():
        assert sorted(by) == list(range(1, 21))
        assert all(abs(f32[q] @ f32[v] - s) < 1e-12 for v, s in by.values())
        hits += len({v for v, _ in by.values()} & set(exact(x, np.arange(3000), q, 20)))
    assert len(found) == 30 and hits / (30 * 20) >= 0.95


def test_ties_go_to_smaller_ids_in_a_hot_list(spark):
    x = [[1.0, 0.0]] * 300 + [[0.0, 1.0]] * 5
    out = ann.nearest(vectors(spark, x), lambda i: i == 250).collect()
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(20))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1.0, 2.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [3.0, 1.0], [2.0], [], [1.0, 2.0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None]
    out = ann.nearest(vectors(spark, x, ids), lambda i: i >= 0).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in out) == [(0, 6, 5.0), (6, 0, 5.0)]
    assert ann.nearest(vectors(spark, []), lambda i: i >= 0).count() == 0
    assert ann.nearest(vectors(spark, [[1.0, 1.0]]), lambda i: i >= 0).count() == 0


# --- queries and pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        seen.append(kept.count())
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[3] and 0 < seen[4] < seen[0]
    assert kept.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert len({r["doc_id"] for r in kept.collect()}) == seen[4]
    last = {(r["doc_id"], r["doc_tokens"]) for r in p.STAGES[-1][1](spark, kept, SF).collect()}
    assert last == {(r["doc_id"], r["doc_tokens"]) for r in p.run(spark, SF).collect()}


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, __id int"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "a", "b", 2), (2, "some plain text", None, "s", None, "a", "b", 2), (2, "some plain text", None, "s", None, "a", "b", 2), (3, "word " * 30_000, "en", None, 1, None, None, None)]
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(rows, schema)
        out = stage(spark, docs, SF)
        out.collect()
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered_queries(spark):
    from candela.llm import queries

    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_ann_small_clusters_get_all_they_ask_for(spark):
    """A query whose probed lists hold few vectors probes on: tight clusters, one of six."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16)) * 10
    x = np.concatenate([centres[k] + rng.normal(size=(142, 16)) * 0.01 for k in range(7)] + [centres[7] + rng.normal(size=(6, 16)) * 0.01])
    for shift in (0, 1000, 5000):
        df = vectors(spark, x.tolist(), [shift + i for i in range(len(x))])
        out = ann.nearest(df, lambda i: i >= shift + 994).collect()  # noqa: B023
        assert {q: sum(r.query_id == q for r in out) for q in {r.query_id for r in out}} == {shift + i: 20 for i in range(994, 1000)}


def test_ann_second_level_of_centroids(spark):
    """More lists than the sample bears: all vectors are filed, and neighbours are found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 8))
    model = ann.fit(x[:200], 1500, lists=100)
    assert len(model.centroids) >= 100 > 200 // 8 and len(np.unique(model.assign(x))) > 60
    got = ann.nearest(vectors(spark, x.tolist()), lambda i: i % 50 == 0, lists=100, sample=200).collect()
    want = {q: set(np.argsort(-np.where(np.arange(1500) == q, -np.inf, x @ x[q]), kind="stable")[:20].tolist()) for q in range(0, 1500, 50)}
    assert np.mean([r.vec_id in want[r.query_id] for r in got]) >= 0.9 and len(got) == 600


@pytest.mark.parametrize("name", ["op7_warc", "op12_decontaminate", "op13_merkle"])
def test_queries_equal_their_sql(spark, name):
    import oracle
    from candela.llm import queries

    assert set(queries.oracle_sql()) == {"op7_warc", "op12_decontaminate", "op13_merkle"}
    assert oracle.compare(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == ""


def recall(spark, x, every=20, **how):
    """Share of the truly nearest (by score, so ties count) that are found for each 20th row."""
    x = x.astype(np.float32)
    out = ann.nearest(vectors(spark, x.tolist()), lambda i: i % every == 0, **how).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, hits = x.astype(np.float64), 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        hits += int((s[got.get(q, [])] >= np.sort(s)[-20] * (1 - 1e-12)).sum())
    return hits / 20 / len(range(0, len(x), every))


def test_ann_large_groups_of_almost_equal_vectors(spark):
    """Their codes are the same, so more than RERANK rows of a list look equally near."""
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda g: g / np.linalg.norm(g, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    tight = np.repeat(unit(5), 400, axis=0) * 2 + rng.normal(size=(2000, 16)) * 1e-6
    assert recall(spark, np.concatenate([unit(4000), tight])[rng.permutation(6000)], lists=4) > 0.95


def test_ann_of_large_numbers(spark):
    """Products beyond single precision used to be left out."""
    rng = np.random.default_rng(4)
    assert recall(spark, rng.normal(size=(600, 8)) * 1e25) > 0.9
