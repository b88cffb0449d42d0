"""Phrases and proximity against plain loops."""

import random
import re
from hashlib import sha256

import pytest

from candela.llm import decontaminate as d

ITEMS = "item_id long, text string, doc_id long"
DOCS = "doc_id long, text string, n_hit long, item_id long, uid string"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for i, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for item, text, *_ in items:
            v = words(text)
            k = min(10, len(v))
            grams = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(ids), sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = random.Random(4)
    some = lambda n, k=30: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 25, 60])), 1) for i in range(40)]
    items += [(100, items[6][1], 1), (101, items[6][1], 1), (7, items[8][1], 1), (None, some(12), 1), (200, None, 1), (201, "?!", 1), (202, "aa aa aa", 1), (203, "aa " * 30, 1), (204, "Straße ÄÖ x" * 4, 1), (205, "zz yy", 1)]
    docs = []
    for i in range(60):
        parts = [some(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            w = text.split()
            a = rng.randrange(max(1, len(w)))
            parts += [", ".join(w[a : a + rng.randrange(8, 40)]).upper(), some(rng.randrange(5))]
        docs.append((i, "\n".join(parts), 5, 5, "u"))
    docs += [(70, None, 1, 1, "u"), (71, "", 1, 1, "u"), (72, "... !", 1, 1, "u"), (None, items[6][1], 1, 1, "u"), (73, "aa " * 45, 1, 1, "u"), (74, ("aa " * 11 + "b ") * 5, 1, 1, "u")]
    docs += [(75, items[6][1] + " x", 1, 1, "u")] * 300 + [(76, some(30_000) + " " + items[6][1], 1, 1, "u")]
    return docs, items


def both(spark, docs, items):
    out = d.decontaminate(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, ITEMS))
    key = lambda r: str(tuple(r))
    return sorted(map(tuple, out.collect()), key=key), sorted(brute(docs, items), key=key)


@pytest.fixture(params=["broadcast", "shuffled"])
def way(request, monkeypatch):
    """The same results where nothing is small enough to be broadcast, and where most terms are heavy."""
    if request.param == "shuffled":
        monkeypatch.setattr(d, "is_small", lambda *a: False)


def test_equals_loops(spark, way):
    ours, theirs = both(spark, *fixture())
    assert ours == theirs and sum(r[5] for r in theirs) > 300


def test_empty_tables(spark):
    docs, items = fixture()
    assert both(spark, [], items)[0] == []
    ours, theirs = both(spark, docs[:20], [])
    assert ours == theirs and not any(r[5] for r in ours)
    ours, theirs = both(spark, docs[60:63], items)
    assert ours == theirs


def test_clashing_id(spark):
    docs = spark.createDataFrame([(1, "a b")], "n_words long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    row = d.decontaminate(docs, items, id_col="n_words").first()
    assert row.n_words == 1 and row.n_words_ == 2 and row.n_hit == 1


def test_near(spark, way):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(120)), 1, 1, "u") for i in range(6)]
    items = [(0, "w1 w2 w3 w1", 1), (1, "w4", 1), (2, "w5 w6 missing", 1), (3, " ".join(f"w{k % 8}" for k in range(12)), 1)]
    index = d.build_index(spark.createDataFrame(docs, DOCS).repartition(3))
    ids, terms = d.test_terms(index, spark.createDataFrame(items, ITEMS))
    heads = index.filter("term is null").select("uid", "doc_id")
    got = d.near(index, terms, 6).join(heads, "uid").join(ids, "gid").select("doc_id", "item", "start", "pos", "span").collect()
    texts = {i: words(t) for i, t, *_ in docs}
    counts = {}
    for w in texts.values():
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    want = []
    for item, text, _ in items:
        v = words(text)
        for s in range(max(1, len(v) - 9)):
            win = v[s : s + 10]
            if any(x not in counts for x in win):
                continue
            rare = min(win, key=lambda x: (counts[x], x))
            for i, w in texts.items():
                for p, x in enumerate(w):
                    if x != rare:
                        continue
                    places = [p]
                    for y in set(win) - {rare}:
                        near = [(abs(q - p), q) for q in range(max(0, p - 6), min(len(w), p + 7)) if w[q] == y]
                        if not near:
                            break
                        places.append(min(near)[1])
                    else:
                        want.append((i, str(item), s, p, max(places) - min(places) + 1))
    assert sorted(map(tuple, got)) == sorted(want) and want
