"""Near copies of the pipeline's stage against brute force."""

import random

import corpus_pipeline
import numpy as np
from candela.llm import neardup
from test_text_operators import ODD, table, words


def sets(texts):
    out = {}
    for i, t in texts:
        ws = t.lower().split()
        out[i] = {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    return out


def brute(texts):
    s = sets(texts)
    root = {i: i for i in s}
    for i in s:
        for j in s:
            if i < j and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) and root[i] != root[j]:
                low, gone = sorted((root[i], root[j]))
                root = {k: low if v == gone else v for k, v in root.items()}
    return sorted(i for i in root if root[i] == i)


def test_near_stage_equals_brute_force(spark):
    r = random.Random(11)
    docs = []
    for base in range(12):  # chains of edits, some within and some beyond the similarity
        ws = words(r, r.randint(20, 150)).split()
        for k in range(10):
            docs.append((100 * base + k, " ".join(ws)))
            for _ in range(r.choice((0, 1, 2, 3, 6))):
                ws[r.randrange(len(ws))] = words(r, 1)
    want = brute(docs)
    assert 20 < len(want) < 110
    kept = corpus_pipeline.near_stage(spark, table(spark, docs), "").collect()
    assert sorted(x["doc_id"] for x in kept) == want


def test_near_stage_of_odd_rows(spark):
    kept = neardup.one_of_each(table(spark, ODD))
    assert kept.columns == table(spark, []).columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "4", "5", "7", "None"]
    assert neardup.one_of_each(table(spark, [])).count() == 0


def test_bands_of_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "HUBS", 1)
    r = random.Random(5)
    base, docs = words(r, 60).split(), []
    for i in range(60):  # copies with up to three edits: most are alike, some only by way of others
        ws = list(base)
        for _ in range(r.choice((1, 1, 2, 3))):
            ws[r.randrange(len(ws))] = words(r, 1)
        docs.append((i, " ".join(ws)))
    kept = neardup.one_of_each(table(spark, docs)).collect()
    assert sorted(x["doc_id"] for x in kept) == brute(docs)


def test_near_stage_is_told_by_fingerprints(spark, monkeypatch):
    """SimHash fingerprints decide which pairs' sets are compared at all, in pairs and in blocks, by pivots and by popcounts."""
    r = random.Random(5)
    base, docs = words(r, 60).split(), []
    for i in range(30):
        docs.append((i, " ".join([*base[:-1], words(r, 1) + str(i)])))
    assert len(neardup.one_of_each(table(spark, docs)).collect()) == 1
    for few in (2, 1000):  # where no pair of fingerprints is near, none is linked
        monkeypatch.setattr(neardup, "FEW", few)
        monkeypatch.setattr(neardup, "RADIUS", -1)
        assert len(neardup.one_of_each(table(spark, docs)).collect()) == 30


def test_fingerprints_of_near_sets_are_near():
    r = np.random.default_rng(3)
    ways = []
    for n in (4, 8, 12, 40, 400, 5000):
        for _ in range(200):
            x = r.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)  # n in common
            cut = n + n // 8
            a, b = np.unique(x[:cut]), np.unique(np.concatenate([x[:n], x[cut:]]))
            ways.append(int(np.bitwise_count(neardup.fingerprint(a) ^ neardup.fingerprint(b)).sum()))
    assert max(ways) <= neardup.RADIUS - 10
    a, b = np.stack([neardup.fingerprint(x) for x in r.integers(0, 1 << 63, (300, 50), dtype=np.uint64)]).reshape(2, 150, -1)
    table, refs = neardup._distances(a, b[:4]), neardup._distances(b, b[:4])
    true = neardup._distances(a, b)
    assert all((np.abs(table[:, None, p] - refs[None, :, p]) <= true).all() for p in range(4))
    assert true.min() > neardup.RADIUS and true[3, 5] == sum(int(x ^ y).bit_count() for x, y in zip(a[3], b[5]))
