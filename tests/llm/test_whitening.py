"""Whitening against NumPy on the exact numbers, edge cases, and the eigen-solve."""

import numpy as np
import pytest

from candela.llm import whitening

SF = "/root/testdata/sf0.001"


def exact(vectors: np.ndarray):
    x = np.floor(64 * vectors.astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    return x, n, s, c, c.T @ c / n


def check(rows, ids, vectors, atol=1e-8):
    x, n, s, c, v = exact(vectors)
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(len(v), 32)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * k
    w = np.array([[got[i, j + 1].whitened for j in range(k)] for i in ids])
    for i, at in zip(ids, range(n)):
        assert int(got[i, 1].deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], s)) and got[i, 1].n == n
    assert np.allclose([got[ids[0], j + 1].explained for j in range(k)], values[:k] / np.trace(v), rtol=1e-9)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6 and rows[0].identity_error < 1e-6
    # whitened times the root of the eigenvalue is a projection on an eigenvector
    for j in range(k):
        direction = np.linalg.lstsq(c, w[:, j] * np.sqrt(values[j]), rcond=None)[0]
        assert np.allclose(v @ direction, values[j] * direction, atol=1e-6 * values[0]) and abs(np.linalg.norm(direction) - 1) < 1e-6


def test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(5)
    data = df.toPandas().sort_values("vec_id")
    check(whitening.whiten(df).collect(), data.vec_id.tolist(), np.stack(data.embedding))


def test_few_dimensions_many_tasks(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 5)) * [1, 2, 3, 50, 0.5] + [1e4, 0, -7, 3, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(70)
    check(whitening.whiten(df).collect(), list(range(400)), m)


def test_edges(spark):
    good = [(i, [float(i % 3), float(i % 5), float(i % 7)], 9, "x") for i in range(30)]
    bad = [(100, None, 1, "x"), (101, [1.0, None, 2.0], 1, "x"), (102, [1.0, float("nan"), 2.0], 1, "x"), (103, [float("inf"), 1.0, 2.0], 1, "x"), (104, [1.0], 1, "x"), (105, [], 1, "x")]
    twice = [(None, [5.0, 5.0, 5.0], 1, "x"), (3, [9.0, 1.0, 2.0], 1, "x"), (3, [9.0, 1.0, 2.0], 1, "x")]
    df = spark.createDataFrame(good + bad + twice, "vec_id long, embedding array<float>, n int, component string")
    out = whitening.whiten(df).collect()
    assert len(out) == 33 * 3 and {r.n for r in out} == {33} and sum(r.vec_id is None for r in out) == 3
    assert not {r.vec_id for r in out} & {100, 101, 102, 103, 104, 105}
    assert {r.identity_error < 1e-9 for r in out} == {True}


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.whitened, r.explained, r.deviation) for r in whitening.whiten(df).collect()] == [(0.0, None, 0)] * 4
    flat = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert {r.whitened for r in rows if r.component == 2} == {0.0} and rows[0].identity_error < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == [] == whitening.whiten(df.selectExpr("vec_id", "CAST(NULL AS array<double>) embedding")).collect()


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    x = [[whitening.LIMIT, 64], [-whitening.LIMIT, 128], [0, 192]]
    s = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert [int(r.deviation) for r in whitening.whiten(df).orderBy("vec_id").collect() if r.component == 1] == want


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(np.arange(n) // 2.0), np.ones((n, n)), np.zeros((n, n))):
        a = a @ a.T
        d, v = whitening.eigen(a)
        size = max(1.0, np.abs(a).max())
        assert np.allclose(d, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * n * size)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-12) and np.allclose(v * d @ v.T, a, atol=1e-12 * n * size)


def test_merged_moments_equal_whole():
    m = np.random.default_rng(1).normal(size=(90, 4)) + 1e6
    parts, buffer = [], np.empty((4, 4))
    for some in np.split(m, [1, 40, 41]):
        state = whitening.Moments(4)
        for v in some:
            state.add(v, buffer)
        parts.append(whitening.Moments.of(state.row(0).to_pylist()[0]))
    for p in parts[1:]:
        parts[0].merge(p)
    assert parts[0].n == 90 and np.allclose(parts[0].m2 / 90, np.cov(m.T, bias=True), rtol=1e-9)
