"""Trees grown by aggregation against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import trees as t

NAMES = ["a", "b", "c"]


def made(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n).round(1)])
    y = (x[:, 0] > 0.3).astype(float) * 2 + x[:, 1] * 0.5 + rng.normal(size=n) * 0.3
    return x, y


def table(spark, x, y, w=None, models=None, train=None):
    df = pd.DataFrame(x, columns=NAMES).assign(y=y, w=1.0 if w is None else w, model="m" if models is None else models, train=True if train is None else train, id=range(len(y)))
    return spark.createDataFrame(df).repartition(6)


def quantiles(v, bins):
    s = sorted(v)
    return sorted({s[max(0, math.ceil(k / bins * len(s)) - 1)] for k in range(1, bins)})


def loop_tree(x, g, h, shape, cuts):
    """Nodes by plain recursion: {node: (feature, cut, value)}."""
    out = {}

    def walk(node, rows, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = (0.0, None, None, None)
        if depth:
            for j in range(x.shape[1]):
                for k, c in enumerate(cuts[j]):
                    low = rows[x[rows, j] <= c]
                    if len(low) < shape.leaf or len(rows) - len(low) < shape.leaf:
                        continue
                    a, b = g[low].sum(), h[low].sum()
                    gain = a * a / (b + shape.ridge) + (G - a) ** 2 / (H - b + shape.ridge) - G * G / (H + shape.ridge)
                    key = round(gain / H, t.DIGITS)
                    if key > best[0]:
                        best = (key, j, k, c)
        if best[1] is None:
            out[node] = (None, None, G / (H + shape.ridge))
            return
        j, c = best[1], best[3]
        out[node] = (j, c, G / (H + shape.ridge))
        walk(2 * node, rows[x[rows, j] <= c], depth - 1)
        walk(2 * node + 1, rows[x[rows, j] > c], depth - 1)

    walk(1, np.arange(len(g)), shape.depth)
    return out


def told(nodes, row):
    k = 1
    while nodes[k][0] is not None:
        k = 2 * k + int(row[nodes[k][0]] > nodes[k][1])
    return nodes[k][2]


def same(nodes, want):
    got = {r.node: (r.feature, r.cut, r.value) for r in nodes}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == want[k][1] and abs(got[k][2] - want[k][2]) < 1e-9


@pytest.mark.parametrize("shape", [t.Shape(4, 20, 16), t.Shape(2, 100, 8, 1.0), t.Shape(3, 300)])
def test_tree_equals_loops(spark, shape):
    x, y = made()
    w = np.random.default_rng(1).uniform(0.5, 2, len(y))
    rows, cuts = t.prepared(table(spark, x, y, w), NAMES, shape.bins)
    nodes = t.tree(rows, cuts, shape)
    want = loop_tree(x, w * y, w, shape, [quantiles(x[:, j], shape.bins) for j in range(3)])
    same(nodes.collect(), want)
    scored = {r.id: r.score for r in t.score(rows, nodes, shape.depth).collect()}
    assert all(abs(scored[i] - told(want, x[i])) < 1e-9 for i in range(len(y)))


def test_models_side_by_side(spark):
    """Each model is grown as if it were alone, on its training rows; others are only scored."""
    x, y = made(600)
    models = np.where(np.arange(600) % 3 == 0, "p", "q")
    train = np.arange(600) % 5 > 0
    shape = t.Shape(3, 15, 8)
    rows, cuts = t.prepared(table(spark, x, y, models=models, train=train), NAMES, shape.bins)
    nodes = t.tree(rows, cuts, shape)
    for m in ("p", "q"):
        use = (models == m) & train
        want = loop_tree(x[use], y[use], np.ones(use.sum()), shape, [quantiles(x[use, j], 8) for j in range(3)])
        same(nodes.filter(F.col("model") == m).collect(), want)


@pytest.mark.parametrize("logistic", [False, True])
def test_boosting_equals_loops(spark, logistic):
    x, y = made()
    y = (y > 2).astype(float) if logistic else y
    shape, rate = t.Shape(2, 20, 8, 1.0), 0.3
    rows, cuts = t.prepared(table(spark, x, y), NAMES, shape.bins)
    nodes, state = t.boost(rows, cuts, 4, rate, shape, logistic)
    grid = [quantiles(x[:, j], 8) for j in range(3)]
    f = np.zeros(len(y)) if logistic else np.full(len(y), y.mean())
    for k in range(4):
        p = 1 / (1 + np.exp(-f))
        g, h = (y - p, np.maximum(p * (1 - p), 1e-6)) if logistic else (y - f, np.ones(len(y)))
        want = loop_tree(x, g, h, shape, grid)
        same(nodes.filter(F.col("tree") == k).collect(), want)
        f = f + rate * np.array([told(want, r) for r in x])
    got = {r.id: r.f for r in state.select("id", "f").collect()}
    assert max(abs(got[i] - f[i]) for i in range(len(y))) < 1e-9
    saved = {r.id: r.score for r in t.score(rows, nodes, shape.depth, "sum", rate).collect()}
    assert max(abs(saved[i] - f[i]) for i in range(len(y))) < 1e-9


def test_forest(spark):
    x, y = made()
    rows, cuts = t.prepared(table(spark, x, (y > 2).astype(float)), NAMES)
    nodes = t.forest(rows, cuts, 12, t.Shape(4, 10, some=2))
    again = t.forest(rows.repartition(3), cuts, 12, t.Shape(4, 10, some=2))
    key = lambda n: sorted((r.tree, r.node, r.feature, r.cut) for r in n.collect() if r.feature is not None)
    assert key(nodes) == key(again) and len({r[0] for r in key(nodes)}) == 12
    weights = nodes.filter("node = 1").select("n").collect()
    assert all(350 < r.n < 650 for r in weights) and len({r.n for r in weights}) > 1
    out = t.score(rows, nodes, 4).select("y", "score").toPandas()
    assert out[out.y == 1].score.mean() > out[out.y == 0].score.mean() + 0.5 and out.score.between(0, 1).all()


def test_edges(spark):
    """Missing features count as 0; a model of equal labels, or too few rows, is one leaf; a model without nodes has no score."""
    x = np.column_stack([np.arange(8.0), np.full(8, np.nan), np.zeros(8)])
    y = np.where(np.arange(8) < 4, 1.0, 0.0)
    df = table(spark, x, y).withColumn("b", F.when(F.isnan("b"), None).otherwise(F.col("b")))
    flat = df.withColumn("model", F.lit("flat")).withColumn("y", F.lit(1.0))
    rows, cuts = t.prepared(df.unionByName(flat), NAMES)
    nodes = t.tree(rows, cuts, t.Shape(3, 2))
    got = {(r.model, r.node): (r.feature, r.value) for r in nodes.collect()}
    assert got["flat", 1] == (None, 1.0) and got["m", 1][0] == 0 and got["m", 2] == (None, 1.0) and got["m", 3] == (None, 0.0)
    assert t.tree(rows, cuts, t.Shape(3, 100)).count() == 2
    alone = rows.withColumn("model", F.lit("other"))
    assert {r.score for r in t.score(alone, nodes, 3).collect()} == {None}
    gains = {(r.model, r.feature): r.gain for r in t.importance(nodes, NAMES).collect()}
    assert gains["m", "a"] > 0 and gains["m", "b"] == gains["flat", "a"] == 0


def test_walk_forward_learns_from_the_past_alone(spark):
    rng = np.random.default_rng(4)
    days = pd.date_range("2015-01-01", "2020-12-31", freq="D")
    x = rng.normal(size=(len(days), 3))
    df = pd.DataFrame(x, columns=NAMES).assign(date=days.date, known=(days + pd.Timedelta(days=10)).date, y=np.sin(x[:, 0]) + x[:, 1] + rng.normal(size=len(days)) * 0.1)
    one = lambda d: t.walk_forward_regression(spark.createDataFrame(d), NAMES, "y", "known", years=2, rounds=3).toPandas().sort_values("date")
    a = one(df)
    assert set(a.year) == {2019, 2020}
    changed = df.copy()
    changed.loc[changed.date >= pd.Timestamp("2019-12-22").date(), "y"] += 5  # known in 2020 only
    b = one(changed)
    assert np.allclose(a.p, b.p)
    r = {x.year: x for x in t.regression_by_year(spark.createDataFrame(a)).collect()}
    err, all_ = (a.y - a.p) ** 2, r[None]
    assert all_.n == len(a) and abs(all_.rmse - err.mean() ** 0.5) < 1e-9 and abs(all_.r2 - (1 - err.sum() / ((a.y - a.y.mean()) ** 2).sum())) < 1e-9 and all_.r2 > 0.3
    assert r[2019].n == 365
