"""Hidden states against enumeration; discrepancies and Wasserstein distances against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from candela.operators import discrepancy as g
from candela.operators import hidden as h
from candela.operators import models as m


def data(n=300, seed=2):
    rng = np.random.default_rng(seed)
    calm = (np.arange(n) // 60) % 2 == 0
    return np.column_stack([rng.normal(0, np.where(calm, 0.5, 2.0)), np.where(calm, 1.0, 3.0) + rng.normal(0, 0.2, n), rng.normal(size=n)]), calm


def test_filter_equals_enumeration():
    x, _ = data(200)
    model = h.States(x, 3, 1).fit(x, 4)
    z = model.standard(x[:8])
    dense = np.exp(model.log_density(z))
    for t in range(8):  # densities by the plain formula
        for j in range(3):
            cov, d = model.root[j] @ model.root[j].T, z[t] - model.mu[j]
            want = math.exp(-0.5 * d @ np.linalg.inv(cov) @ d) / math.sqrt((2 * math.pi) ** 3 * np.linalg.det(cov))
            assert dense[t, j] == pytest.approx(want, rel=1e-9)
    start, moves = np.exp(model.log_start), np.exp(model.log_moves)
    told = model.forward(z)
    for n in range(1, 9):
        odds, total = np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=n):
            p = start[path[0]] * dense[0, path[0]]
            for t in range(1, n):
                p *= moves[path[t - 1], path[t]] * dense[t, path[t]]
            odds[path[-1]] += p
            total += p
        assert np.allclose(np.exp(told[0][n - 1]), odds / total, rtol=1e-9)
    assert told[1] == pytest.approx(math.log(total), rel=1e-9)


def test_rounds_raise_the_likelihood():
    x, _ = data()
    model, before = h.States(x, 2, 1), -np.inf
    for _ in range(6):
        model.fit(x, 1)
        now = model.forward(model.standard(x))[1]
        assert now > before - 0.05  # the floor under covariances may cost a trace
        before = now
    moved = h.States(x * 3 + 5, 2, 1).fit(x * 3 + 5, 6)
    assert np.allclose(moved.mu, model.mu, atol=1e-6)  # scales don't matter
    other = h.States(x, 2, 1).fit(x, 2)
    told = other.log_density(other.standard(x[:5]))
    shifted = x[:200] * 2 + 1
    other.mean_, other.sd_ = other.mean, other.sd
    other.fit(shifted, 0)  # states stay where they were in the data's own units
    jacobian = np.log(other.sd_).sum() - np.log(other.sd).sum()
    assert np.allclose(other.log_density(other.standard(x[:5])) - told, -jacobian)


def test_rolling_states(spark):
    x, calm = data()
    days = pd.bdate_range("2020-01-01", periods=len(x)).date
    frame = pd.concat([pd.DataFrame(x, columns=["a", "b", "c"]).assign(symbol=s, date=days) for s in ("p", "q")])
    frame.loc[(frame.symbol == "q") & (frame.date == days[250]), "c"] = np.nan
    run = lambda f: h.rolling_states(spark.createDataFrame(f), ["a", "b", "c"], "b", 2, 120, 40, 10, 3).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    out = run(frame)
    p = out[out.symbol == "p"]
    assert len(p) == 180 and len(out[out.symbol == "q"]) == 179
    assert (p.state.to_numpy() == (~calm[120:]).astype(int)).mean() > 0.95
    assert np.allclose(p.odds_0 + p.odds_1, 1) and p.confidence.between(-1e-9, 1).all()
    cut = days[230]  # nothing looks ahead
    part = run(frame[frame.date <= cut])
    pd.testing.assert_frame_equal(part, out[out.date <= cut].reset_index(drop=True))
    # frozen: the odds between two fits follow from the model of the first alone
    model = h.States(x[:120], 2, 1).fit(x[:120], 10)
    alpha = model.forward(model.standard(x[:120]))[0][-1]
    for t in range(120, 160):
        alpha, _ = model.step(alpha, model.log_density(model.standard(x[t : t + 1]))[0])
        odds = np.exp(alpha)[np.argsort(model.order())]
        assert p.odds_0.iloc[t - 120] == pytest.approx(odds[0], abs=1e-9)


def samples(spark, **arrays):
    rows = [(s, i, None if v is None else [None if w is None or np.isnan(w) else float(w) for w in np.atleast_1d(v)]) for s, x in arrays.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "sample string, id long, x array<double>")


def pairs(spark, *ab):
    return spark.createDataFrame(list(ab), "a string, b string")


def test_mmd_equals_the_double_sum(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 2)), rng.normal(0.5, 1, size=(77, 2))
    k = lambda u, v: np.mean([[math.exp(-((a - b) ** 2).sum() / (2 * 0.7**2)) for b in v] for a in u])
    want = k(x, x) - 2 * k(x, y) + k(y, y)
    s, p = samples(spark, x=x, y=y), pairs(spark, ("x", "y"), ("x", "x"), ("x", "nobody"), ("x", "y"))
    for block in (16, 1024):
        got = {(r.a, r.b): r.mmd2 for r in g.mmd(s, p, 0.7, block).collect()}
        assert got.keys() == {("x", "y"), ("x", "x")} and got["x", "y"] == pytest.approx(want, abs=1e-12) and abs(got["x", "x"]) < 1e-12


def test_quality_tells_clusters_apart(spark):
    rng = np.random.default_rng(3)
    out = g.cluster_quality(samples(spark, u=rng.normal(size=(90, 2)), v=rng.normal(3, 1, size=(90, 2)))).collect()
    by = {(r.kind, r.a, r.b): r.mmd2 for r in out}
    assert by.keys() == {("between", "u", "v"), ("within", "u", "u"), ("within", "v", "v")}
    assert by["between", "u", "v"] > 10 * max(by["within", "u", "u"], by["within", "v", "v"])


def step_distance(a, b, p):
    """The integral piece by piece over all ends of steps."""
    a, b = sorted(a), sorted(b)
    ends = sorted({i * len(b) for i in range(1, len(a) + 1)} | {j * len(a) for j in range(1, len(b) + 1)})
    total, before = 0.0, 0
    for u in ends:
        x, y = a[-(-u // len(b)) - 1], b[-(-u // len(a)) - 1]
        total += abs(x - y) ** p * (u - before) / (len(a) * len(b))
        before = u
    return total


@pytest.mark.parametrize("p", [1, 2])
def test_wasserstein_of_unequal_samples(spark, p):
    rng = np.random.default_rng(6)
    data = {"x": rng.normal(size=(30, 2)).round(1), "y": rng.normal(1, 2, size=(17, 2)).round(1), "z": rng.normal(size=(30, 2)), "one": np.array([[0.5, -1.0]])}
    got = {(r.a, r.b): r.distance for r in g.wasserstein(samples(spark, **data), pairs(spark, ("x", "y"), ("x", "z"), ("one", "y"), ("x", "x"), ("x", "none")), p).collect()}
    assert got.keys() == {("x", "y"), ("x", "z"), ("one", "y"), ("x", "x")}
    for (a, b), d in got.items():
        want = np.mean([step_distance(data[a][:, k], data[b][:, k], p) for k in range(2)]) ** (1 / p)
        assert d == pytest.approx(want, abs=1e-12)
    same = np.mean([np.mean(np.abs(np.sort(data["x"][:, k]) - np.sort(data["z"][:, k])) ** p) for k in range(2)]) ** (1 / p)
    assert got["x", "z"] == pytest.approx(same, abs=1e-12)  # equal sizes: sorted values beside each other


def test_wasserstein_of_missing_values(spark):
    s = samples(spark, x=[[1.0, np.nan], [3.0, np.nan]], y=[[2.0, 5.0]], gone=[None])
    got = g.wasserstein(s, pairs(spark, ("x", "y"), ("x", "gone"))).collect()
    assert [(r.a, r.b, r.distance) for r in got] == [("x", "y", 1.0)]


def test_centroids_as_rows_tell_what_the_fit_tells(spark):
    rng = np.random.default_rng(9)
    n = 420
    frame = pd.DataFrame({"symbol": "a", "date": pd.bdate_range("2020-01-01", periods=n).date, "returns": rng.normal(0, np.where((np.arange(n) // 70) % 2 == 0, 0.01, 0.05))})
    df = spark.createDataFrame(frame)
    want = {r.date: r.regime for r in m.wasserstein_clusters(df).collect() if r.regime >= 0}
    got = {r.date: r.cluster for r in g.nearest_centroid(m.windows(df), m.wasserstein_centroids(df)).collect() if r.cluster is not None}
    assert got == want and len(set(got.values())) == 3
