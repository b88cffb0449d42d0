"""Parzen search: seeded, better than drawing evenly where there is an optimum to find, blind to the test part."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import trees as t
from candela.operators import tuning as u

SPACE = {"a": u.Range(0.0, 10.0), "b": u.Range(0.001, 1000.0, log=True), "k": u.Range(1, 9, whole=True)}


def planted(settings):
    return [-((x["a"] - 7.3) ** 2) - (math.log(x["b"]) - 2.0) ** 2 - (x["k"] - 3) ** 2 for x in settings]


def test_better_than_drawing_evenly():
    ours, even = [], []
    for seed in range(12):
        ours.append(max(x["value"] for x in u.search(planted, SPACE, 10, 8, seed)))
        rng = np.random.default_rng(seed)
        even.append(max(planted([{k: r.out(float(rng.uniform(*r.ends()))) for k, r in SPACE.items()} for _ in range(80)])))
    assert np.mean(ours) > np.mean(even) and sum(a > b for a, b in zip(ours, even)) >= 9


def test_seeded_and_within_bounds():
    a, b, c = u.search(planted, SPACE, 4, 6, 1), u.search(planted, SPACE, 4, 6, 1), u.search(planted, SPACE, 4, 6, 2)
    assert a == b != c and [x["trial"] for x in a] == list(range(24))
    for x in a:
        assert 0 <= x["a"] <= 10 and 0.001 <= x["b"] <= 1000 and isinstance(x["k"], int) and 1 <= x["k"] <= 9
    assert len(u.suggest([{"a": 1.0, "b": 1.0, "k": 2, "value": float("-inf")}] * 30, SPACE, 5, 3)) == 5  # trials that failed say nothing


@pytest.mark.parametrize("points", [[], [0.5], [0.1, 0.1, 0.9]])
def test_density_is_one(points):
    d = u.Parzen(points, (0.0, 1.0))
    wide = np.linspace(-20, 21, 400_001)
    bells = sum(np.exp(-0.5 * ((wide - p) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for p, s in zip(d.points, d.widths))
    mass = ((bells if len(points) else 0) + ((wide >= 0) & (wide <= 1))).sum() * (wide[1] - wide[0]) / (len(points) + 1)
    assert mass == pytest.approx(1, abs=1e-3)
    assert math.exp(d.log_density(0.3)) == pytest.approx(float((np.interp(0.3, wide, bells) if len(points) else 0) + 1) / (len(points) + 1), rel=1e-3)
    rng = np.random.default_rng(1)
    assert all(0 <= d.draw(rng) <= 1 for _ in range(300))


def rows(spark, n=600):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 2))
    up = (x[:, 0] > 0).astype(int)
    part = np.where(np.arange(n) < 300, "train", np.where(np.arange(n) < 450, "validate", "test"))
    return pd.DataFrame(x, columns=["f1", "f2"]).assign(symbol=np.where(np.arange(n) % 2 == 0, "p", "q"), horizon=3, date=pd.date_range("2010-01-01", periods=n).date, target=up, part=part, r=np.where(up == 1, 0.01, -0.01) + rng.normal(size=n) * 0.002)


def test_objective_never_reads_the_test_part(spark):
    frame = rows(spark)
    settings = [{"depth": 1, "leaf": 10, "ridge": 0.1}, {"depth": 3, "leaf": 500, "ridge": 1.0}]
    judged = u.tree_objective(spark.createDataFrame(frame), ["f1", "f2"])(settings)
    spoilt = frame.copy()
    test = spoilt.part == "test"
    spoilt.loc[test, ["target"]] = 1 - spoilt.loc[test, ["target"]]
    spoilt.loc[test, ["r", "f1"]] = -5.0
    assert u.tree_objective(spark.createDataFrame(spoilt), ["f1", "f2"])(settings) == pytest.approx(judged, abs=1e-9)
    assert judged[0] > 5 > judged[1]  # one cut tells the rise; leaves of 500 rows tell nothing


def test_limits_are_each_models_own(spark):
    frame = rows(spark).assign(train=True, y=lambda f: f.target.astype(float), w=1.0, model=lambda f: f.symbol)
    made, cuts = t.prepared(spark.createDataFrame(frame), ["f1", "f2"], 8)
    limits = spark.createDataFrame([("p", 1, 20, 0.0), ("q", 3, 10, 2.0)], "model string, depth int, leaf int, ridge double")
    both = t.tree(made, cuts, t.Shape(3), limits)
    for name, shape in (("p", t.Shape(1, 20)), ("q", t.Shape(3, 10, 32, 2.0))):
        one = t.tree(made.filter(F.col("model") == name), cuts, shape)
        key = lambda n: sorted((r.node, -1 if r.feature is None else r.feature, round(r.value, 9)) for r in n.collect())
        assert key(both.filter(F.col("model") == name)) == key(one)
