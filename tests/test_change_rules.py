"""Rules on change points by plain loops; nothing looks ahead; curves at their joints."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import change_rules as c
from candela.operators.sequences import RunLength


def returns(n=260, seed=3):
    rng = np.random.default_rng(seed)
    part = (np.arange(n) // 65) % 2
    return np.where(part == 0, rng.normal(0.004, 0.004, n), rng.normal(-0.006, 0.02, n))


def table(spark, r):
    return spark.createDataFrame(pd.DataFrame({"symbol": "a", "date": pd.bdate_range("2020-01-01", periods=len(r)).date, "r": r}))


def loop_changes(x, hazard, spacing):
    """Places of changes, by the model and running standardisation."""
    model, out, began, before = RunLength(hazard, 0.1, 2.0, 1.0), [], 0, 0
    for i in range(len(x)):
        sd = np.std(x[: i + 1])
        run = model.update((x[i] - np.mean(x[: i + 1])) / sd if sd > 1e-12 else 0.0)[1]
        if before > 3 and run <= 2 and i - began >= spacing:
            out.append(i)
            began = i
        before = run
    return out


def test_rules_equal_loops(spark):
    r = returns()
    df = table(spark, r)
    days = [x.date for x in df.orderBy("date").collect()]
    at = loop_changes(r, 0.01, 5)
    assert [x.date for x in c.change_points(df, "r").orderBy("date").collect()] == [days[i] for i in at] and at
    regime, want = "neutral", []
    for i in range(len(r)):
        since = r[max([0, *[k for k in at if k <= i]]) : i + 1]
        if len(since) >= 5:
            regime = "bullish" if since[-5:].mean() > 0 else "bearish"
        want.append(regime)
    got = c.by_direction(df).orderBy("date").collect()
    assert [x.regime for x in got] == want and [x.position for x in got] == [float(x == "bullish") for x in want]
    assert {x.position for x in c.by_direction(df, long_only=False).collect()} == {-1.0, 0.0, 1.0}
    size = np.abs(r)
    at, regime, want = loop_changes(size, 0.02, 5), "low_vol", []
    for i in range(len(r)):
        since = size[max([0, *[k for k in at if k <= i]]) : i + 1]
        if len(since) >= 3:
            regime = "high_vol" if since[-5:].mean() > size[: i + 1].mean() * 1.5 else "low_vol"
        want.append(0.0 if regime == "high_vol" else 1.0)
    assert [x.position for x in c.by_volatility(df).orderBy("date").collect()] == want and set(want) == {0.0, 1.0}


def test_both_equals_loops(spark):
    r = returns(200)
    ema = pd.Series(r).ewm(span=5).mean().to_numpy()
    vol = np.array([np.std(r[max(0, i - 19) : i + 1], ddof=1) * math.sqrt(252) if i else 0.0 for i in range(len(r))])
    a, b, want = loop_changes(ema, 1 / 20, 3), loop_changes(vol, 1 / 50, 5), []
    for i in range(len(r)):
        t, v = (x[max([0, *[k for k in at if k <= i]]) : i + 1] for x, at in ((ema, a), (vol, b)))
        bullish = len(t) >= 2 and t[-10:].mean() > 0
        wild = i > 0 and v[-10:].mean() > 1.2 * np.median(vol[:i])
        want.append((0.5 if wild else 1.0) if bullish else 0.0)
    assert [x.position for x in c.by_both(table(spark, r)).orderBy("date").collect()] == want and set(want) == {0.0, 0.5, 1.0}


def test_no_look_ahead(spark):
    r = returns()
    for rule in (c.by_direction, c.by_volatility, c.by_both):
        whole, part = (rule(table(spark, x)).orderBy("date").collect() for x in (r, r[:150]))
        assert whole[:150] == part


def test_earned_by_hand(spark):
    told = table(spark, np.array([0.1, 0.2, -0.1])).withColumn("position", F.when(F.col("r") > 0, 1.0).otherwise(0.0))
    x = c.earned(told).first()
    assert (x.days, x.trades) == (3, 1) and x.strategy == pytest.approx(math.log(1.2) + math.log(0.9)) and x.hold == pytest.approx(math.log(1.1 * 1.2 * 0.9))


def test_combined(spark):
    rows = spark.createDataFrame([(0.2, 0.5), (0.9, 0.1), (0.1, 0.8)], "bocpd_risk double, leading_risk double")
    got = {m: [(round(x.risk, 9), round(x.position, 9)) for x in c.combined(rows, m).collect()] for m in ("max", "weighted", "product")}
    assert got["max"] == [(0.5, 0.625), (0.9, 0.325), (0.8, 0.5)]
    assert got["weighted"] == [(0.38, 0.715), (0.42, 0.685), (0.52, 0.5)]
    assert got["product"] == [(0.6, 0.55), (0.91, 0.3175), (0.82, 0.5)]


def test_curves_meet_at_their_joints(spark):
    days = pd.date_range("2020-01-01", periods=40).date
    vix = spark.createDataFrame([(d, 20.0) for d in days], "date date, vix double")
    ratios = [0.9, 1.0, 1.0499999, 1.0500001, 1.2, None]
    longer = spark.createDataFrame([(d, 20.0 / x) for d, x in zip(days, ratios) if x], "date date, level double")
    spreads = spark.createDataFrame([(d, float(i % 2) + (9.0 if i == 39 else 0.0)) for i, d in enumerate(days)], "date date, spread double")
    out = c.full_leading(vix, longer, spreads).orderBy("date").collect()
    assert [round(x.risk_vix_term, 4) for x in out[:6]] == [0.0, 0.0, 0.5, 0.5, round(0.5 + 0.5 * (1 - math.exp(-1.5)), 4), 0.0]
    assert [x.term_inverted for x in out[:6]] == [0, 0, 0, 1, 1, 0] and {x.credit_zscore for x in out[:19]} == {0.0}
    last = [float(i % 2) for i in range(20, 39)] + [10.0]
    z = (10.0 - np.mean(last)) / np.std(last)
    assert out[39].credit_zscore == pytest.approx(z) and out[39].risk_credit == pytest.approx(0.7 + 0.3 * (1 - math.exp(-(z - 2.5))))
    assert out[39].leading_risk == pytest.approx(sum(out[39][k] * v for k, v in c.WEIGHTS.items()))
