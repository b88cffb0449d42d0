"""Overlays, grids and change points against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from test_semantics import bars, prices  # noqa: F401

from candela.operators import detectors as d
from candela.operators import sequences as q
from candela.operators import strategies as g


def test_the_grid_walks_as_the_overlay_does(spark, bars):  # noqa: F811
    rng = np.random.default_rng(9)
    one = prices()
    index = np.exp(np.cumsum(rng.normal(0, 0.1, len(one)))) * 20
    vix = spark.createDataFrame(pd.DataFrame({"date": one["date"], "vix": index}))
    until = str(one["date"].iloc[150])
    got = {tuple(r[:5]) + (r["part"],): r for r in q.grid_search(bars, vix, q.GRID[::37], until).collect()}
    for back, leave, enter, days in q.GRID[::37]:
        step, held = q.hysteresis_start(), []
        for i, v in enumerate(index):
            held.append(step(i, v / index[i - back] - 1 if i >= back else 0.0, back, leave, enter, days)[0])
        r = np.diff(one["close"]) / one["close"].to_numpy()[:-1]
        s = np.array(held[:-1]) * r
        for part, rows in (("train", slice(0, 150)), ("test", slice(150, None))):
            a, b = np.cumprod(1 + s[rows]), np.cumprod(1 + r[rows])
            fall = (a / np.maximum.accumulate(a) - 1).min() - (b / np.maximum.accumulate(b) - 1).min()
            row = got["A", back, leave, enter, days, part]
            assert row["excess"] == pytest.approx(a[-1] - b[-1]) and row["score"] == pytest.approx(a[-1] - b[-1] + 0.5 * fall)
    assert len(q.GRID) == 672


def student(x, data, kappa, alpha, beta):
    """Log density of x after data under a normal-inverse-gamma prior with mean 0, from the data themselves."""
    n = len(data)
    k, a = kappa + n, alpha + n / 2
    mean = sum(data) / n if n else 0.0
    mu = sum(data) / k
    b = beta + 0.5 * sum((v - mean) ** 2 for v in data) + 0.5 * kappa * n * mean**2 / k
    scale = b * (k + 1) / (a * k)
    return math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * a * math.pi * scale) - (a + 0.5) * math.log1p((x - mu) ** 2 / (2 * a * scale))


def test_run_lengths_against_the_posterior_from_whole_runs():
    rng = np.random.default_rng(4)
    xs = np.concatenate([rng.normal(0, 1, 40), rng.normal(4, 1, 30)]).tolist()
    h, prior = 0.02, (0.5, 1.5, 0.8)
    model, runs = q.RunLength(h, *prior), {0: (1.0, [])}
    for x in xs:
        p, likeliest, expected = model.update(x)
        grown = {k + 1: (w * math.exp(student(x, v, *prior)) * (1 - h), [*v, x]) for k, (w, v) in runs.items()}
        new = sum(w * math.exp(student(x, v, *prior)) for w, v in runs.values()) * h
        total = new + sum(w for w, _ in grown.values())
        runs = {0: (new / total, [x])} | {k: (w / total, v) for k, (w, v) in grown.items()}
        assert p == pytest.approx(runs[0][0]) and p == pytest.approx(h)
        assert expected == pytest.approx(sum(k * w for k, (w, _) in runs.items()), rel=1e-6)
        assert runs[likeliest][0] == pytest.approx(max(w for w, _ in runs.values()))


@pytest.mark.parametrize("shift,scale,late", [(5.0, 1.0, 6), (2.5, 1.0, 12), (0.0, 6.0, 15)])
def test_planted_changes_shorten_the_run(shift, scale, late):
    rng = np.random.default_rng(42)
    xs = np.concatenate([rng.normal(0, 1, 100), rng.normal(shift, scale, 60)])
    model = q.RunLength(1 / 100)
    runs = [model.update(float(x))[1] for x in xs]
    found = next(i for i in range(100, 160) if runs[i] <= i - 95)
    assert found - 100 <= late and max(runs[:100]) >= 90


def test_the_gate_opens_at_once_and_closes_after_calm_days():
    step = d.gate_start()
    calm, wild = (0.0, 100.0, 0.0), (0.5, 100.0, 0.0)
    assert [step(*calm)[0] for _ in range(3)] == [0, 0, 0]
    assert step(*wild)[0] == 1
    states = [step(*calm) for _ in range(40)]
    closed = next(i for i, s in enumerate(states) if s[0] == 0)
    assert closed >= d.CALM_DAYS - 1 and all(s[0] == 0 for s in states[closed:])
    assert states[-1][3] == pytest.approx(1.0, abs=1e-3) and step(0.0, 1.0, 0.0)[3] < 0.8


def test_calls_are_repeated_with_growing_pauses():
    waits, left = [], [2]

    def call():
        if left[0]:
            left[0] -= 1
            raise OSError("not yet")
        return "done"

    assert g.repeated(call, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    left[0] = 5
    with pytest.raises(OSError):
        g.repeated(call, times=3, sleep=waits.append)
    with pytest.raises(KeyError):
        g.repeated(lambda: {}["x"], sleep=waits.append)


def test_strategies_by_name(spark, bars):  # noqa: F811
    vix = spark.createDataFrame(pd.DataFrame({"date": prices()["date"], "vix": 20 + 10 * np.sin(np.arange(252) / 3)}))
    for config in ({}, {"type": "nonsense"}, {"type": "vix_roc", "tier": "tier2"}, {"type": "vix_roc_vol", "tier": "tier3"}):
        rows = g.create(config)(bars, vix).collect()
        assert len(rows) == 504 and all(0 <= r["position"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["wasserstein_clusters", "hidden_states"])
def test_rolling_models_do_not_look_ahead(spark, name):
    from candela.operators import models as mo

    rng = np.random.default_rng(3)
    n = 900
    rows = pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2015-01-01", periods=n).date, "returns": rng.normal(0, 0.01, n) * np.where(np.arange(n) // 150 % 2, 3, 1)})
    rows["vol_norm_return"] = rows["returns"] * 100
    table, part = spark.createDataFrame(rows), spark.createDataFrame(rows.iloc[:840])
    whole = {r["date"]: tuple(r) for r in getattr(mo, name)(table).collect()}
    cut = {r["date"]: tuple(r) for r in getattr(mo, name)(part).collect()}
    assert cut and all(whole[k][:3] == v[:3] for k, v in cut.items())


def test_joint_run_lengths_see_a_change_in_any_value():
    rng = np.random.default_rng(8)
    xs = rng.normal(0, 1, (160, 3))
    xs[100:, 1] += 5
    model = q.RunLengths(1 / 200, 3)
    runs = [model.update(tuple(x))[1] for x in xs]
    assert max(runs[:100]) > 80 and min(runs[100:112]) < 15 and runs[-1] < 65


def test_runs_that_start_from_the_prior_keep_the_likeliest():
    rng = np.random.default_rng(2)
    model = q.RunLength(0.02, 0.1, 2.0, 2.0, first=False)
    for x in rng.normal(0, 1, 700):
        p, likeliest, expected = model.update(float(x))
    assert len(model.log_r) == q.MAX_RUN and np.exp(model.log_r).sum() == pytest.approx(1) and 0 < expected <= 700
