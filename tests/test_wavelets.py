"""Filter banks: rule of the taps, perfect reconstruction, energy, against plain loops; causal forms don't look ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import wavelets as w


def frame(spark, **series):
    rows = [(name, "s", d.date(), float(v)) for name, x in series.items() for d, v in zip(pd.date_range("2020-01-01", periods=len(x)), x)]
    return spark.createDataFrame(rows, "symbol string, signal string, date date, x double")


def column(df, symbol, name="x", signal=None):
    rows = df.filter(df.symbol == symbol)
    return [r[name] for r in (rows.filter(rows.signal == signal) if signal else rows).orderBy("date").collect()]


def level(x, order):
    """One level by loops."""
    h, g = w.taps(order), w.detail_taps(order)
    x = list(x) + ([x[-1]] if len(x) % 2 else [])
    at = lambda f, o: sum(f[m] * x[(2 * o - order + 1 + m) % len(x)] for m in range(2 * order))
    return [at(h, o) for o in range(len(x) // 2)], [at(g, o) for o in range(len(x) // 2)]


@pytest.mark.parametrize("order", [1, 2, 4, 6])
def test_taps(order):
    h, g = np.array(w.taps(order)), np.array(w.detail_taps(order))
    for k in range(order):
        assert abs(h[: len(h) - 2 * k] @ h[2 * k :] - (k == 0)) < 1e-10
        assert abs((g * np.arange(len(g)) ** k).sum()) < 1e-6 * max(1, len(g) ** k)  # vanishing moments
    assert abs(h.sum() - 2**0.5) < 1e-12


def test_known_taps():
    r = 3**0.5
    assert np.allclose(w.taps(2), np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * 2**0.5))
    assert np.allclose(w.taps(1), [0.5**0.5] * 2)


def test_bank_equals_loops_and_rebuilds(spark):
    rng = np.random.default_rng(3)
    data = {"odd": rng.normal(size=157), "even": rng.normal(size=128).cumsum(), "short": rng.normal(size=9), "one": np.array([4.0])}
    rows = frame(spark, **data)
    parts = w.analyse(rows)
    got = {}
    for r in parts.collect():
        got.setdefault((r.symbol, r.kind, r.level), {})[r.k] = r.x
    for name, x in data.items():
        a = list(x)
        for k in range(1, w.depth(len(x)) + 1):
            a, d = level(a, 6)
            assert np.allclose([got[name, "d", k][i] for i in range(len(d))], d)
        assert np.allclose([got[name, "a", w.depth(len(x))][i] for i in range(len(a))], a)
    back = w.synthesise(parts, rows, w.deepest(rows))
    for name, x in data.items():
        assert np.allclose(column(back, name), x)
    share = {(r.symbol, r.kind, r.level): r for r in w.energies(parts).collect()}
    assert abs(sum(r.energy for k, r in share.items() if k[0] == "even") - (data["even"] ** 2).sum()) < 1e-8
    assert abs(sum(r.share for k, r in share.items() if k[0] == "odd") - 1) < 1e-12


def test_cut(spark):
    x = np.sin(np.arange(96) / 9) + np.random.default_rng(1).normal(size=96) * 0.2
    rows = frame(spark, a=x)
    for mode in ("soft", "hard"):
        a, details = list(x), []
        for _ in range(w.depth(96)):
            a, d = level(a, 6)
            bound = 0.3 * np.abs(x).max()
            d = np.array(d)
            details.append(np.sign(d) * np.maximum(np.abs(d) - bound, 0) if mode == "soft" else np.where(np.abs(d) >= bound, d, 0))
        h, g = w.taps(), w.detail_taps()
        for d in reversed(details):
            y = np.zeros(2 * len(d))
            for o in range(len(d)):
                for m in range(12):
                    y[(2 * o - 5 + m) % len(y)] += h[m] * a[o] + g[m] * d[o]
            a = list(y)
        assert np.allclose(column(w.denoise(rows, {"x": 0.3}, mode), "a"), a)
    assert np.allclose(column(w.denoise(rows, {"none": 0.0}), "a"), x)


def test_levels_add_up(spark):
    x = np.random.default_rng(2).normal(size=200)
    out = w.select_levels(frame(spark, a=x), 4)
    whole = np.array(column(out, "a", signal="s_keep4"))
    assert np.allclose(whole, x)
    alone = sum(np.array(column(out, "a", signal=f"s_only{k}")) for k in range(1, 4))
    assert np.allclose(np.array(column(out, "a", signal="s_keep1")) + alone, x)  # keep1 has the approximation and the coarsest


def test_last_weights_rebuild():
    v = np.array(w.last_weights(63, 4, 2))
    assert abs(v[-1] - 1) < 1e-9 and np.abs(v[:-1]).max() < 1e-9  # both levels that 63 values have are kept
    assert abs(sum(w.last_weights(63, 4, 0)) - 1) < 1e-9  # a constant passes the approximation
    n = np.arange(128)
    assert abs(np.array(w.last_weights(128, 2, 0)) @ np.ones(128) - 1) < 1e-9 and len(w.last_weights(128, 2, 0)) == len(n)


def test_no_look_ahead(spark):
    x = np.random.default_rng(7).normal(size=140)
    for cut in (90, 139):
        a, b = frame(spark, a=x), frame(spark, a=x[:cut])
        for op in (lambda r: w.causal(r, keep=1), lambda r: w.undecimated(r, 2, 2), lambda r: w.signal(r.drop("signal"), keep=0)):
            whole, part = (op(r).orderBy("date").toPandas() for r in (a, b))
            pd.testing.assert_frame_equal(whole.head(cut), part)


def test_undecimated_equals_loops(spark):
    x = np.random.default_rng(8).normal(size=60)
    h, g = np.array(w.taps(2)) / 2**0.5, np.array(w.detail_taps(2)) / 2**0.5
    v, want = x.copy(), []
    for j in range(2):
        f = lambda t, c: sum(c[m] * v[t - m * 2**j] for m in range(4)) if t - 3 * 2**j >= 0 else np.nan  # noqa: B023, E731
        d, v = np.array([f(t, g) for t in range(60)]), np.array([f(t, h) for t in range(60)])
        want.append(d)
    out = w.undecimated(frame(spark, a=x), 2, 2)
    for k in (1, 2):
        got = np.array([np.nan if y is None else y for y in column(out, "a", f"detail_{k}")])
        assert np.allclose(got, want[k - 1], equal_nan=True)


def test_backtest_by_hand(spark):
    told = spark.createDataFrame([("a", k, x, p, d) for k, (x, p, d) in enumerate([(0.1, 1.0, 0), (0.2, 0.5, 1), (-0.1, 0.0, 0), (0.3, 1.0, 0)])], "symbol string, date int, x double, position double, drop int")
    r = w.signal_backtest(told, 0.01).first()
    net = [0.0, 0.2 - 0.01, -0.05 - 0.005, 0.0 - 0.005]
    assert abs(r.strategy - sum(np.log1p(net))) < 1e-12 and (r.trades, r.drops, r.days) == (3, 1, 4)


def test_change_points_of_a_shifted_series(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(8, 1, 80)])
    rows = frame(spark, a=x, flat=np.ones(50)).withColumn("signal", F.lit("raw"))
    years = rows.groupBy("symbol").agg((F.count("*") / 252).alias("years"))
    out = w.changes_by_signal(rows, years).collect()
    assert [r.symbol for r in out] == ["a"] and out[0].changes >= 1
