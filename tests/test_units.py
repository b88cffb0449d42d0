"""Properties of single operators on made-up series."""

import numpy as np
import pandas as pd

from candela.functions.frames import as_of
from candela.operators import features, models, sequences


def series(spark, closes, symbol="a"):
    days = pd.date_range("2020-01-01", periods=len(closes))
    return spark.createDataFrame(pd.DataFrame({"symbol": symbol, "date": days.date, "open": closes, "high": closes, "low": closes, "close": closes, "volume": 1.0}))


def test_rsi_edges(spark):
    up = features.rsi(series(spark, [float(i) for i in range(1, 21)])).orderBy("date").collect()
    assert up[12]["rsi"] is None and up[13]["rsi"] == 100.0
    flat = features.rsi(series(spark, [5.0] * 20)).orderBy("date").collect()
    assert flat[19]["rsi"] is None


def test_as_of_takes_the_last_known(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5)], "symbol string, date int")
    known = spark.createDataFrame([(2, 20.0), (5, 50.0)], "date int, v double")
    assert [r["v"] for r in as_of(rows, known).orderBy("date").collect()] == [None, 20.0, 50.0]


def test_chance_of_a_run_start_is_the_hazard():
    model = sequences.RunLength(0.05)
    rng = np.random.default_rng(0)
    assert max(abs(model.update(x)[0] - 0.05) for x in rng.normal(size=700)) < 1e-12
    assert len(model.n) == sequences.MAX_RUN


def test_run_length_drops_at_a_shift():
    model = sequences.RunLength(0.01)
    rng = np.random.default_rng(1)
    runs = [model.update(x)[1] for x in [*rng.normal(0, 1, 100), *rng.normal(8, 1, 30)]]
    assert runs[99] > 90 and runs[110] < 15


def test_hysteresis_waits_before_it_enters():
    step = sequences.hysteresis_start()
    rocs = [0.0, 0.6, 0.0, 0.0, 0.2, 0.0]
    assert [step(i, x, 0, 0.5, 0.15, 3)[0] for i, x in enumerate(rocs)] == [1, 0, 0, 0, 0, 1]


def test_seeded_average_starts_with_a_mean(spark):
    rows = sequences.macd_seeded(series(spark, [float(i) for i in range(40)])).orderBy("date").collect()
    assert rows[24]["macd"] is None and abs(rows[25]["macd"] - 7.0) < 1e-9 and rows[32]["signal"] is None and rows[33]["signal"] is not None


def test_scan_keeps_symbols_apart(spark):
    both = series(spark, [1.0, 2.0], "a").unionByName(series(spark, [10.0, 20.0], "b"))
    out = {(r["symbol"], r["date"].day): r["kalman_price"] for r in sequences.kalman(both).collect()}
    assert out["a", 1] == 1.0 and out["b", 1] == 10.0


def test_ledger_pays_slippage_and_fees():
    step = sequences.ledger_start()()
    _, cash, shares, equity, _ = step(100.0, 1)
    assert abs(cash - (100_000 - 20_000 - 1)) < 1e-9 and abs(shares - 20_000 / 100.05) < 1e-9 and equity < 100_000
    did, cash, shares, _, pnl = step(89.0, 1)
    assert did == "sell" and shares == 0 and pnl < 0


def test_empty_series(spark):
    none = series(spark, [1.0]).filter("false")
    assert features.returns(none).count() == 0 and sequences.macd(none).count() == 0


def test_order_statistics_equal_sorting_each_frame(spark):
    rng = np.random.default_rng(4)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 12, 90)]
    df = spark.createDataFrame([("a", d.date(), v, 7) for d, v in zip(pd.date_range("2020-01-01", periods=90), x)], "symbol string, date date, v double, w int")
    out = sequences.order_statistics(df, "v", 20).orderBy("date").collect()
    for i, r in enumerate(out):
        held = sorted(v for v in x[max(0, i - 19) : i + 1] if v is not None)
        assert r["__held"] == len(held) and r["v"] == x[i] and r["w"] == 7
        assert r["__median"] == (float(np.median(held)) if held else None)
        assert r["__below"] == (None if x[i] is None else sum(v < x[i] for v in held))
