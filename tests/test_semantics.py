"""Operators on a seeded price series against plain NumPy, and that nothing looks ahead that doesn't say so."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import features as f
from candela.operators import labels as b
from candela.operators import learners as l
from candela.operators import metrics as m
from candela.operators import models as mo
from candela.operators import sequences as q


def prices(n=252, seed=42, symbol="A"):
    """Business days of a random walk, with the bars about its closes."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
    rows = pd.DataFrame({"symbol": symbol, "date": pd.bdate_range("2023-01-01", periods=n).date, "open": close * (1 + rng.uniform(-0.01, 0.01, n)), "close": close, "volume": rng.integers(10**6, 10**7, n).astype(float)})
    rows["high"] = np.maximum(rows["open"], close) * (1 + rng.uniform(0, 0.02, n))
    rows["low"] = np.minimum(rows["open"], close) * (1 - rng.uniform(0, 0.02, n))
    rows["vwap"], rows["transactions"] = (rows["high"] + rows["low"] + close) / 3, 5
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(pd.concat([prices(), prices(seed=7, symbol="B")])).cache()


def test_portfolio_metrics_of_four_returns(spark):
    rows = spark.createDataFrame([("p", pd.Timestamp("2024-01-0%d" % (i + 1)).date(), r) for i, r in enumerate((0.01, -0.02, 0.03, 0.01))], "symbol string, date date, r double")
    trades = spark.createDataFrame([(10.0, 4, 1.0, 0.5), (-4.0, 2, 1.0, 0.25), (0.0, 3, 1.0, 0.0)], "pnl double, holding_days int, commission double, slippage double")
    got = m.portfolio_metrics(rows, trades).first()
    growth = 1.01 * 0.98 * 1.03 * 1.01
    year = growth ** (252 / 4) - 1
    vol = np.std([0.01, -0.02, 0.03, 0.01]) * math.sqrt(252)
    assert got["total_return"] == pytest.approx(growth - 1) and got["annualized_return"] == pytest.approx(year)
    assert got["sharpe_ratio"] == pytest.approx((year - 0.02) / vol) and got["sortino_ratio"] == 0
    assert got["max_drawdown"] == pytest.approx(0.02) and got["calmar_ratio"] == pytest.approx(year / 0.02)
    assert (got["num_trades"], got["win_rate"], got["avg_win"], got["avg_loss"], got["profit_factor"]) == pytest.approx((3, 1 / 3, 10, -2, 2.5))
    assert (got["avg_trade_duration"], got["total_commission"], got["total_slippage"]) == pytest.approx((3, 3, 0.75))


def test_ml_metrics_of_a_price_series(spark, bars):
    a, z = prices(), prices(seed=7, symbol="B")
    market = spark.createDataFrame(pd.DataFrame({"date": z["date"], "m": z["close"].pct_change()}).iloc[1:])
    got = m.ml_metrics(m.daily(bars).filter("symbol = 'A'"), market).first()
    r = a["close"].pct_change().dropna()
    x = z["close"].pct_change().dropna()
    curve = (1 + r).cumprod()
    beta = r.cov(x) / x.var()
    year = lambda v: (1 + v).prod() ** (252 / len(v)) - 1
    assert got["total_return"] == pytest.approx(curve.iloc[-1] - 1) and got["sharpe_ratio"] == pytest.approx(r.mean() / r.std() * math.sqrt(252))
    assert got["max_drawdown"] == pytest.approx((curve / curve.cummax() - 1).min()) and got["win_rate"] == pytest.approx((r > 0).mean())
    assert got["beta"] == pytest.approx(beta) and got["alpha"] == pytest.approx(year(r) - beta * year(x)) and got["num_trades"] == 0


def brute_changes(true, found, tolerance):
    taken, delays = set(), []
    for d in found:
        at = min(range(len(true)), key=lambda i: (abs(true[i] - d), i))
        if abs(true[at] - d) <= tolerance and at not in taken:
            taken.add(at)
            delays.append(d - true[at])
    return len(taken), float(np.mean(delays)) if delays else 0.0


def test_changes_go_to_the_nearest_true_one_in_order(spark):
    rng = np.random.default_rng(3)
    cases = {"x": ([100, 106], [96, 103, 107])} | {f"s{i}": (sorted(set(rng.integers(0, 200, 6).tolist())), sorted(set(rng.integers(0, 200, 9).tolist()))) for i in range(20)}
    true = spark.createDataFrame([(s, t) for s, (ts, _) in cases.items() for t in ts] + [("quiet", 1)], "symbol string, place int")
    found = spark.createDataFrame([(s, t) for s, (_, fs) in cases.items() for t in fs] + [("none", 3)], "symbol string, place int")
    got = {r["symbol"]: r for r in mo.evaluate_changes(true, found).collect()}
    for s, (ts, fs) in cases.items():
        hits, delay = brute_changes(ts, fs, 5)
        p, c = hits / len(fs), hits / len(ts)
        assert (got[s]["hits"], got[s]["mean_delay"]) == (hits, pytest.approx(delay)) and got[s]["precision"] == pytest.approx(p) and got[s]["recall"] == pytest.approx(c)
        assert got[s]["f1"] == pytest.approx(2 * p * c / (p + c) if p + c else 0)
    assert got["x"]["mean_delay"] == -1.5
    assert (got["quiet"]["precision"], got["quiet"]["recall"]) == (1, 0) and (got["none"]["precision"], got["none"]["recall"]) == (0, 1)


def brute_regimes(rows):
    """The rules, one after another, with the label before."""
    out, prev = [], None
    for risk, t21, t63, vol in rows:
        high, low = risk >= 0.5, risk <= 0.3
        if math.isnan(t63):
            label = "consolidation"
        elif vol >= 0.4 and t21 <= 0.05 or vol >= 0.35 and risk >= 0.75 and t21 <= 0.03 or t21 <= -0.2 or t21 <= -0.12 and vol >= 0.3:
            label = "crisis"
        elif prev in b.BEARISH and t21 >= 0.01 and high:
            label = "bull_transition"
        elif t63 <= -0.08 or t63 <= -0.03 and (t21 <= -0.01 or high) or vol >= 0.22 and t21 <= -0.01 or high and t21 <= -0.01:
            label = "bear"
        elif t63 >= 0.02 and low and vol < 0.22 or t63 >= 0.06 and not high or t63 >= 0.02 and t21 >= 0.01 and not high or low and t21 >= 0.01 and t63 >= 0 or vol <= 0.15 and t21 >= 0.01 and t63 >= 0.02:
            label = "bull"
        elif t21 >= 0.01 and (t63 > -0.03 and (vol >= 0.22 or not low) or high or risk >= 0.35 and t63 >= 0.02):
            label = "bull_transition"
        elif high and t21 < 0.01 and t63 > -0.03 or t21 <= -0.01 and -0.03 < t63 < 0.02 or risk >= 0.35 and t21 <= -0.01:
            label = "bear_transition"
        else:
            label = "consolidation"
        out.append(label)
        prev = label
    return out


def test_regime_rules_with_feedback(spark):
    rng = np.random.default_rng(5)
    n = 3000
    rows = [(float(a), float(x), float(y), float(v)) for a, x, y, v in zip(rng.uniform(0, 1, n), rng.normal(0, 0.05, n), rng.normal(-0.02, 0.06, n), rng.uniform(0.1, 0.42, n))]
    day = pd.date_range("2000-01-01", periods=n).date
    table = spark.createDataFrame([("A", d, *r) for d, r in zip(day, rows)], "symbol string, date date, risk double, trend_21 double, trend_63 double, volatility double")
    got = [r["regime"] for r in b.regimes(table.repartition(7)).orderBy("date").collect()]
    want = brute_regimes(rows)
    assert got == want and len(set(want)) == 6


PAST_ONLY = {
    "returns": f.returns, "moving_averages": f.moving_averages, "rsi": f.rsi, "bollinger": f.bollinger, "atr": f.atr, "volume": f.volume, "obv": f.on_balance_volume, "vol_price_corr": f.volume_price_corr,
    "realized_vol": f.realized_vol, "parkinson": f.parkinson, "streaks": f.streaks, "drawdowns": f.drawdowns, "options_proxy": f.options_proxy, "hmm_features": f.hmm_features, "equity_curve": f.equity_curve,
    "macd": q.macd, "macd_seeded": q.macd_seeded, "kalman": q.kalman, "bocpd": q.bocpd, "online_features": q.online_features, "trend_features": b.trend_features, "tail_rates": b.tail_rates, "garman_klass": b.garman_klass,
}


@pytest.mark.parametrize("name", sorted(PAST_ONLY))
def test_a_prefix_of_the_bars_gives_a_prefix_of_the_rows(bars, name):
    cut = prices()["date"].iloc[150]
    key = lambda d: {(r["symbol"], r["date"]): r for r in d.filter(d["date"] <= cut).collect()}
    whole, part = key(PAST_ONLY[name](bars)), key(PAST_ONLY[name](bars.filter(bars["date"] <= cut)))
    assert whole.keys() == part.keys() and part
    for k, r in part.items():
        for a, z in zip(r, whole[k]):
            assert a == z or a == pytest.approx(z, rel=1e-9, abs=1e-9, nan_ok=True)


def test_models_learn_a_plain_rule(spark, tmp_path):
    """Two groups with opposite rules; missing features count as 0, unknown groups have even odds, one class its own."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    sym = np.where(np.arange(1300) % 2 == 0, "a", "b")
    y = np.where(sym == "a", y, 1 - y)
    frame = pd.DataFrame(x, columns=["f1", "f2", "f3", "f4"]).assign(symbol=sym, horizon=5, date=pd.date_range("2001-01-01", periods=1300).date, target=y, part=np.where(np.arange(1300) < 800, "train", "test"))
    flat = frame.head(40).assign(symbol="flat", target=1)
    rows = spark.createDataFrame(pd.concat([frame, flat]))
    folder = str(tmp_path / "models")
    l.fit(rows, ["f1", "f2", "f3", "f4"], folder)
    out = l.predict(rows, ["f1", "f2", "f3", "f4"], folder).toPandas()
    test = out[(out.part == "test") & (out.symbol != "flat")]
    for name, g in test.groupby("model"):
        assert ((g.p >= 0.5) == g.target).mean() > 0.85 and g.p.between(0, 1).all(), name
    assert set(out[out.symbol == "flat"].p) == {1.0} and set(out.model) == set(l.MODELS)
    other = rows.withColumn("symbol", F.lit("new")).limit(3)
    assert {r.p for r in l.predict(other, ["f1", "f2", "f3", "f4"], folder).collect()} == {0.5}
    holes = rows.filter("symbol = 'a'").limit(5)
    null, zero = holes.withColumn("f1", F.lit(None).cast("double")), holes.withColumn("f1", F.lit(0.0))
    key = lambda d: sorted((r.model, r.date, round(r.p, 9)) for r in l.predict(d, ["f1", "f2", "f3", "f4"], folder).collect())
    assert key(null) == key(zero)
    c = l.consensus(rows.filter("symbol = 'a'"), ["f1", "f2", "f3", "f4"], folder).first()
    assert c.votes == sum(c[m] >= 0.5 for m in l.MODELS) and abs(c.mean_odds - sum(c[m] for m in l.MODELS) / 4) < 1e-12


def test_regression_is_each_groups_own(spark):
    """The crossed regression equals Newton's steps on one group alone, whatever other groups hold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] + 0.3)))).astype(float)
    one = pd.DataFrame(x, columns=["u", "v"]).assign(model="a", train=True, y=y, w=1.0)
    two = one.assign(model="b", y=1 - y)
    odds = {}
    for rows in (one, pd.concat([one, two])):
        m = l.regression(spark.createDataFrame(rows), ["u", "v"], 0.0)
        odds[len(rows)] = [r.p for r in m.transform(spark.createDataFrame(one)).select(l.vector_to_array("odds")[1].alias("p")).collect()]
    a, b = np.column_stack([x, np.ones(400)]), np.zeros(3)
    for _ in range(20):
        p = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (y - p))
    assert np.allclose(odds[400], 1 / (1 + np.exp(-a @ b)), atol=1e-4) and np.allclose(odds[800], odds[400], atol=1e-4)


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 200).astype(float)
    y = (rng.random(200) < x / 14).astype(float)
    xs, fit = l.isotonic(x, y)
    assert (np.diff(fit) >= 0).all()
    n, mean = np.array([(x == v).sum() for v in xs]), np.array([y[x == v].mean() for v in xs])
    best = [max(min((n[i : j + 1] * mean[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    assert np.allclose(fit, best)


def test_training_sees_nothing_of_later_parts(spark, bars):
    features = f.realized_vol(bars).select("symbol", "date", "realized_vol_5d", "realized_vol_20d").na.drop()
    rows = l.with_targets(bars, features, (5,))
    by = {(r["symbol"], r["part"]): r for r in rows.groupBy("symbol", "part").agg({"date": "max"}).collect()}
    n = {r["symbol"]: r["count"] for r in features.groupBy("symbol").count().collect()}
    days = {s: sorted(r["date"] for r in features.filter(features["symbol"] == s).collect()) for s in n}
    for s in n:
        assert by[(s, "train")]["max(date)"] <= days[s][int(n[s] * 0.6) - 1 - 5]
    names = ["realized_vol_5d", "realized_vol_20d"]
    a = l.fit_predict(rows, names, ("logistic_regression",)).filter("part = 'train'").collect()
    changed = rows.withColumn("target", __import__("pyspark.sql.functions", fromlist=["when"]).expr("CASE WHEN part = 'test' THEN 1 - target ELSE target END"))
    z = l.fit_predict(changed, names, ("logistic_regression",)).filter("part = 'train'").collect()
    odds = lambda rows: {(r["symbol"], r["date"]): r["p"] for r in rows}
    assert odds(a).keys() == odds(z).keys() and all(odds(z)[k] == pytest.approx(p, abs=1e-9) for k, p in odds(a).items())
