"""Queries of strategies and parameter studies, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import change, rounded
from candela.operators import metrics as m
from candela.operators import sequences as q
from candela.operators import strategies as g
from candela.plans.feature_queries import _of
from candela.plans.label_queries import _tamed
from candela.plans.report_queries import LABELS, _labels
from candela.plans.sequence_queries import OVERLAY
from candela.plans.sql import change as delta
from candela.plans.sql import lag, query, r, std
from candela.sources import bars as s

SPLIT = "1997-12-31"


def _states(spark, sf_dir):
    """Regimes as both models name them, a position by the day of the month, and either kind of account."""
    rows = _labels(spark, sf_dir)
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("regime") + 1)
    rows = rows.withColumn("position", F.element_at(F.array(F.lit("flat"), F.lit("long"), F.lit("short")), F.dayofmonth("date") % 3 + 1)).withColumn("long_only", F.dayofmonth("date") % 2)
    models = F.explode(F.array(F.struct(F.lit("wasserstein").alias("model"), name(("low_vol", "medium_vol", "high_vol")).alias("regime")), F.struct(F.lit("hmm").alias("model"), name(("bearish", "sideways", "bullish")).alias("regime"))))
    return rows.select("symbol", "date", "position", "long_only", models.alias("x")).select("symbol", "date", "position", "long_only", "x.*")


def _warned(spark, sf_dir):
    """Shares of the index stand for its level and for the odds."""
    v = s.vix(spark, sf_dir)
    return v.select("date", (F.col("vix") * 3).alias("vix"), F.pmod("vix", F.lit(1.0)).alias("spike_prob"), F.pmod(F.col("vix") * 7, F.lit(1.0)).alias("calm_prob"), (F.dayofmonth("date") % 2).alias("low_vol"))


def _changed(spark, sf_dir):
    return _labels(spark, sf_dir).withColumn("old", g.lag("regime")).filter("old != regime")


def _strategy(config):
    def run(spark, sf_dir):
        rows = m.lagged(g.create(config)(_tamed(spark, sf_dir), s.vix(spark, sf_dir)))
        return rounded(rows.groupBy("symbol").agg(F.count("*").alias("days"), F.sum(F.log1p("r")).alias("hold"), F.sum(F.log1p("s")).alias("strategy")))

    return run


QUERIES = {
    "regime_actions": _of(g.actions, _states),
    "early_exit": _of(g.early_exit, _warned),
    "universal_params": _of(lambda a, b: g.universal(q.grid_search(a, b, until=SPLIT)), _tamed, s.vix),
    "around_changes": _of(g.around_changes, _changed, lambda sp, sf: _tamed(sp, sf).select("symbol", "date", change("close").alias("r"))),
    "strategy_baseline": _strategy({"type": "baseline"}),
    "strategy_vix_roc": _strategy({"type": "vix_roc", "tier": "tier2"}),
    "strategy_vix_roc_vol": _strategy({"type": "vix_roc_vol", "tier": "tier2"}),
    "trade_uids": lambda sp, sf: g.identifiers(s.trades(sp, sf).select("trade_id", "symbol", "date"), ["symbol", "date", "trade_id"]),
}

_b, _a = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"
#: The overlay of the second tier for all symbols, then returns of closes that move like prices and of the positions before.
_second = q.TIERS["tier2"]
SECOND = {
    **OVERLAY,
    "t": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'tier2', {_second.back}, {_second.leave}, {_second.enter}, {_second.days})" for k in q.TIER_OF) + ") AS t(symbol, tier, back, leave, enter, days)",
    "p": "SELECT n.symbol, n.date, power(n.close, 0.02) AS close, e.position FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i",
    "x": f"SELECT *, {delta('close')} AS ret FROM p",
    "u": f"SELECT *, {std('ret', 20)} * sqrt(252) AS v FROM x",
    "w": f"SELECT *, coalesce(least(1, greatest(0.25, 0.15 / nullif({lag('v')}, 0))), 1) AS share FROM u",
}


def _earned(position: str) -> str:
    told = f"SELECT symbol, ret, {lag(position)} * ret AS st FROM w"
    return query(f"SELECT symbol, count(*) AS days, {r('sum(ln(1 + ret))', 'hold')}, {r('sum(ln(1 + st))', 'strategy')} FROM ({told}) WHERE ret IS NOT NULL GROUP BY symbol", "bars", "vix", steps=SECOND, recursive=True)


ORACLE = {
    "strategy_vix_roc": _earned("position"),
    "strategy_vix_roc_vol": _earned("(position * share)"),
    "regime_actions": query(
        "SELECT symbol, date, model, regime, position, long_only, CASE WHEN regime IN ('low_vol', 'bullish') AND position = 'flat' THEN 'buy' WHEN regime IN ('low_vol', 'bullish') AND position = 'short' AND long_only = 0 THEN 'cover' WHEN regime IN ('high_vol', 'bearish') AND position = 'long' THEN 'sell' WHEN regime IN ('high_vol', 'bearish') AND position = 'flat' AND long_only = 0 THEN 'short' ELSE 'hold' END AS action FROM z",
        "bars",
        steps={**LABELS, "p": "SELECT symbol, date, regime AS k, ['flat', 'long', 'short'][day(date) % 3 + 1] AS position, CAST(day(date) % 2 AS INTEGER) AS long_only FROM lb", "z": "SELECT symbol, date, position, long_only, 'wasserstein' AS model, ['low_vol', 'medium_vol', 'high_vol'][k + 1] AS regime FROM p UNION ALL SELECT symbol, date, position, long_only, 'hmm', ['bearish', 'sideways', 'bullish'][k + 1] FROM p"},
    ).replace("FROM y,", "FROM z,").replace("AS action FROM z", "AS action FROM z"),
    "early_exit": query(
        f"SELECT date, {r('CAST(CASE WHEN lo = 0 THEN CASE WHEN v < 25 THEN 1.0 WHEN v < 35 THEN CASE WHEN c > 0.35 THEN 0.9 ELSE 0.85 END WHEN v < 50 THEN CASE WHEN c > 0.35 THEN 0.85 ELSE 0.75 END WHEN v < 65 THEN CASE WHEN c > 0.35 THEN 0.8 ELSE 0.7 END ELSE CASE WHEN c > 0.35 THEN 0.75 ELSE 0.65 END END WHEN sp > 0.5 THEN 0.65 ELSE 1.0 END AS DOUBLE)', 'position')}, CASE WHEN lo = 0 THEN 'HIGH_VOL' WHEN sp > 0.5 THEN 'ML_WARNING' ELSE 'NORMAL' END AS reason FROM x",
        "vix", steps={"x": "SELECT date, vix * 3 AS v, vix % 1 AS sp, (vix * 7) % 1 AS c, day(date) % 2 AS lo FROM vix"},
    ),
    "around_changes": query(
        f"SELECT symbol, date, {r('mb', 'mean_before')}, {r('ma', 'mean_after')}, {r('vb', 'vol_before')}, {r('va', 'vol_after')}, {r('ma - mb', 'momentum_shift')}, {r('va - vb', 'vol_shift')} FROM w SEMI JOIN (SELECT symbol, date FROM (SELECT *, {lag('regime')} AS old FROM lb) WHERE old <> regime) c USING (symbol, date)",
        "bars",
        steps={**LABELS, "t0": "SELECT symbol, date, power(close, 0.02) AS close FROM bars", "t": f"SELECT symbol, date, {delta('close')} AS ret FROM t0", "w": f"SELECT symbol, date, CASE WHEN count(ret) {_b} >= 5 THEN avg(ret) {_b} END AS mb, CASE WHEN count(ret) {_a} >= 5 THEN avg(ret) {_a} END AS ma, CASE WHEN count(ret) {_b} >= 5 THEN stddev_pop(ret) {_b} END AS vb, CASE WHEN count(ret) {_a} >= 5 THEN stddev_pop(ret) {_a} END AS va FROM t"},
    ),
    "strategy_baseline": query(f"SELECT symbol, count(*) AS days, {r('sum(ln(1 + ret))', 'hold')}, {r('sum(CASE WHEN old IS NOT NULL THEN ln(1 + ret) END)', 'strategy')} FROM (SELECT *, {lag('close')} AS old FROM t) WHERE ret IS NOT NULL GROUP BY symbol", "bars", steps={"t0": "SELECT symbol, date, power(close, 0.02) AS close FROM bars", "t": f"SELECT *, {delta('close')} AS ret FROM t0"}),
    "trade_uids": "SELECT o_orderkey AS trade_id, c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS date, 'trade_' || substring(sha256(c_mktsegment || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), 1, 16) AS uid FROM orders JOIN customer ON c_custkey = o_custkey",
}
