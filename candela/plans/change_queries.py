"""Queries of change-point rules, leading risk and hazards, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import change, rounded
from candela.operators import change_rules as c
from candela.operators import detectors as d
from candela.operators import wavelets as w
from candela.plans.feature_queries import _of
from candela.plans.label_queries import TREND, _tamed
from candela.plans.sequence_queries import INDEX
from candela.plans.sequence_queries import ORACLE as SEQUENCE_ORACLE
from candela.plans.sql import change as delta
from candela.plans.sql import lag, mean, query, r, roll, std
from candela.sources import bars as s

MODES = ("max", "weighted", "product")
KINDS = ("linear", "tanh", "sigmoid")


def _returns(spark, sf_dir):
    return _tamed(spark, sf_dir).select("symbol", "date", change("close").alias("r")).filter("r is not null")


def _strategies(spark, sf_dir):
    """The three rules on the same returns."""
    x, out = _returns(spark, sf_dir), None
    for name, rule in (("direction", c.by_direction), ("volatility", c.by_volatility), ("both", c.by_both)):
        one = c.earned(rule(x)).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _four(spark, sf_dir):
    """Changes on returns, log prices, rolling means and deviations."""
    bars = _tamed(spark, sf_dir)
    years = bars.groupBy("symbol").agg((F.count("*") / 252).alias("years"))
    return rounded(w.changes_by_signal(c.four_signals(bars), years))


def _full(spark, sf_dir):
    """The index of urgent orders stands for the longer term, what orders of high priority pay over others for the spread."""
    panel = s.series_panel(spark, sf_dir)
    own = lambda n, to: panel.filter(F.col("name") == n).select("date", F.col("close").alias(to))
    spreads = own("2-HIGH", "a").join(own("3-MEDIUM", "b"), "date").select("date", (F.col("a") - F.col("b")).alias("spread"))
    return c.full_leading(s.vix(spark, sf_dir), own("1-URGENT", "level"), spreads)


def _combined(spark, sf_dir):
    """The index's fraction stands for the detector's risk."""
    risks, out = _full(spark, sf_dir).select("date", F.pmod("vix", F.lit(1.0)).alias("bocpd_risk"), "leading_risk"), None
    for m in MODES:
        one = c.combined(risks, m).withColumn("mode", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _hazards(spark, sf_dir):
    x, out = d.scaled_trends(_tamed(spark, sf_dir)).select("symbol", "date", "x"), None
    for k in KINDS:
        one = c.hazards(x, k).drop("x").withColumn("kind", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 9)


QUERIES = {
    "bocpd_strategies": _strategies,
    "bocpd_change_points": _of(lambda x: c.change_points(x, "r"), _returns),
    "signal_changes": _four,
    "regime_inputs": _of(c.regime_inputs, _tamed),
    "leading_full": lambda sp, sf: rounded(_full(sp, sf)),
    "risk_combined": _combined,
    "dynamic_hazards": _hazards,
}

_Z = "OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_LEVEL = "CASE WHEN vix < 15 THEN 0 WHEN vix < 35 THEN 0.5 * (vix - 15) / 20 WHEN vix < 50 THEN 0.5 + 0.3 * (vix - 35) / 15 ELSE 0.8 + 0.2 * (1 - exp(-(vix - 50) / 20)) END"
_PACE = "CASE WHEN roc < 0 THEN 0 WHEN roc < 0.2 THEN 0.3 * roc / 0.2 WHEN roc < 0.4 THEN 0.3 + 0.4 * (roc - 0.2) / 0.2 ELSE 0.7 + 0.3 * (1 - exp(-(roc - 0.4) / 0.3)) END"
FULL = {
    **INDEX,
    "two": f"SELECT date, 0.25 * {_LEVEL} + 0.35 * {_PACE} AS part FROM v",
    "lead_": SEQUENCE_ORACLE["leading_indicators"],
    "sp": "SELECT a.date, a.close - b.close AS spread FROM panel a JOIN panel b ON a.date = b.date AND a.name = '2-HIGH' AND b.name = '3-MEDIUM'",
    "sz": f"SELECT *, CASE WHEN count(spread) {_Z} >= 20 THEN (spread - avg(spread) {_Z}) / greatest(stddev_pop(spread) {_Z}, 1e-8) ELSE 0 END AS z FROM sp",
    "raw": "SELECT v.date, v.vix, l.vix_regime, l.vix_roc, l.vix_zscore, l.risk_vix_level, l.risk_vix_roc, part, coalesce(v.vix / nullif(u.close, 0), 1) AS ratio, coalesce(z, 0) AS z FROM vix v JOIN lead_ l USING (date) JOIN two USING (date) LEFT JOIN (SELECT date, close FROM panel WHERE name = '1-URGENT') u USING (date) LEFT JOIN sz USING (date)",
    "four": "SELECT *, CASE WHEN ratio < 1 THEN 0 WHEN ratio < 1.05 THEN 0.5 * (ratio - 1) / 0.05 ELSE 0.5 + 0.5 * (1 - exp(-(ratio - 1.05) / 0.1)) END AS term, CASE WHEN z < 0 THEN 0 WHEN z < 1.5 THEN 0.3 * z / 1.5 WHEN z < 2.5 THEN 0.3 + 0.4 * (z - 1.5) ELSE 0.7 + 0.3 * (1 - exp(-(z - 2.5))) END AS credit FROM raw",
    "whole": "SELECT *, part + 0.15 * term + 0.25 * credit AS lr FROM four",
}
ORACLE = {
    "leading_full": query(f"SELECT date, {r('vix', 'vix')}, vix_regime, vix_roc, vix_zscore, {r('ratio', 'term_ratio')}, CAST(ratio > 1.05 AS INTEGER) AS term_inverted, {r('z', 'credit_zscore')}, risk_vix_level, risk_vix_roc, {r('term', 'risk_vix_term')}, {r('credit', 'risk_credit')}, {r('lr', 'leading_risk')} FROM whole", "vix", "panel", steps=FULL),
    "risk_combined": query(
        f"SELECT date, mode, {r('b', 'bocpd_risk')}, {r('lr', 'leading_risk')}, {r('risk', 'risk')}, {r('CASE WHEN lr > 0.7 THEN 0.5 ELSE 1 - 0.75 * risk END', 'position')} FROM (SELECT date, mode, b, lr, CASE mode WHEN 'max' THEN greatest(b, lr) WHEN 'weighted' THEN 0.4 * b + 0.6 * lr ELSE 1 - (1 - b) * (1 - lr) END AS risk FROM (SELECT date, vix - floor(vix) AS b, lr FROM whole), (VALUES ('max'), ('weighted'), ('product')) m(mode))",
        "vix", "panel", steps=FULL,
    ),
    "regime_inputs": query(
        "SELECT symbol, date, " + ", ".join(r(n, n) for n in "close volume returns log_returns momentum_10d momentum_20d realized_vol trend_strength hl_range volume_momentum vol_adj_returns".split()) + " FROM z WHERE momentum_20d IS NOT NULL AND realized_vol IS NOT NULL",
        "bars",
        steps={
            **TREND, "x": f"SELECT symbol, date, close, volume, {delta('close')} AS returns, ln(close / nullif({lag('close')}, 0)) AS log_returns, {delta('close', 10)} AS momentum_10d, {delta('close', 20)} AS momentum_20d FROM tb",
            "y": f"SELECT *, {std('returns', 20)} AS realized_vol, abs({mean('returns', 20)}) AS trend_strength, abs(returns) AS hl_range, {mean('volume', 20)} AS vm FROM x",
            "z": "SELECT *, (volume - vm) / (vm + 1e-10) AS volume_momentum, returns / (realized_vol + 1e-10) AS vol_adj_returns FROM y",
        },
    ),
    "dynamic_hazards": query(
        f"SELECT symbol, date, kind, {r('coalesce(1 / 252.0::DOUBLE + (1 / 42.0::DOUBLE - 1 / 252.0::DOUBLE) * CASE kind ' + chr(39).join(['WHEN ', 'linear', ' THEN (c + 3) / 6 WHEN ', 'tanh', ' THEN (tanh(c) + 1) / 2 ELSE 1 / (1 + exp(-c)) END, 1 / 126.0::DOUBLE)']), 'hazard', 9)} FROM (SELECT *, CASE WHEN z IS NOT NULL THEN least(3, greatest(-3, z)) END AS c FROM w), (VALUES ('linear'), ('tanh'), ('sigmoid')) k(kind)",
        "bars",
        steps={
            **TREND, "a": "SELECT symbol, date, t21 FROM tr WHERE t21 IS NOT NULL", "b": f"SELECT symbol, date, t21 / greatest({std('t21', 21)}, 1e-6) AS x FROM a", "c": "SELECT * FROM b WHERE x IS NOT NULL",
            "e": f"SELECT *, {std('x', 21)} AS vol FROM c", "w": f"SELECT *, (vol - {roll('avg(vol)', 'vol', 126)}) / nullif({std('vol', 126)}, 0) AS z FROM e",
        },
    ),
}
