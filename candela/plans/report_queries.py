"""Report queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import order, rounded
from candela.operators import features as f
from candela.operators import reports as p
from candela.plans import registry
from candela.plans.feature_queries import ORACLE as FEATURE_ORACLE
from candela.plans.feature_queries import _of, _positions
from candela.plans.metric_queries import LONG, TRADES, _long
from candela.plans.sql import SO_FAR, change, flag, lag, mean, query, r, std
from candela.sources import bars as s
from candela.sources.shared import new_folder


def _fundamentals(spark, sf_dir):
    """Figures of suppliers' accounts and parts stand in for a company's."""
    t = s.table(spark, sf_dir, "supplier")
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return t.select(F.col("s_name").alias("symbol"), F.when(k % 5 != 0, 5 + b / 300).alias("pe"), F.when(k % 7 != 0, b / 4000).alias("pb"), (b / 50000).alias("roe"), F.when(k % 3 != 0, b / 40000).alias("margin"), (k % 10 / 50.0).alias("revenue_growth"), (k % 9 / 30.0).alias("earnings_growth"), F.when(k % 4 != 0, (k % 200).cast("double")).alias("debt"), (1 + k % 3).cast("double").alias("liquidity"), F.when(k % 2 == 0, k % 6 / 100.0).alias("dividend"))


def _labels(spark, sf_dir):
    rows = s.bars(spark, sf_dir)
    return f.regime_labels(rows).select("symbol", "date", "regime").join(rows.select("symbol", "date", F.coalesce(f.change("close"), F.lit(0.0)).alias("r")), ["symbol", "date"])


def _events(spark, sf_dir):
    """Event dates by symbol: the first bar of each quarter."""
    return s.bars(spark, sf_dir).groupBy("symbol", F.trunc("date", "quarter").alias("q")).agg(F.min("date").alias("date")).select("symbol", "date")


def _votes(spark, sf_dir):
    rows = s.bars(spark, sf_dir).withColumn("r", f.change("close"))
    rules = F.array((F.col("r") > 0).cast("int"), (F.col("close") > F.col("open")).cast("int"), (F.col("close") > F.col("vwap")).cast("int"), F.when(F.col("transactions") > 3, (F.col("high") > 2 * F.col("low")).cast("int")))
    return rows.select("symbol", "date", F.explode(rules).alias("vote"))


DRIVERS = ["vix_level", "vix_zscore_60d", "vix_roc_5d", "vix_roc_20d", "rv_5d", "rv_20d", "spy_ret_5d", "trailing_dd_10d"]


def _drivers(spark, sf_dir):
    m, t = f.market_risk(s.market(spark, sf_dir), s.vix(spark, sf_dir)), f.market_risk_targets(s.market(spark, sf_dir))
    return rounded(p.drivers(rounded(m).join(rounded(t), "date"), "fwd_max_dd", DRIVERS))


def _marks(spark, sf_dir):
    rows = s.bars(spark, sf_dir).withColumn("place", F.row_number().over(order())).withColumn("r", f.change("close"))
    return rows.filter("r > 1").select("symbol", "date", "place")


def _decisions(spark, sf_dir):
    e = s.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit('{"action": "'), F.when(k % 3 == 0, "buy").when(k % 3 == 1, "Sell").otherwise("??"), F.lit('", "confidence": '), (k / 5.0).cast("string"), F.lit(', "size": '), (k / 50.0).cast("string"), F.lit("}")).alias("decision"))


def _risks(spark, sf_dir):
    l = s.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg((F.avg("l_discount") * 8).alias("p"), (F.avg("l_tax") * 8).alias("q"), (F.avg("l_quantity") / 60).alias("s"))


def _files(kind):
    def run(spark, sf_dir):
        rows = s.trades(spark, sf_dir).select("trade_id", "symbol", "tier", "date", F.round("pnl", 4).alias("pnl"), "holding_days")
        return rounded(p.through_files(rows, new_folder(spark, f"trades-{kind}"), kind))

    return run


def _newest(spark, sf_dir):
    """Result files written one after another; the last one is read."""
    folder = new_folder(spark, "results")
    rows = s.vix(spark, sf_dir)
    for i in (1, 2):
        rows.filter(F.year("date") == 1994 + i).select(F.lit(i).alias("run"), "date", "vix").coalesce(1).write.mode("append").parquet(folder)
    return rounded(p.newest(spark.read.parquet(folder)))


QUERIES = {
    "fundamental_scores": _of(p.fundamentals, _fundamentals),
    "event_proximity": _of(p.event_proximity, lambda sp, sf: s.bars(sp, sf).select("symbol", "date"), _events),
    "regime_segments": _of(p.segments, _labels),
    "regime_counts": _of(p.regime_counts, _labels),
    "regime_days": _of(p.regime_days, _labels),
    "vote_consensus": _of(p.consensus, _votes),
    "risk_drivers": _drivers,
    "expanding_zscore": _of(lambda v: p.expanding_z(v.withColumn("symbol", F.lit("vix")), "vix").drop("symbol"), s.vix),
    "crash_timing": _of(p.timing, _positions),
    "peak_recovery": _of(lambda b: p.recovery(b, "1996-01-01", "1998-12-31"), s.bars),
    "spaced_change_points": _of(p.spaced, _marks),
    "category_tests": _of(p.category_tests, _long),
    "decision_validate": _of(p.validated, _decisions),
    "risk_ladder": _of(p.risk_ladder, _risks),
    "jsonl_round_trip": _files("json"),
    "csv_round_trip": _files("csv"),
    "newest_file": _newest,
    "tool_registry": lambda sp, sf: rounded(registry.call(sp, sf, "bollinger_bands", {"symbol": "A"}).select("symbol", "date", "bb_upper", "bb_lower")),
}

LABELS = {
    "x": f"SELECT *, {change('close')} AS ret FROM bars", "y": f"SELECT *, {std('ret', 20)} AS sd FROM x", "k": "SELECT symbol, quantile_cont(sd, 0.33) AS a, quantile_cont(sd, 0.67) AS b FROM y GROUP BY symbol",
    "lb": "SELECT y.symbol, y.date, CAST(CASE WHEN sd < a THEN 0 WHEN sd > b THEN 2 ELSE 1 END AS INTEGER) AS regime, coalesce(ret, 0) AS r FROM y JOIN k ON y.symbol = k.symbol",
}
ORACLE = {
    "risk_drivers": query(
        f"SELECT feature, {r('c', 'corr')} FROM (SELECT * FROM g UNPIVOT (c FOR feature IN ({', '.join(DRIVERS)}))) ORDER BY round(abs(c), 9) DESC, feature LIMIT 5",
        steps={"m": FEATURE_ORACLE["market_risk_features"], "t": FEATURE_ORACLE["market_risk_targets"], "g": f"SELECT {', '.join(f'corr({n}, fwd_max_dd) AS {n}' for n in DRIVERS)} FROM m JOIN t USING (date)"},
    ),
    "fundamental_scores": query(
        f"""SELECT symbol, {r('coalesce(pe, (SELECT quantile_cont(pe, 0.5) FROM x))', 'pe_ratio')}, {r('pe / (eg * 100 + 1e-6)', 'pe_to_growth')}, {r('coalesce(roe, 0) * 10 + coalesce(margin, 0) * 10 + coalesce(rg, 0) * 5 - coalesce(debt, 100) / 100', 'quality_score')}, {r('-coalesce(pe, 0) / 20 - coalesce(pb, 0) / 3', 'valuation_score')}, {r('coalesce(liq, 1) * 0.5 + (100 - coalesce(debt, 100)) / 100', 'financial_health')},
        {flag('coalesce(dv, 0) * 100 > 2')} AS dividend_attractive, {flag('coalesce(eg, 0) > 0.15 AND coalesce(pe, 0) > 20')} AS is_growth_stock, {flag('coalesce(pe, 0) > 0 AND coalesce(pe, 0) < 15 AND coalesce(pb, 0) < 2')} AS is_value_stock FROM x""",
        steps={"x": "SELECT s_name AS symbol, CASE WHEN s_suppkey % 5 <> 0 THEN 5 + s_acctbal / 300 END AS pe, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 4000 END AS pb, s_acctbal / 50000 AS roe, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 40000 END AS margin, s_suppkey % 10 / 50.0::DOUBLE AS rg, s_suppkey % 9 / 30.0::DOUBLE AS eg, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 200 AS DOUBLE) END AS debt, CAST(1 + s_suppkey % 3 AS DOUBLE) AS liq, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 6 / 100.0::DOUBLE END AS dv FROM supplier"},
    ),
    "event_proximity": query(
        "SELECT symbol, date, CAST(nx - date AS INTEGER) AS days_to_next, CAST(date - ls AS INTEGER) AS days_since_last, CASE WHEN nx IS NULL THEN 'unknown' WHEN nx - date <= 3 THEN 'IMMINENT' WHEN nx - date <= 7 THEN 'HIGH' WHEN nx - date <= 14 THEN 'MODERATE' WHEN nx - date <= 30 THEN 'LOW' ELSE 'NONE' END AS risk, CAST(CASE WHEN date - ls <= 5 THEN 1 ELSE 0 END AS INTEGER) AS post_event_drift FROM (SELECT b.symbol, b.date, (SELECT min(e.date) FROM ev e WHERE e.symbol = b.symbol AND e.date >= b.date) AS nx, (SELECT max(e.date) FROM ev e WHERE e.symbol = b.symbol AND e.date <= b.date) AS ls FROM bars b)",
        "bars", steps={"ev": "SELECT symbol, min(date) AS date FROM bars GROUP BY symbol, date_trunc('quarter', date)"},
    ),
    "regime_segments": query(
        f"SELECT symbol, run, min(regime) AS regime, min(date) AS start, max(date) AS end, count(*) AS length, {r('avg(r)', 'mean')}, {r('stddev_pop(r)', 'std')} FROM w GROUP BY symbol, run",
        "bars", steps={**LABELS, "u": f"SELECT *, CASE WHEN regime IS DISTINCT FROM {lag('regime')} THEN 1 ELSE 0 END AS st FROM lb", "w": f"SELECT *, CAST(sum(st) {SO_FAR} AS BIGINT) AS run FROM u"},
    ),
    "regime_counts": query("SELECT coalesce(symbol, 'all') AS symbol, coalesce(CAST(regime AS VARCHAR), 'all') AS regime, count(*) AS n, min(date) AS first, max(date) AS last FROM lb GROUP BY ROLLUP (symbol, regime)", "bars", steps=LABELS),
    "regime_days": query("SELECT symbol, date, regime, CAST(row_number() OVER (PARTITION BY symbol, regime ORDER BY date) AS INTEGER) AS regime_days FROM lb", "bars", steps=LABELS),
    "vote_consensus": query(
        f"SELECT symbol, date, {r('s', 'share')}, votes, CASE WHEN s > 0.75 THEN 'STRONG UP' WHEN s >= 0.5 THEN 'WEAK UP' WHEN s >= 0.25 THEN 'WEAK DOWN' ELSE 'STRONG DOWN' END AS consensus, {r('CASE WHEN s >= 0.5 THEN s ELSE 1 - s END', 'agreement')} FROM (SELECT symbol, date, list_avg(v) AS s, CAST(list_count(v) AS BIGINT) AS votes FROM (SELECT symbol, date, [CAST(ret > 0 AS INTEGER), CAST(close > open AS INTEGER), CAST(close > vwap AS INTEGER), CASE WHEN transactions > 3 THEN CAST(high > 2 * low AS INTEGER) END] AS v FROM x))",
        "bars", steps={"x": f"SELECT *, {change('close')} AS ret FROM bars"},
    ),
    "expanding_zscore": query(f"SELECT date, {r(f'CASE WHEN count(vix) {SO_FAR} >= 20 THEN (vix - avg(vix) {SO_FAR}) / greatest(stddev_pop(vix) {SO_FAR}, 1e-4) ELSE 0 END', 'z')} FROM v", "vix", steps={"v": "SELECT 'v' AS symbol, * FROM vix"}),
    "crash_timing": query(
        f"SELECT symbol, fc AS first_crash, fr AS first_reduced, {r('hl', 'hold_loss')}, {r('sl', 'strategy_loss')}, CAST(fr - fc AS INTEGER) AS days_late, {r('1 - sl / hl', 'reduction')} FROM (SELECT symbol, min(CASE WHEN ret < -0.03 THEN date END) AS fc, min(CASE WHEN position < 0.95 THEN date END) AS fr, sum(CASE WHEN ret < 0 THEN ret END) AS hl, sum(CASE WHEN ret < 0 THEN st END) AS sl FROM y GROUP BY symbol)",
        "bars", steps={"x": f"SELECT *, {change('close')} AS ret, CAST(CASE WHEN close > {mean('close', 20)} THEN 1.0 ELSE 0.5 END AS DOUBLE) AS position FROM bars", "y": f"SELECT *, {lag('position')} * ret AS st FROM x"},
    ),
    "peak_recovery": query(
        f"SELECT l.symbol, {r('l.peak', 'peak')}, l.peak_date, {r('l.trough', 'trough')}, l.trough_date, (SELECT min(b.date) FROM bars b WHERE b.symbol = l.symbol AND b.date > l.trough_date AND b.close >= l.peak) AS recovered, {r('l.trough / l.peak - 1', 'fall')} FROM l",
        "bars",
        steps={
            "i": "SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "a": "SELECT symbol, max(close) AS peak, arg_max(date, row(close, -epoch(date))) AS peak_date FROM i GROUP BY symbol",
            "l": "SELECT i.symbol, a.peak, a.peak_date, min(i.close) AS trough, arg_min(i.date, row(i.close, i.date)) AS trough_date FROM i JOIN a ON i.symbol = a.symbol AND i.date >= a.peak_date GROUP BY 1, 2, 3",
        },
    ),
    "spaced_change_points": query(
        "SELECT symbol, date FROM e WHERE ok",
        "bars", recursive=True,
        steps={
            "x": f"SELECT symbol, date, {change('close')} AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS place FROM bars", "n": "SELECT symbol, date, place, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM x WHERE ret > 1",
            "e": "SELECT symbol, date, i, place AS taken, true AS ok FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.date, n.i, CASE WHEN n.place - e.taken >= 5 THEN n.place ELSE e.taken END, n.place - e.taken >= 5 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1",
        },
    ),
    "category_tests": query(
        f"SELECT category, model, {r('m', 'mean')}, {r('m / nullif(sd / sqrt(n), 0)', 't')}, n, {r('po', 'positive')}, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY model) >= 3 AS universal FROM (SELECT category, model, avg(sharpe) AS m, stddev_samp(sharpe) AS sd, count(*) AS n, avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END) AS po FROM long GROUP BY 1, 2)",
        "brands", steps=LONG,
    ),
    "decision_validate": query(
        f"SELECT event_id AS id, CASE WHEN k % 3 = 0 THEN 'BUY' WHEN k % 3 = 1 THEN 'SELL' ELSE 'HOLD' END AS action, {r('least(10, greatest(1, k / 5))', 'confidence')}, {r('least(1, greatest(0, k / 50))', 'size')} FROM x",
        steps={"x": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"},
    ),
    "risk_ladder": query(
        f"SELECT symbol, date, {r('a', 'any')}, {r('1 - (1 - c(p)) * (1 - c(q * 0.7)) * (1 - c(s * 0.5))', 'weighted')}, {r('least(1, greatest(0, (p - 0.2) / 0.6))', 'ramp')}, CASE WHEN a > 0.8 THEN 'EXTREME' WHEN a > 0.5 THEN 'HIGH' WHEN a > 0.25 THEN 'ELEVATED' ELSE 'LOW' END AS level FROM y".replace("c(p)", "least(1, greatest(0, p))").replace("c(q * 0.7)", "least(1, greatest(0, q * 0.7))").replace("c(s * 0.5)", "least(1, greatest(0, s * 0.5))"),
        steps={"x": "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_discount) * 8 AS p, avg(l_tax) * 8 AS q, avg(l_quantity) / 60 AS s FROM lineitem GROUP BY 1, 2", "y": "SELECT *, 1 - (1 - least(1, greatest(0, p))) * (1 - least(1, greatest(0, q))) * (1 - least(1, greatest(0, s))) AS a FROM x"},
    ),
    **{f"{k}_round_trip": query(f"SELECT trade_id, symbol, tier, date, {r('round(pnl, 4)', 'pnl')}, holding_days FROM t", steps={"t": TRADES["t"].replace("SELECT c_mktsegment", "SELECT o_orderkey AS trade_id, c_mktsegment", 1)}) for k in ("jsonl", "csv")},
    "newest_file": query(f"SELECT CAST(2 AS INTEGER) AS run, date, {r('vix', 'vix')} FROM vix WHERE year(date) = 1996", "vix"),
    "tool_registry": query(f"SELECT symbol, date, {r('m + 2 * s', 'bb_upper')}, {r('m - 2 * s', 'bb_lower')} FROM (SELECT symbol, date, {mean('close', 20)} AS m, CASE WHEN count(close) OVER w >= 20 THEN stddev_pop(close) OVER w END AS s FROM bars WHERE symbol = 'A' WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))", "bars"),
}
