"""Metric, set, text and lookup queries and their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions import frames
from candela.functions.frames import rounded
from candela.operators import metrics as m
from candela.operators import sequences as q
from candela.operators import text as t
from candela.plans.feature_queries import _all, _of, _positions
from candela.plans.sequence_queries import OVERLAY
from candela.plans.sql import SO_FAR, change, flag, frame, lag, mean, query, r
from candela.sources import bars as s


def _long(spark, sf_dir):
    """Invented prices jump by hundreds of percent; their tenth root moves like a price."""
    return m.long_metrics(s.brand_bars(spark, sf_dir).withColumn("close", F.pow("close", 0.1)))


def _of_table(operator, name):
    return lambda spark, sf_dir: rounded(operator(s.table(spark, sf_dir, name)))


def _returns(spark, sf_dir):
    return m.daily(s.bars(spark, sf_dir))


def _tame(spark, sf_dir):
    """Returns of invented prices, a thousandth of them, so that their product stays a number."""
    return _returns(spark, sf_dir).withColumn("r", F.col("r") / 1000)


def _benchmark(spark, sf_dir):
    rows = s.market(spark, sf_dir).withColumn("symbol", F.lit("market"))
    return rows.select("date", (frames.change("close") / 1000).alias("m"))


def _costed(spark, sf_dir):
    rows = s.trades(spark, sf_dir)
    return rows.withColumn("commission", F.lit(1.0)).withColumn("slippage", F.abs("pnl") * 0.0005)


def _lagged(spark, sf_dir):
    return m.lagged(_positions(spark, sf_dir))


def _periods(spark, sf_dir):
    return spark.createDataFrame(m.PERIODS, "period string, start string, end string, label string").select("period", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "label")


def _scored(spark, sf_dir):
    """Labels with a score that any engine can tell from the text: the share of sentences with a shout, a bar or a sign."""
    docs = s.table(spark, sf_dir, "documents")
    labels = s.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    marks = F.length("text") - F.length(F.translate("text", "!|*$%&#", ""))
    out = labels.join(docs, "doc_id").select("y", (1 / (1 + 20 * marks / F.greatest(F.length("text"), F.lit(1)))).alias("p"))
    return out.withColumn("p", F.round("p", 3)).withColumn("predicted", (F.col("p") >= 0.8).cast("int"))


def _grid(spark, sf_dir):
    """The grid of exit and re-entry parameters on every symbol; the best by excess and half of what the fall improves."""
    rows = s.bars(spark, sf_dir)
    grid = spark.createDataFrame([(f"p{b}_{int(a * 100)}_{d}", b, a, 0.1, d) for b in (2, 5, 10) for a in (0.2, 0.3, 0.5) for d in (1, 5)], "tier string, back int, leave double, enter double, days int")
    symbols = rows.select("symbol").distinct()
    params = symbols.join(grid).withColumn("name", F.concat("symbol", F.lit("|"), "tier"))
    many = rows.join(F.broadcast(params.select("symbol", "name")), "symbol").drop("symbol").withColumnRenamed("name", "symbol")
    done = q.overlay_backtest(q.roc_overlay(many, s.vix(spark, sf_dir), params.drop("symbol").withColumnRenamed("name", "symbol")))
    out = done.withColumn("base", F.substring_index("symbol", "|", 1)).withColumn("score", F.col("excess_log_return") + 0.5 * F.col("dd_improvement"))
    first = W.partitionBy("base").orderBy(F.desc(F.round("score", 9)), "tier")
    return rounded(out.withColumn("place", F.row_number().over(first)).filter("place <= 5").select(F.col("base").alias("symbol"), F.col("tier").alias("params"), "place", "score", "num_trades"))


def _common(spark, sf_dir):
    rows = s.bars(spark, sf_dir)
    n = rows.agg(F.count_distinct("symbol").alias("n"))
    return rows.groupBy("date").agg(F.count_distinct("symbol").alias("k")).join(F.broadcast(n)).filter("k = n").select("date")


def _except(spark, sf_dir):
    return s.market(spark, sf_dir).select("date").exceptAll(s.vix(spark, sf_dir).select("date"))


def _union(spark, sf_dir):
    a = s.bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))
    b = s.vix(spark, sf_dir).agg(F.lit("vix").alias("symbol"), F.count("*").alias("bars"), F.max("vix").alias("peak"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


def _resume(spark, sf_dir):
    """What is still to do: bars whose day and symbol a cache of scores lacks."""
    rows = s.bars(spark, sf_dir).select("symbol", "date", "transactions")
    return rows.join(rows.filter(F.dayofmonth("date") % 3 == 0).select("symbol", "date"), ["symbol", "date"], "left_anti")


def _upsert(spark, sf_dir):
    """A keyed cache after new rows replaced old ones: the newest by key stays."""
    rows = s.bars(spark, sf_dir)
    old = rows.select("symbol", "date", F.col("close").alias("score"), F.lit(1).alias("version"))
    new = rows.filter(F.dayofmonth("date") % 2 == 0).select("symbol", "date", F.col("open").alias("score"), F.lit(2).alias("version"))
    newest = W.partitionBy("symbol", "date").orderBy(F.desc("version"))
    return rounded(old.unionByName(new).withColumn("k", F.row_number().over(newest)).filter("k = 1").drop("k"))


def _knn(spark, sf_dir):
    rows = s.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(t.knn(rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))))


# Sectors by the first word that a description holds, in order of priority.
SECTORS = (("ring", "XLY"), ("widget", "XLI"), ("bolt", "XLI"), ("gear", "XLB"), ("red", "XLK"), ("blue", "XLF"))


def _sectors(spark, sf_dir):
    """Each part's sector by the first listed word in its name, and its tier by type, then size, then default."""
    words = spark.createDataFrame([(i, w, e) for i, (w, e) in enumerate(SECTORS)], "priority int, word string, etf string")
    parts = s.table(spark, sf_dir, "part")
    found = parts.join(F.broadcast(words), F.col("p_name").contains(F.col("word")), "left")
    return found.groupBy("p_partkey", "p_name").agg(F.coalesce(F.min_by("etf", "priority"), F.lit("SPY")).alias("etf"))


def _tiers(spark, sf_dir):
    known = spark.createDataFrame([("PROMO", "tier2"), ("ECONOMY", "tier1")], "p_type string, known string")
    parts = s.table(spark, sf_dir, "part").join(F.broadcast(known), "p_type", "left")
    by_size = F.when(F.col("p_size") >= 40, "tier3").when(F.col("p_retailprice") > 1500, "tier2")
    return parts.select("p_partkey", F.coalesce("known", by_size, F.lit("tier1")).alias("tier"), F.when(F.col("known").isNotNull(), "lookup").when(F.col("p_size") >= 40, "size").when(F.col("p_retailprice") > 1500, "price").otherwise("default").alias("classification_source"))


def _calendar(spark, sf_dir):
    """Weekdays between the first and last bar that have no bar of any symbol: the calendar's gaps, and sessions by month."""
    days = s.market(spark, sf_dir).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    out = days.join(s.market(spark, sf_dir).select("date", F.lit(1).alias("open")), "date", "left")
    return out.groupBy(F.trunc("date", "month").alias("month")).agg(F.count("*").alias("weekdays"), F.count("open").alias("sessions"))


def _micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def _limiter(spark, sf_dir):
    """Calls a user made in the minute up to each event, and whether that is over the limit."""
    events = s.table(spark, sf_dir, "events")
    over = W.partitionBy("user_id").orderBy(_micros("ts")).rangeBetween(-60_000_000, 0)
    return events.select("event_id", "user_id", F.count("*").over(over).alias("calls")).withColumn("over", (F.col("calls") > 1).cast("int"))


def _windows(spark, sf_dir):
    """Events by type in hours of event time."""
    events = s.table(spark, sf_dir, "events")
    return rounded(events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(_micros("w.start").alias("start_us"), "event_type", "n", "total"))


QUERIES = {
    "metrics_ml": _of(m.ml_metrics, lambda sp, sf: _tame(sp, sf).withColumn("position", F.dayofmonth("date") % 2), _benchmark),
    "metrics_portfolio": _of(m.portfolio_metrics, _tame, _costed),
    "sharpe_variants": _of(m.sharpe_variants, _returns),
    "trade_stats": _of(m.trade_stats, s.trades),
    "trade_cohorts_verdict": _of(m.trade_cohorts, s.trades),
    "cross_stock_aggregate": _of(m.cross_stock, _long),
    "best_model_by_category": _of(m.best_by_category, _long),
    "overfit_worst3": _of(m.overfit_worst, _long),
    "leaderboard_latest": _of(m.leaderboard, s.bars),
    "feature_importance": _of(m.importance, _long),
    "feature_pairs": _of(m.pairs, _long),
    "consistency": _of(m.consistency, _long),
    "capture_ratios": _of(m.capture, s.bars, s.market),
    "corr_buckets": _of(m.corr_buckets, s.brand_bars),
    "period_scorecard": _of(m.scorecard, _lagged, _periods),
    "grid_search_topk": _grid,
    "common_dates": _common,
    "date_except": _except,
    "union_metrics": _union,
    "resume_anti_join": _resume,
    "cache_upsert": _upsert,
    "put_call_conditional": _of_table(m.put_call, "events"),
    "tone_weighted": _of_table(m.tone, "events"),
    "volume_spikes": _of(m.volume_spikes, s.bars),
    "topic_classify": lambda sp, sf: t.topics(s.articles(sp, sf)).select("article_id", F.col("primary").alias("primary_topic"), F.array_join("secondary", ",").alias("secondary_topics")),
    "lexicon_sentiment": lambda sp, sf: rounded(t.lexicon(s.articles(sp, sf)).drop("body", "ticker", "lang")),
    "article_signal": lambda sp, sf: rounded(t.signals(s.articles(sp, sf)).select("article_id", "primary", "adjusted", "signal", "expected_return")),
    "topic_aggregate": _of(t.topic_aggregate, s.articles),
    "earnings_signal": _of(t.earnings_signal, s.articles),
    "article_top200": lambda sp, sf: t.latest(s.articles(sp, sf), "SRC0", 10).select("article_id", "ticker", F.md5(F.col("body").cast("binary")).alias("digest")),
    "html_links": _of_table(t.links, "pages"),
    "regex_extract_context": _of_table(t.verdicts, "conversations"),
    "json_props": _of_table(t.event_props, "events"),
    "chunk_documents": _of_table(t.chunks, "documents"),
    "knn_topk": _knn,
    "tier_classify": _tiers,
    "sector_resolve": _sectors,
    "classification_metrics": _of(m.classification, _scored),
    "roc_auc": _of(m.auc, _scored),
    "calendar_sessions": _calendar,
    "rate_limiter_window": _limiter,
    "event_windows": _windows,
}

RET = {"x": f"SELECT *, {change('close')} AS ret FROM bars"}
CURVE = {**RET, "y": f"SELECT *, product(1 + ret) {SO_FAR} AS cum FROM x WHERE ret IS NOT NULL", "z": f"SELECT *, cum / max(cum) {SO_FAR} - 1 AS dd FROM y"}
TAME = {"x": f"SELECT *, {change('close')} / 1000 AS ret FROM bars", "y": CURVE["y"], "z": CURVE["z"]}
MARKET = {"mk": f"SELECT date, {change('close')} AS m FROM market"}
TRADES = {"t": "SELECT c_mktsegment AS symbol, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS tier, o_orderstatus AS vol_regime, CAST(o_orderdate AS DATE) AS date, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS pnl, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT avg(o_totalprice) FROM orders) AS pnl_pct, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 30 END AS holding_days FROM orders JOIN customer ON c_custkey = o_custkey"}
_mon = "OVER (PARTITION BY symbol ORDER BY date)"
LONG = {
    "b": "SELECT symbol, date, power(close, 0.1) AS close FROM brands",
    "b0": f"SELECT symbol, date, {change('close')} AS ret, close > avg(close) {frame(3)} AS above FROM b",
    "b1": "SELECT symbol, date, ret, model, p FROM (SELECT *, 1.0::DOUBLE AS hold, CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END AS follow, CASE WHEN ret <= 0 THEN 1.0 WHEN ret > 0 THEN 0.0 END AS fade, CAST(above AS DOUBLE) AS trend FROM b0) UNPIVOT INCLUDE NULLS (p FOR model IN (hold, follow, fade, trend))",
    "b2": "SELECT symbol, model, h AS horizon, date, (CASE WHEN h = 1 THEN lag(p, 1) OVER w ELSE lag(p, 3) OVER w END) * ret AS ret FROM b1, (VALUES (1), (3)) AS v(h) WINDOW w AS (PARTITION BY symbol, model, h ORDER BY date)",
    "b3": "SELECT *, product(1 + ret) OVER w AS cum FROM b2 WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol, model, horizon ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "b4": "SELECT *, cum / max(cum) OVER (PARTITION BY symbol, model, horizon ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM b3",
    "long": "SELECT symbol, CAST(horizon AS INTEGER) AS horizon, model, arg_max(cum, date) - 1 AS total_return, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 0) AS sharpe, min(dd) AS max_dd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, 'cat' || CAST(CAST(split_part(symbol, '#', 2) AS INTEGER) % 4 AS VARCHAR) AS category FROM b4 GROUP BY 1, 2, 3",
}
BEATS = {**LONG, "hold": "SELECT symbol, horizon, total_return AS bh FROM long WHERE model = 'hold'"}
SCORED = {"sc": "SELECT quality AS y, round(1 / (1 + 20 * (length(text) - length(regexp_replace(text, '[!|*$%&#]', '', 'g'))) / greatest(length(text), 1)), 3) AS p FROM labels JOIN documents USING (doc_id)", "sp": "SELECT *, CASE WHEN p >= 0.8 THEN 1 ELSE 0 END AS g FROM sc"}


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOPIC = {
    "a0": "SELECT doc_id AS article_id, source AS ticker, text AS body FROM documents",
    "a1": "SELECT *, " + ", ".join(f"regexp_extract_all(lower(body), '{t.pattern(w)}') AS f_{n}" for n, (w, _, _) in t.TOPICS.items()) + " FROM a0",
    "a2": "SELECT *, list_filter([" + ", ".join(f"{{'topic': '{n}', 'score': len(list_distinct(f_{n})) * 0.5 + len(f_{n}) * 0.5}}" for n in t.TOPICS) + "], lambda s: s.score > 0) AS scores FROM a1",
    "a3": "SELECT *, coalesce(list_filter(scores, lambda s: s.score = list_max(list_transform(scores, lambda u: u.score)))[1].topic, 'general') AS prim FROM a2",
    "a4": "SELECT *, list_sort(list_transform(list_filter(scores, lambda s: s.score >= 1 AND s.topic <> prim), lambda s: s.topic)) AS sec FROM a3",
    "w1": "SELECT *, list_transform(list_filter(regexp_split_to_array(lower(body), '[ \\n\\t\\r]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')) AS words FROM a4",
    "w2": f"SELECT *, CAST(len(words) AS INTEGER) AS n, CAST(len(list_filter(words, lambda w: list_contains({_sql_list(t.POSITIVE)}, w))) AS INTEGER) AS pos, CAST(len(list_filter(words, lambda w: list_contains({_sql_list(t.NEGATIVE)}, w))) AS INTEGER) AS neg, CAST(len(list_filter(words, lambda w: list_contains({_sql_list(t.UNCERTAIN)}, w))) AS INTEGER) AS unc FROM w1",
    "w3": "SELECT *, CASE WHEN n > 0 THEN greatest(-1.0, least(1.0, (pos - neg) / sqrt(n))) ELSE 0.0 END AS sentiment, CASE WHEN n > 0 THEN least(1.0, unc / sqrt(n)) ELSE 0.0 END AS uncertainty FROM w2",
    "w4": "SELECT *, CASE prim " + " ".join(f"WHEN '{n}' THEN {x}" for n, (_, x, _) in t.TOPICS.items()) + " ELSE 1.0 END AS mul, CASE prim " + " ".join(f"WHEN '{n}' THEN {x}" for n, (_, _, x) in t.TOPICS.items()) + " ELSE 0.0 END AS bias FROM w3",
    "w5": "SELECT *, CAST(greatest(-1.0, least(1.0, (CASE WHEN sentiment < 0 THEN sentiment * mul ELSE sentiment * (2 - mul) END) + bias)) AS DOUBLE) AS adjusted FROM w4",
}
HIGH = ", ".join(f"'{x}'" for x in t.HIGH_SIGNAL)
_gridded = {
    "pr": "SELECT 'p' || b || '_' || CAST(CAST(a * 100 AS INTEGER) AS VARCHAR) || '_' || d AS params, b, a, d FROM (VALUES (2), (5), (10)) x(b), (VALUES (0.2::DOUBLE), (0.3), (0.5)) y(a), (VALUES (1), (5)) z(d)",
    "j0": "SELECT bars.symbol, bars.date, bars.close, vix.vix, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.date) AS i FROM bars JOIN vix ON bars.date = vix.date",
    "j1": f"SELECT *, {lag('vix', 2)} AS l2, {lag('vix', 5)} AS l5, {lag('vix', 10)} AS l10 FROM j0",
    "n": "SELECT j1.symbol AS base, pr.params, j1.symbol || '|' || pr.params AS symbol, j1.date, j1.close, j1.i, pr.b AS back, pr.a AS leave, CAST(0.1 AS DOUBLE) AS enter, pr.d AS days, coalesce((j1.vix - (CASE pr.b WHEN 2 THEN l2 WHEN 5 THEN l5 ELSE l10 END)) / (CASE pr.b WHEN 2 THEN l2 WHEN 5 THEN l5 ELSE l10 END), 0) AS roc FROM j1, pr",
    "e": OVERLAY["e"],
    "x": "SELECT n.base, n.params, n.symbol, n.date, e.move, n.close / lag(n.close) OVER w - 1 AS ret, lag(e.position) OVER w * (n.close / lag(n.close) OVER w - 1) AS st FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i WINDOW w AS (PARTITION BY n.symbol ORDER BY n.date)",
    "y": f"SELECT *, product(1 + ret) {SO_FAR} AS cr, product(1 + st) {SO_FAR} AS cs FROM x WHERE ret IS NOT NULL",
    "z": f"SELECT *, cr / max(cr) {SO_FAR} - 1 AS fr, cs / max(cs) {SO_FAR} - 1 AS fs FROM y",
    "g": "SELECT base, params, ln(arg_max(cs, date) / arg_max(cr, date)) + 0.5 * (min(fs) - min(fr)) AS score, CAST(count(*) FILTER (move = -1) AS BIGINT) AS num_trades FROM z GROUP BY 1, 2",
}

ORACLE = {
    "metrics_ml": query(
        f"SELECT symbol, {r('gr - 1', 'total_return')}, {r('power(gr, 252 / num_days) - 1', 'annualized_return')}, {r('coalesce(mean / nullif(sd, 0) * sqrt(252), 0)', 'sharpe_ratio')}, {r('max_drawdown', 'max_drawdown')}, {r('win_rate', 'win_rate')}, num_trades, num_days, {r('beta', 'beta')}, {r('power(gr, 252 / num_days) - 1 - beta * (power(mk, 252 / num_days) - 1)', 'alpha')}, {r('mk - 1', 'benchmark_return')} FROM (SELECT *, coalesce(cov / nullif(var, 0), 0) AS beta FROM g)",
        "bars", "market",
        steps={**TAME, "mk0": f"SELECT date, {change('close')} / 1000 AS m FROM market", "j": "SELECT z.*, coalesce(m, 0) AS m, day(z.date) % 2 <> coalesce(lag(day(z.date) % 2) OVER (PARTITION BY symbol ORDER BY z.date), 0) AS moved FROM z LEFT JOIN mk0 ON z.date = mk0.date", "g": "SELECT symbol, product(1 + ret) AS gr, product(1 + m) AS mk, count(*) AS num_days, avg(ret) AS mean, stddev_samp(ret) AS sd, min(dd) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, covar_samp(ret, m) AS cov, var_samp(m) AS var, CAST(count(*) FILTER (moved) AS BIGINT) AS num_trades FROM j GROUP BY symbol"},
    ),
    "metrics_portfolio": query(
        f"SELECT {r('gr - 1', 'total_return')}, {r('yr', 'annualized_return')}, {r('sd * sqrt(252)', 'volatility')}, {r('(yr - 0.02) / (sd * sqrt(252))', 'sharpe_ratio')}, {r('(yr - 0.02) / (down * sqrt(252))', 'sortino_ratio')}, {r('abs(dd)', 'max_drawdown')}, {r('yr / abs(dd)', 'calmar_ratio')}, num_trades, {_all('win_rate avg_win avg_loss profit_factor avg_trade_duration total_commission total_slippage')} FROM (SELECT *, power(gr, 252 / days) - 1 AS yr FROM g), tt",
        "bars",
        steps={
            **RET, **TRADES, "p": "SELECT 'p' AS symbol, date, avg(ret / 1000) AS ret FROM x WHERE ret IS NOT NULL GROUP BY date", "y": f"SELECT *, product(1 + ret) {SO_FAR} AS cum FROM p", "z": f"SELECT *, cum / greatest(1.0, max(cum) {SO_FAR}) - 1 AS dd FROM y",
            "g": "SELECT product(1 + ret) AS gr, count(*) AS days, stddev_pop(ret) AS sd, stddev_pop(CASE WHEN ret < 0 THEN ret END) AS down, min(dd) AS dd FROM z",
            "tt": "SELECT count(*) AS num_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl <= 0 THEN pnl END) AS avg_loss, abs(sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl <= 0 THEN pnl END)) AS profit_factor, avg(holding_days) AS avg_trade_duration, CAST(count(*) AS DOUBLE) AS total_commission, sum(abs(pnl) * 0.0005) AS total_slippage FROM t",
        },
    ),
    "sharpe_variants": query(
        f"SELECT symbol, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe_ml')}, {r('(avg(ln(1 + ret)) * 252 - 0.02) / (stddev_pop(ret) * sqrt(252))', 'sharpe_portfolio')}, {r('avg(ln(1 + ret)) * 252 / (stddev_samp(ret) * sqrt(252))', 'sharpe_detector')}, {r('avg(ln(1 + ret)) * 252 / (stddev_pop(ret) * sqrt(252))', 'sharpe_study')} FROM x GROUP BY symbol",
        "bars", steps=RET,
    ),
    "trade_stats": query(
        f"SELECT count(*) AS sample_size, CAST(count(*) FILTER (pnl > 0) AS BIGINT) AS num_winners, CAST(count(*) FILTER (pnl <= 0) AS BIGINT) AS num_losers, {r('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {r('avg(pnl_pct)', 'avg_return_pct')}, {r('sum(pnl)', 'total_pnl')}, {r('coalesce(avg(CASE WHEN pnl > 0 THEN pnl_pct END), 0)', 'avg_winner_pct')}, {r('coalesce(avg(CASE WHEN pnl <= 0 THEN pnl_pct END), 0)', 'avg_loser_pct')}, {r('avg(holding_days)', 'avg_holding_days')} FROM t",
        steps=TRADES,
    ),
    "trade_cohorts_verdict": query(
        f"SELECT symbol, tier, vol_regime, n, {r('win_rate', 'win_rate')}, {r('a', 'avg_return_pct')}, first_date, last_date, CASE WHEN n < 5 THEN 'insufficient' WHEN win_rate >= 0.6 THEN 'favorable' WHEN win_rate <= 0.4 THEN 'unfavorable' ELSE 'mixed' END AS verdict FROM g",
        steps={**TRADES, "g": "SELECT symbol, coalesce(tier, 'unknown_tier') AS tier, coalesce(vol_regime, 'unknown_vol_regime') AS vol_regime, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl_pct) AS a, min(date) AS first_date, max(date) AS last_date FROM t GROUP BY 1, 2, 3"},
    ),
    "cross_stock_aggregate": query(f"SELECT horizon, model, {r('avg(total_return)', 'mean_return')}, {r('quantile_cont(total_return, 0.5)', 'median_return')}, {r('stddev_pop(total_return)', 'std_return')}, {r('avg(sharpe)', 'mean_sharpe')}, {r('quantile_cont(sharpe, 0.5)', 'median_sharpe')}, {r('avg(max_dd)', 'mean_max_dd')}, {r('avg(win_rate)', 'mean_win_rate')}, count(*) AS num_stocks FROM long GROUP BY 1, 2", "brands", steps=LONG),
    "best_model_by_category": query(f"SELECT category, model, {r('ms', 'mean_sharpe')}, {r('beats', 'beats')} FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(ms, 9) DESC, model) AS k FROM g) WHERE k = 1", "brands", steps={**BEATS, "g": "SELECT category, model, avg(sharpe) AS ms, avg(CASE WHEN total_return > bh THEN 1.0 ELSE 0.0 END) AS beats FROM long JOIN hold USING (symbol, horizon) GROUP BY 1, 2"}),
    "overfit_worst3": query(
        f"SELECT model, symbol, {r('train', 'train')}, {r('test', 'test')}, {r('sc', 'overfit_score')}, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(sc, 9) DESC, symbol) AS k FROM (SELECT *, train - test AS sc FROM g)) WHERE k <= 3",
        "brands", steps={**LONG, "g": "SELECT model, symbol, max(CASE WHEN horizon = 1 THEN sharpe END) AS train, max(CASE WHEN horizon = 3 THEN sharpe END) AS test FROM long GROUP BY 1, 2"},
    ),
    "leaderboard_latest": query(f"SELECT symbol, date, {r('ret', 'r')}, CAST(row_number() OVER (ORDER BY ret DESC NULLS LAST, symbol) AS INTEGER) AS place FROM x WHERE date = (SELECT max(date) FROM x)", "bars", steps=RET),
    "feature_importance": query(
        f"SELECT feature, {r('avg(value)', 'mean_importance')}, {r('max(value)', 'max_importance')}, count(DISTINCT horizon) AS horizons, CASE WHEN regexp_matches(feature, 'return|sharpe') THEN 'performance' WHEN regexp_matches(feature, 'dd|drawdown') THEN 'risk' ELSE 'other' END AS category FROM u GROUP BY feature",
        "brands", steps={**LONG, "u": "SELECT horizon, feature, value FROM (SELECT horizon, abs(total_return) AS total_return, abs(sharpe) AS sharpe, abs(max_dd) AS max_dd, abs(win_rate) AS win_rate FROM long) UNPIVOT (value FOR feature IN (total_return, sharpe, max_dd, win_rate))"},
    ),
    "feature_pairs": query("SELECT p.model AS a, o.model AS b, count(*) AS n, count(DISTINCT p.symbol) AS symbols FROM g p JOIN g o ON p.symbol = o.symbol AND p.horizon = o.horizon AND p.model < o.model GROUP BY 1, 2", "brands", steps={**BEATS, "g": "SELECT long.* FROM long JOIN hold USING (symbol, horizon) WHERE model <> 'hold' AND total_return >= bh"}),
    "consistency": query(f"SELECT model, {r('po', 'positive')}, {r('st', 'stability')}, {r('pe', 'performance')}, {r('(0.4 * po + 0.3 * st + 0.3 * pe) * 100', 'consistency')} FROM (SELECT model, avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END) AS po, 1 / (1 + stddev_pop(sharpe)) AS st, least(greatest(avg(sharpe), 0), 1) AS pe FROM long GROUP BY model)", "brands", steps=LONG),
    "capture_ratios": query(
        f"SELECT symbol, {r('avg(CASE WHEN m > 0 THEN ret END) / avg(CASE WHEN m > 0 THEN m END)', 'upside_capture')}, {r('avg(CASE WHEN m < 0 THEN ret END) / avg(CASE WHEN m < 0 THEN m END)', 'downside_capture')}, {r('stddev_samp(ret) / stddev_samp(m)', 'vol_ratio')}, {r('covar_samp(ret, m) / var_pop(m)', 'beta')}, {r('corr(ret, m)', 'corr')} FROM x JOIN mk ON x.date = mk.date WHERE ret IS NOT NULL AND m IS NOT NULL GROUP BY symbol",
        "bars", "market", steps={**RET, **MARKET},
    ),
    "corr_buckets": query(
        f"SELECT bucket, count(*) AS n, {r('avg(c)', 'mean_corr')}, {r('avg(growth)', 'mean_growth')}, {r('avg(CASE WHEN growth > 0 THEN 1.0 ELSE 0.0 END)', 'win_share')} FROM (SELECT *, CASE WHEN c < 0.1 THEN 'low' WHEN c < 0.2 THEN 'medium' ELSE 'high' END AS bucket FROM g) GROUP BY bucket",
        "brands", steps={"x": f"SELECT * FROM (SELECT symbol, date, {change('close')} AS ret FROM brands) WHERE ret IS NOT NULL", "a": "SELECT date, avg(ret) AS m FROM x GROUP BY date", "g": "SELECT symbol, CASE WHEN count(*) >= 50 THEN corr(ret, m) ELSE 0 END AS c, avg(ln(1 + ret)) AS growth FROM x JOIN a USING (date) GROUP BY symbol"},
    ),
    "period_scorecard": query(
        f"SELECT label, count(*) AS n, CAST(count(*) FILTER (st > bh) AS BIGINT) AS beats, {r('avg(st)', 'avg_strategy')}, {r('avg(bh)', 'avg_hold')}, {r('avg(st - bh)', 'avg_excess')} FROM g GROUP BY label",
        "bars",
        steps={
            "pd": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}', '{c}')" for n, a, b, c in m.PERIODS) + ") AS v(period, a, b, label)",
            "x": f"SELECT *, {change('close')} AS ret, CAST(CASE WHEN close > {mean('close', 20)} THEN 1.0 ELSE 0.5 END AS DOUBLE) AS position FROM bars", "y": f"SELECT symbol, date, ret, {lag('position')} * ret AS st FROM x",
            "g": "SELECT symbol, period, label, sum(ln(1 + ret)) AS bh, sum(ln(1 + st)) AS st FROM y JOIN pd ON date BETWEEN a AND b WHERE ret IS NOT NULL GROUP BY 1, 2, 3",
        },
    ),
    "grid_search_topk": query(f"SELECT base AS symbol, params, CAST(k AS INTEGER) AS place, {r('score', 'score')}, num_trades FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY round(score, 9) DESC, params) AS k FROM g) WHERE k <= 5", "bars", "vix", steps=_gridded, recursive=True),
    "common_dates": query("SELECT date FROM bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)", "bars"),
    "date_except": query("SELECT date FROM market EXCEPT ALL SELECT date FROM vix", "market", "vix"),
    "union_metrics": query(f"SELECT symbol, count(*) AS bars, {r('sum(volume)', 'volume')}, CAST(NULL AS DOUBLE) AS peak FROM bars GROUP BY symbol UNION ALL SELECT 'vix', count(*), NULL, round(max(vix) + 3.3e-10, 6) FROM vix", "bars", "vix"),
    "resume_anti_join": query("SELECT symbol, date, transactions FROM bars WHERE day(date) % 3 <> 0", "bars"),
    "cache_upsert": query(f"SELECT symbol, date, {r('CASE WHEN day(date) % 2 = 0 THEN open ELSE close END', 'score')}, CAST(CASE WHEN day(date) % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM bars", "bars"),
    "put_call_conditional": query(
        f"SELECT date, {_all('put_volume call_volume put_oi call_oi avg_iv')}, {r('put_volume / nullif(call_volume, 0)', 'put_call_volume')}, {r('put_oi / nullif(call_oi, 0)', 'put_call_oi')} FROM g",
        steps={"x": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "g": "SELECT CAST(ts AS DATE) AS date, coalesce(sum(value) FILTER (event_type = 'error'), 0) AS put_volume, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS call_volume, CAST(coalesce(sum(k) FILTER (event_type = 'error'), 0) AS DOUBLE) AS put_oi, CAST(coalesce(sum(k) FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS call_oi, avg(k) FILTER (k > 0) AS avg_iv FROM x GROUP BY 1"},
    ),
    "tone_weighted": query(f"SELECT event_type, {r('sum(k * value) / sum(value)', 'tone')}, count(*) AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1"),
    "volume_spikes": query(
        f"SELECT symbol, num_bars, {r('av', 'avg_volume')}, {r('lv', 'latest_volume')}, {r('lv / av', 'volume_ratio')}, CAST(spikes AS INTEGER) AS spikes, CASE WHEN lv / av > 2 THEN 'very high' WHEN lv / av > 1.5 THEN 'high' WHEN lv / av > 0.8 THEN 'normal' WHEN lv / av > 0.5 THEN 'low' ELSE 'very low' END AS condition FROM g",
        "bars", steps={"x": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, avg(volume) OVER (PARTITION BY symbol) AS av0 FROM bars", "g": "SELECT symbol, count(*) AS num_bars, avg(volume) AS av, arg_max(volume, date) AS lv, count(*) FILTER (back <= 10 AND volume > 2 * av0) AS spikes FROM x GROUP BY symbol"},
    ),
    "topic_classify": query("SELECT article_id, prim AS primary_topic, coalesce(array_to_string(sec, ','), '') AS secondary_topics FROM a4", steps=TOPIC),
    "lexicon_sentiment": query(f"SELECT article_id, n, pos, neg, unc, {r('sentiment', 'sentiment')}, {r('uncertainty', 'uncertainty')} FROM w3", steps=TOPIC),
    "article_signal": query(f"SELECT article_id, prim AS primary, {r('adjusted', 'adjusted')}, CASE WHEN adjusted > 0.15 THEN 'bullish' WHEN adjusted < -0.15 THEN 'bearish' ELSE 'neutral' END AS signal, {r('adjusted * 0.02', 'expected_return')} FROM w5", steps=TOPIC),
    "topic_aggregate": query(
        f"SELECT ticker, {r('cs', 'composite_score')}, CASE WHEN cs > 0.1 THEN 'bullish' WHEN cs < -0.1 THEN 'bearish' ELSE 'neutral' END AS composite_signal, topics, CAST(mentions AS BIGINT) AS mentions, ln >= 2 AND lv < -0.2 AS litigation_alert, abs(ev) > 0.3 AS earnings_surprise FROM g",
        steps={
            **TOPIC, "f": "SELECT ticker, prim AS topic, adjusted AS v FROM w5 UNION ALL SELECT ticker, unnest(sec), adjusted * 0.5 FROM w5", "h": f"SELECT ticker, topic, avg(v) AS v, count(*) AS n, sqrt(count(*)) * CASE WHEN topic IN ({HIGH}) THEN 1.5 ELSE 1 END AS wt FROM f GROUP BY 1, 2",
            "g": "SELECT ticker, sum(v * wt) / sum(wt) AS cs, count(*) AS topics, sum(n) AS mentions, coalesce(max(CASE WHEN topic = 'litigation' THEN v END), 0) AS lv, coalesce(max(CASE WHEN topic = 'litigation' THEN n END), 0) AS ln, coalesce(max(CASE WHEN topic = 'earnings' THEN v END), 0) AS ev FROM h GROUP BY ticker",
        },
    ),
    "earnings_signal": query(
        f"SELECT ticker, total_articles, earnings_articles, {r('coalesce(ts, 0)', 'topic_sentiment')}, ts * rs > 0 AS models_agree, CASE WHEN coalesce(ts, 0) > 0.1 THEN 'bullish' WHEN coalesce(ts, 0) < -0.1 THEN 'bearish' ELSE 'neutral' END AS direction, {r('least(1.0, least(earnings_articles / 5, 1.0) * CASE WHEN ts * rs > 0 THEN 1.3 ELSE 1.0 END)', 'confidence')}, earnings_articles >= 3 AS is_tradeable FROM g",
        steps={**TOPIC, "g": "SELECT ticker, count(*) AS total_articles, CAST(count(*) FILTER (prim = 'earnings') AS BIGINT) AS earnings_articles, avg(adjusted) FILTER (prim = 'earnings') AS ts, avg(sentiment) FILTER (prim = 'earnings') AS rs FROM w5 GROUP BY ticker"},
    ),
    "article_top200": "SELECT doc_id AS article_id, source AS ticker, md5(text) AS digest FROM documents WHERE upper(source) = 'SRC0' AND doc_id >= 10 ORDER BY doc_id DESC LIMIT 200",
    "html_links": "SELECT page_id, CAST(place - 1 AS INTEGER) AS place, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS target, regexp_extract(a, '>([^<]*)</a>', 1) AS text FROM (SELECT page_id, unnest(found) AS a, generate_subscripts(found, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS found FROM pages))",
    "regex_extract_context": f"SELECT conv_id, turn, upper(role) AS role, {r('TRY_CAST(nullif(regexp_extract(text, $$(-?[0-9]+[.]?[0-9]*)$$, 1), $$$$) AS DOUBLE)', 'number')}, CASE WHEN regexp_matches(lower(text), 'buy|bullish|tion') THEN 'buy' WHEN regexp_matches(lower(text), 'sell|bearish|ung') THEN 'sell' ELSE 'hold' END AS verdict, length(text) AS n_chars FROM conversations",
    "json_props": "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k, CAST(count(*) FILTER (k IS NULL) AS BIGINT) AS missing FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1",
    "chunk_documents": "SELECT doc_id, CAST(st / 1050 AS INTEGER) AS chunk, CAST(st AS INTEGER) AS start, CAST(length(substring(text, st + 1, 1200)) AS INTEGER) AS n_chars, md5(substring(text, st + 1, 1200)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 151, 0) + 1, 1050)) AS st FROM documents WHERE text IS NOT NULL)",
    "knn_topk": f"SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, {r('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS k FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)) WHERE k <= 6",
    "tier_classify": "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'tier2' WHEN p_type = 'ECONOMY' THEN 'tier1' WHEN p_size >= 40 THEN 'tier3' WHEN p_retailprice > 1500 THEN 'tier2' ELSE 'tier1' END AS tier, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'lookup' WHEN p_size >= 40 THEN 'size' WHEN p_retailprice > 1500 THEN 'price' ELSE 'default' END AS classification_source FROM part",
    "sector_resolve": "SELECT p_partkey, p_name, CASE " + " ".join(f"WHEN contains(p_name, '{w}') THEN '{e}'" for w, e in SECTORS) + " ELSE 'SPY' END AS etf FROM part",
    "classification_metrics": query(
        f"SELECT n, tp, fp, fn, tn, {r('(tp + tn) / n', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, {r('brier', 'brier')} FROM g",
        steps={**SCORED, "g": "SELECT count(*) AS n, CAST(count(*) FILTER (y = 1 AND g = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (y <> 1 AND g = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (y = 1 AND g <> 1) AS BIGINT) AS fn, CAST(count(*) FILTER (y <> 1 AND g <> 1) AS BIGINT) AS tn, avg(power(p - y, 2)) AS brier FROM sp"},
    ),
    "roc_auc": query(f"SELECT {r('(s - np * (np + 1) / 2) / (np * nn)', 'roc_auc')}, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM g", steps={**SCORED, "k": "SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM sc", "g": "SELECT sum(CASE WHEN y = 1 THEN rk END) AS s, sum(y) AS np, sum(1 - y) AS nn FROM k"}),
    "calendar_sessions": query(
        "SELECT CAST(date_trunc('month', d.date) AS DATE) AS month, count(*) AS weekdays, count(m.date) AS sessions FROM d LEFT JOIN market m ON d.date = m.date GROUP BY 1",
        "market", steps={"d": "SELECT CAST(unnest(range((SELECT min(date) FROM market), (SELECT max(date) FROM market) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date", "d2": "SELECT 1"},
    ).replace("FROM d LEFT", "FROM (SELECT date FROM d WHERE isodow(date) <= 5) d LEFT"),
    "rate_limiter_window": "SELECT event_id, user_id, calls, CAST(CASE WHEN calls > 1 THEN 1 ELSE 0 END AS INTEGER) AS over FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS calls FROM events)",
    "event_windows": f"SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS start_us, event_type, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY 1, 2",
}
