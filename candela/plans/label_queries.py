"""Queries of labels, ladders, cleaning and summaries, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import change, order, rounded
from candela.operators import features as f
from candela.operators import labels as b
from candela.operators import metrics as m
from candela.operators import reports as p
from candela.operators import sequences as q
from candela.plans.feature_queries import _of, _positions
from candela.plans.metric_queries import LONG, _long
from candela.plans.report_queries import LABELS, _labels, _risks
from candela.plans.sequence_queries import _walk
from candela.plans.sql import ORDER, SO_FAR, flag, frame, lag, mean, query, r, roll, std
from candela.plans.sql import change as delta
from candela.sources import bars as s
from candela.sources.shared import new_folder

TAMED = 0.02


def _tamed(spark, sf_dir):
    """Bars whose closes move like prices: invented ones jump by hundreds of percent."""
    return s.bars(spark, sf_dir).withColumn("close", F.pow("close", TAMED))


def _incomplete(spark, sf_dir):
    """Bars with holes: a target and five features of which some are missing by the day of the month."""
    rows, day = s.bars(spark, sf_dir), F.dayofmonth("date")
    return rows.select("symbol", "date", F.when(day % 9 != 0, F.col("close")).alias("target"), *[F.when(day % k != 0, F.col(c)).alias(c) for k, c in ((2, "open"), (3, "high"), (5, "low"), (7, "volume"), (11, "vwap"))])


def _told(spark, sf_dir):
    bars = s.bars(spark, sf_dir)
    bands = f.bollinger(bars).select("symbol", "date", F.col("bb_upper").alias("upper"), F.col("bb_lower").alias("lower"))
    rows = bars.select("symbol", "date", "close").join(bands, ["symbol", "date"]).join(f.rsi(bars).select("symbol", "date", "rsi"), ["symbol", "date"])
    return rows.withColumn("histogram", change("close"))


def _regimes(spark, sf_dir):
    t = b.trend_features(_tamed(spark, sf_dir))
    risk = _risks(spark, sf_dir).select("symbol", "date", F.col("p").alias("risk"))
    return b.regimes(t.join(risk, ["symbol", "date"]))


def _levels(spark, sf_dir):
    rows = _risks(spark, sf_dir)
    return b.risk_levels(rows.select("symbol", "date", "p", F.col("q").alias("rv_5"), F.col("s").alias("rv_20")))


def _ladder(spark, sf_dir):
    rows = _positions(spark, sf_dir).select("symbol", "date", (F.col("position") == 1).cast("int").alias("inside"), F.dayofmonth("date").alias("d"))
    return b.portfolio_ladder(rows.select("symbol", "date", "inside", ((F.col("inside") == 0) & (F.col("d") % 5 == 0)).cast("int").alias("leaves")), s.vix(spark, sf_dir))


def _agreement(spark, sf_dir):
    rows = _labels(spark, sf_dir)
    falls = F.when(F.col("r") < -0.2, 0).when(F.col("r") > 0.2, 2).otherwise(1)
    return b.agreement(rows.select("symbol", "date", F.col("regime").alias("state")), rows.select("symbol", "date", falls.alias("state")))


def _assets(spark, sf_dir):
    """Parts as assets: their type is a sector, their price stands for beta and size, each missing for some."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    rows = s.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("sector"), F.when(k % 3 != 0, price / 1000).alias("beta"), F.when(k % 5 != 0, price * 4e8).alias("cap"))
    known = spark.createDataFrame([("1", "tier3"), ("2", "tier2"), ("30", "tier1")], "name string, tier string")
    sectors = spark.createDataFrame([("PROMO", "tier2"), ("ECONOMY", "tier1")], "sector string, tier string")
    return b.tiers(rows, known, sectors)


def _probs(spark, sf_dir):
    """Odds of a change stand for those of a detector: the size of a return against 1."""
    rows = s.bars(spark, sf_dir).withColumns({"place": F.row_number().over(order()), "x": F.abs(change("close"))})
    return rows.filter("x is not null").select("symbol", "date", "place", (F.col("x") / (1 + F.col("x"))).alias("p"))


def _summary(spark, sf_dir):
    return b.regime_summary(_probs(spark, sf_dir), p.segments(_labels(spark, sf_dir)).select("symbol", "run"))


def _growth(spark, sf_dir):
    from candela.plans.feature_queries import _quarters

    return f.quarterly_growth(_quarters(spark, sf_dir))


def _matched(spark, sf_dir):
    """Scores of the shorter horizon as training, of the longer as back-test, matched as if of one horizon."""
    long = _long(spark, sf_dir).withColumnRenamed("sharpe", "score").select("symbol", "horizon", "model", "score")
    train, test = long.filter("horizon = 1"), long.filter("horizon = 3").withColumn("horizon", F.lit(1)).filter("model != 'fade'")
    return b.train_and_test(train, test)


def _scored(spark, sf_dir):
    return s.bars(spark, sf_dir).select(F.col("close").alias("y"), F.col("vwap").alias("p"))


def _observed(spark, sf_dir):
    """Series as text with missing values as points."""
    rows = s.series_panel(spark, sf_dir)
    return rows.select("name", "date", F.when(F.dayofmonth("date") % 2 == 0, ".").otherwise(F.round("close", 3).cast("string")).alias("value"))


def _bodies(spark, sf_dir):
    rows = s.bars(spark, sf_dir).groupBy("symbol", F.year("date").alias("y")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string"), F.struct(F.round("open", 4).alias("open"), F.round("close", 4).alias("close")))))).alias("m"))
    return rows.select(F.concat("symbol", F.lit("-"), F.col("y").cast("string")).alias("symbol"), F.to_json("m").alias("body"))


def _json_states(spark, sf_dir):
    rows = s.trades(spark, sf_dir).select("trade_id", "date", F.col("vol_regime").alias("status"), "tier", "holding_days")
    return b.states_through_json(rows, "trade_id long, date date, status string, tier string, holding_days long")


def _cache(spark, sf_dir):
    """Bars written by symbol as a partitioned cache; a read of one symbol takes its folder alone."""
    folder = new_folder(spark, "bars")
    s.bars(spark, sf_dir).write.partitionBy("symbol").parquet(folder)
    return rounded(spark.read.parquet(folder).filter("symbol = 'A'").select("symbol", "date", "close"))


def _sinks(spark, sf_dir):
    """Summary and curve of each symbol written as CSV and JSON, read back and joined."""
    folder = new_folder(spark, "results")
    curve = f.equity_curve(_tamed(spark, sf_dir)).select("symbol", "date", F.round("equity", 5).alias("equity"))
    curve.write.option("header", True).csv(f"{folder}/curve")
    curve.groupBy("symbol").agg(F.count("*").alias("days"), F.max("equity").alias("peak")).write.json(f"{folder}/summary")
    read = spark.read.schema("symbol string, date date, equity double").option("header", True).csv(f"{folder}/curve")
    said = spark.read.schema("symbol string, days long, peak double").json(f"{folder}/summary")
    return rounded(read.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("equity", "date").alias("equity")).join(said, "symbol"))


def _lines(spark, sf_dir):
    rows = s.table(spark, sf_dir, "documents")
    return b.summary_line(rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), (F.col("doc_id") / 7).alias("value"), F.regexp_replace("text", r"[^a-zA-Z ]", "").alias("text")))


def _moments(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    iso, ms, named = F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z")), (F.unix_date("d").cast("long") * 86_400_000).cast("string"), F.concat(F.date_format("d", "MMM-dd-yy"), F.lit(" 12:30PM"))
    return b.times(o.select("id", F.when(F.col("id") % 4 == 0, iso).when(F.col("id") % 4 == 1, ms).when(F.col("id") % 4 == 2, named).otherwise("soon").alias("moment")))


def _cleaned(spark, sf_dir):
    """Documents with an escaped surrogate and an invalid byte put in."""
    rows = s.table(spark, sf_dir, "documents")
    broken = F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xff\\ud835")))
    return rows.select("doc_id", F.md5(b.clean(broken.cast("string")).cast("binary")).alias("digest"))


QUERIES = {
    "complete_rows": _of(lambda x: b.complete(x, "target", ["open", "high", "low", "volume", "vwap"]), _incomplete),
    "pruned_columns": _of(lambda x: b.pruned(x, ["vwap", "transactions", "no_such_column"]), s.bars),
    "trend_features": _of(b.trend_features, _tamed),
    "regime_rules": _of(lambda x: x, _regimes),
    "condition_labels": _of(b.conditions, _told),
    "risk_levels": _of(lambda x: x, _levels),
    "portfolio_ladder": _of(lambda x: x, _ladder),
    "regime_agreement": _of(lambda x: x, _agreement),
    "asset_tiers": _assets,
    "tail_rates": _of(b.tail_rates, _tamed),
    "garman_klass": _of(b.garman_klass, s.bars),
    "recent_regime_changes": _of(b.recent_changes, _labels),
    "quantile_change_points": _of(lambda x: p.spaced(b.above_quantile(x)), _probs),
    "regime_summary": _of(lambda x: x, _summary),
    "growth_averages": _of(b.growth_averages, _growth),
    "feature_frequency": _of(b.feature_frequency, _long),
    "sector_performance": _of(b.sector_performance, _long),
    "winners_losers": _of(b.winners_and_losers, _long),
    "sector_best": _of(b.sector_best, _long),
    "best_by_horizon": _of(b.best_by_horizon, _long),
    "low_importance": _of(lambda x: b.low_importance(m.importance(x), 0.5), _long),
    "train_test_match": _of(lambda x: x, _matched),
    "regression_metrics": _of(b.regression_metrics, _scored),
    "position_exposure": _of(b.exposure, _positions),
    "typical_bars": _of(b.typical, s.bars),
    "latest_observations": _of(b.latest_observations, _observed),
    "term_spread": _of(lambda x: b.spread(b.latest_observations(x), "1-URGENT", "5-LOW"), _observed),
    "daily_map_json": _of(b.daily_map, _bodies),
    "previous_close": _of(b.previous_close, s.bars),
    "state_round_trip": _json_states,
    "half_even_rounding": _of(lambda x: b.half_even(x.select("o_orderkey", (F.col("o_orderkey") / 8).alias("x")), "x", 2), lambda sp, sf: s.table(sp, sf, "orders")),
    "clean_text": _cleaned,
    "summary_lines": _lines,
    "parsed_times": _moments,
    "bars_cache": _cache,
    "result_sinks": _sinks,
}

T = {"tb": f"SELECT symbol, date, open, high, low, power(close, {TAMED}) AS close, volume FROM bars"}
TREND = {
    **T, "lr": "SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM tb",
    "tr": f"SELECT symbol, date, {roll('sum(lr)', 'lr', 21)} AS t21, {roll('sum(lr)', 'lr', 63)} AS t63, {std('lr', 21)} * sqrt(252) AS vol FROM lr",
}
RISKS = {"rk": "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_discount) * 8 AS p, avg(l_tax) * 8 AS q, avg(l_quantity) / 60 AS s FROM lineitem GROUP BY 1, 2"}
_head = "CASE WHEN n.risk IS NULL OR n.t21 IS NULL OR n.t63 IS NULL THEN 'consolidation' WHEN (n.vol >= 0.4 AND n.t21 <= 0.05) OR (n.vol >= 0.35 AND n.risk >= 0.75 AND n.t21 <= 0.03) OR n.t21 <= -0.2 OR (n.t21 <= -0.12 AND n.vol >= 0.3) THEN 'crisis'"
_tail = (
    " WHEN n.t63 <= -0.08 OR (n.t63 <= -0.03 AND (n.t21 <= -0.01 OR n.risk >= 0.5)) OR (n.risk >= 0.5 AND n.t21 <= -0.05) OR (n.vol >= 0.22 AND n.t21 <= -0.01) OR (n.risk >= 0.5 AND n.t21 <= -0.01) THEN 'bear'"
    " WHEN (n.t63 >= 0.02 AND n.risk <= 0.3 AND n.vol < 0.22) OR (n.t63 >= 0.06 AND n.risk < 0.5) OR (n.t63 >= 0.02 AND n.t21 >= 0.01 AND n.risk < 0.5) OR (n.risk <= 0.3 AND n.t21 >= 0.01 AND n.t63 >= 0) OR (n.vol <= 0.15 AND n.t21 >= 0.01 AND n.t63 >= 0.02) THEN 'bull'"
    " WHEN (n.vol >= 0.22 AND n.t21 >= 0.01 AND n.t63 > -0.03) OR (n.risk >= 0.5 AND n.t21 >= 0.01) OR (n.risk >= 0.35 AND n.t21 >= 0.01 AND n.t63 >= 0.02) OR (n.t21 >= 0.01 AND n.t63 > -0.03 AND n.risk > 0.3) THEN 'bull_transition'"
    " WHEN (n.risk >= 0.5 AND n.t21 < 0.01 AND n.t63 > -0.03) OR (n.t21 <= -0.01 AND n.t63 > -0.03 AND n.t63 < 0.02) OR (n.risk >= 0.35 AND n.t21 <= -0.01) THEN 'bear_transition' ELSE 'consolidation' END"
)
_again = " WHEN e.regime IN ('bear', 'crisis', 'bear_transition') AND n.t21 >= 0.01 AND n.risk >= 0.5 THEN 'bull_transition'"
COMBO = {
    **LONG, "cr": "SELECT *, model || '+h' || horizon AS combo FROM long",
    "best": "SELECT combo, avg(sharpe) AS s FROM cr GROUP BY combo ORDER BY round(avg(sharpe), 9) DESC, combo LIMIT 5", "top": "SELECT cr.*, best.s FROM cr JOIN best USING (combo)",
}
PROBS = {"x": f"SELECT symbol, date, row_number() {ORDER} AS place, abs({delta('close')}) AS x FROM bars", "pb": "SELECT symbol, date, place, x / (1 + x) AS p FROM x WHERE x IS NOT NULL"}
SEEN = {"ob": "SELECT name, date, CASE WHEN day(date) % 2 = 0 THEN NULL ELSE round(close, 3) END AS v FROM panel", "lt": "SELECT name, arg_max(v, date) FILTER (v IS NOT NULL) AS latest, max(date) FILTER (v IS NOT NULL) AS latest_date, count(*) AS n FROM ob GROUP BY name"}
_winner = "SELECT *, '{side}' AS side FROM (SELECT * FROM g ORDER BY round(a, 9) {way}, symbol LIMIT 6)"
_z = "(z.z * (v - avg(v) {f}) / greatest(stddev_pop(v) {f}, 1e-10))".format(f=frame(20))

ORACLE = {
    "complete_rows": query(
        f"SELECT symbol, date, {', '.join(r(c, c) for c in ('target', 'open', 'high', 'low', 'volume', 'vwap'))} FROM x WHERE target IS NOT NULL AND (open IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low IS NOT NULL)::INT + (volume IS NOT NULL)::INT + (vwap IS NOT NULL)::INT >= 4",
        "bars", steps={"x": "SELECT symbol, date, CASE WHEN day(date) % 9 <> 0 THEN close END AS target, CASE WHEN day(date) % 2 <> 0 THEN open END AS open, CASE WHEN day(date) % 3 <> 0 THEN high END AS high, CASE WHEN day(date) % 5 <> 0 THEN low END AS low, CASE WHEN day(date) % 7 <> 0 THEN volume END AS volume, CASE WHEN day(date) % 11 <> 0 THEN vwap END AS vwap FROM bars"},
    ),
    "pruned_columns": query(f"SELECT symbol, date, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars", "bars"),
    "trend_features": query(f"SELECT symbol, date, {r('t21', 'trend_21')}, {r('t63', 'trend_63')}, {r('vol', 'volatility')} FROM tr", "bars", steps=TREND),
    "regime_rules": query(
        "SELECT symbol, date, regime FROM e", "bars", recursive=True,
        steps={**TREND, **RISKS, "n": f"SELECT tr.symbol, tr.date, p AS risk, t21, t63, vol, row_number() OVER (PARTITION BY tr.symbol ORDER BY tr.date) AS i FROM tr JOIN rk ON tr.symbol = rk.symbol AND tr.date = rk.date", "e": f"SELECT n.symbol, n.date, n.i, {_head}{_tail} AS regime FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.date, n.i, {_head}{_again}{_tail} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1"},
    ),
    "risk_levels": query(
        f"SELECT symbol, date, CASE WHEN p < 0.15 THEN 'LOW' WHEN p < 0.3 THEN 'MODERATE' WHEN p < 0.5 THEN 'ELEVATED' WHEN p < 0.7 THEN 'HIGH' ELSE 'EXTREME' END AS risk_level, CASE WHEN q / nullif(s, 0) > 1.2 THEN 'RISING' WHEN q / nullif(s, 0) < 0.8 THEN 'FALLING' ELSE 'STABLE' END AS vol_trend, {r('CAST(CASE WHEN p < 0.15 THEN 1.0 WHEN p < 0.3 THEN 0.85 WHEN p < 0.5 THEN 0.65 WHEN p < 0.7 THEN 0.4 ELSE 0.2 END AS DOUBLE)', 'position_pct')}, {r('CAST(CASE WHEN p < 0.15 THEN 1.0 WHEN p < 0.3 THEN 1.2 WHEN p < 0.5 THEN 1.4 WHEN p < 0.7 THEN 1.7 ELSE 2.0 END AS DOUBLE)', 'stop_multiple')} FROM rk",
        steps=RISKS,
    ),
    "portfolio_ladder": query(
        "SELECT date, CAST(exits AS BIGINT) AS exits, CAST(o AS BIGINT) AS out, CASE WHEN exits > 0 THEN 'HIGH' WHEN o > n // 2 THEN 'ELEVATED' WHEN vix > 25 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM g LEFT JOIN vix USING (date)",
        "bars", "vix", steps={"x": f"SELECT symbol, date, CASE WHEN close > {mean('close', 20)} THEN 1 ELSE 0 END AS inside FROM bars", "g": "SELECT date, sum(CASE WHEN inside = 0 AND day(date) % 5 = 0 THEN 1 ELSE 0 END) AS exits, sum(1 - inside) AS o, count(*) AS n FROM x GROUP BY date"},
    ),
    "regime_agreement": query("SELECT symbol, date, a, b, a + b = 2 AS agreement, CASE WHEN a + b = 2 THEN 'HIGH' ELSE 'LOW' END AS confidence_level FROM (SELECT symbol, date, regime AS a, CAST(CASE WHEN r < -0.2 THEN 0 WHEN r > 0.2 THEN 2 ELSE 1 END AS INTEGER) AS b FROM lb)", "bars", steps=LABELS),
    "asset_tiers": query(
        "SELECT name, CASE WHEN name = '1' THEN 'tier3' WHEN name = '2' THEN 'tier2' WHEN name = '30' THEN 'tier1' WHEN sector = 'PROMO' THEN 'tier2' WHEN sector = 'ECONOMY' THEN 'tier1' WHEN beta > 1.3 THEN 'tier2' WHEN beta IS NOT NULL THEN 'tier1' WHEN cap > 500e9 THEN 'tier3' ELSE 'tier1' END AS tier, CASE WHEN name IN ('1', '2', '30') THEN 'predefined' WHEN sector IN ('PROMO', 'ECONOMY') THEN 'sector' WHEN beta IS NOT NULL THEN 'beta' WHEN cap > 500e9 THEN 'market_cap' ELSE 'default' END AS classification_source FROM x",
        steps={"x": "SELECT CAST(p_partkey AS VARCHAR) AS name, p_type AS sector, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice / 1000 END AS beta, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * 4e8 END AS cap FROM part"},
    ),
    "tail_rates": query(
        f"SELECT symbol, date, {r(f'CASE WHEN count(z.z) {frame(20)} >= 20 THEN avg(CASE WHEN abs(z.z) > 2 THEN 1.0 ELSE 0.0 END) {frame(20)} ELSE 0 END', 'tail_rate')}, {r(f'CASE WHEN count(z.z) {frame(20)} >= 20 THEN avg(CASE WHEN z.z < 0 THEN 1.0 ELSE 0.0 END) {frame(20)} ELSE 0 END', 'downside_freq')}, {r(f'CASE WHEN count(z.z) {frame(20)} >= 20 AND max(v) {frame(20)} > min(v) {frame(20)} THEN {_z} ELSE 0 END', 'volume_cond_ret')}, {r(f'CASE WHEN count(z.z) {frame(20)} >= 20 AND max(h) {frame(20)} > min(h) {frame(20)} THEN (h - avg(h) {frame(20)}) / greatest(stddev_pop(h) {frame(20)}, 1e-8) ELSE 0 END', 'range_vol_z')} FROM z",
        "bars", steps={**T, "x": f"SELECT symbol, date, ln({delta('close')} + 1) AS ret, ln(volume) AS v, ln(high / low) AS h FROM tb", "z": f"SELECT symbol, date, v, h, coalesce((ret - avg(ret) {SO_FAR}) / nullif(stddev_pop(ret) {SO_FAR}, 0), 0) AS z FROM x WHERE ret IS NOT NULL"},
    ),
    "garman_klass": query(
        f"SELECT symbol, date, {r('sqrt(CASE WHEN least(open, high, low, close) > 0 AND high > low THEN greatest(0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open), 1e-8) ELSE 1e-8 END)', 'garman_klass')}, {r('CASE WHEN high - low >= 1e-8 THEN (2 * close - high - low) / (high - low) ELSE 0 END', 'clv')} FROM bars",
        "bars",
    ),
    "recent_regime_changes": query(
        "SELECT symbol, date, regime FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM c) WHERE k <= 5",
        "bars", steps={**LABELS, "t": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM lb) WHERE back <= 60", "c": f"SELECT * FROM (SELECT *, {lag('regime')} AS old FROM t) WHERE old IS NULL OR old <> regime"},
    ),
    "quantile_change_points": query(
        "SELECT symbol, date FROM e WHERE ok", "bars", recursive=True,
        steps={
            **PROBS, "n": "SELECT pb.symbol, date, place, row_number() OVER (PARTITION BY pb.symbol ORDER BY date) AS i FROM pb JOIN (SELECT symbol, quantile_cont(p, 0.95) AS q FROM pb GROUP BY symbol) u ON u.symbol = pb.symbol WHERE p > q",
            "e": "SELECT symbol, date, i, place AS taken, true AS ok FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.date, n.i, CASE WHEN n.place - e.taken >= 5 THEN n.place ELSE e.taken END, n.place - e.taken >= 5 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1",
        },
    ),
    "regime_summary": query(
        f"SELECT g.symbol, n_observations, {r('a', 'avg_change_prob')}, {r('b', 'max_change_prob')}, k AS n_regimes, k - 1 AS n_changepoints FROM (SELECT symbol, count(*) AS n_observations, avg(p) AS a, max(p) AS b FROM pb GROUP BY symbol) g JOIN (SELECT symbol, count(*) AS k FROM (SELECT symbol, regime, {lag('regime')} AS old FROM lb) WHERE old IS NULL OR old <> regime GROUP BY symbol) c ON g.symbol = c.symbol",
        "bars", steps={**LABELS, "x2": PROBS["x"], "pb": PROBS["pb"].replace("FROM x", "FROM x2")},
    ),
    "growth_averages": query(
        f"SELECT symbol, {r('avg((value - a) / nullif(abs(a), 0))', 'avg_qoq_growth')}, {r('avg((value - b) / nullif(abs(b), 0))', 'avg_yoy_growth')}, count((value - a) / nullif(abs(a), 0)) AS quarters FROM y GROUP BY symbol",
        steps={"x": "SELECT o_orderpriority AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2", "y": "SELECT *, lag(value) OVER (PARTITION BY symbol ORDER BY quarter) AS a, lag(value, 4) OVER (PARTITION BY symbol ORDER BY quarter) AS b FROM x"},
    ),
    "feature_frequency": query(
        f"SELECT feature, count(*) AS appearances, {r('avg(s)', 'avg_sharpe_when_present')}, array_to_string(list_sort(list(combo))[1:3], ' | ') AS example_combos, {r('round(count(*) / 5 * 100, 1)', 'frequency_pct')} FROM (SELECT combo, s, unnest(string_split(combo, '+')) AS feature FROM best) GROUP BY feature",
        "brands", steps=COMBO,
    ),
    "sector_performance": query(f"SELECT category, {r('avg(sharpe)', 'avg_sharpe')}, {r('stddev_pop(sharpe)', 'sharpe_std')}, {r('avg(max_dd)', 'avg_drawdown')}, count(*) AS samples FROM top GROUP BY category", "brands", steps=COMBO),
    "winners_losers": query(
        f"SELECT symbol, category, {r('a', 'avg_sharpe')}, {r('best', 'best')}, {r('worst', 'worst')}, {r('a / (sd + 0.01)', 'consistency')}, side FROM ({_winner.format(side='winner', way='DESC')} UNION ALL {_winner.format(side='loser', way='ASC')})",
        "brands", steps={**COMBO, "g": "SELECT symbol, category, avg(sharpe) AS a, max(sharpe) AS best, min(sharpe) AS worst, stddev_pop(sharpe) AS sd FROM top GROUP BY 1, 2"},
    ),
    "sector_best": query(f"SELECT category, combo, {r('a', 'avg_sharpe')}, {r('d', 'avg_drawdown')} FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(a, 9) DESC, combo) AS k FROM (SELECT category, combo, avg(sharpe) AS a, avg(max_dd) AS d FROM cr GROUP BY 1, 2)) WHERE k = 1", "brands", steps=COMBO),
    "best_by_horizon": query(f"SELECT horizon, model, count(*) AS wins, {r('avg(sharpe)', 'mean_sharpe')}, {r('max(total_return)', 'best_return')} FROM (SELECT *, row_number() OVER (PARTITION BY horizon, symbol ORDER BY round(sharpe, 9) DESC, model) AS k FROM long) WHERE k = 1 GROUP BY 1, 2", "brands", steps=LONG),
    "low_importance": query(
        f"SELECT feature, {r('a', 'mean_importance')} FROM (SELECT *, max(a) OVER () AS top FROM (SELECT feature, avg(value) AS a FROM u GROUP BY feature)) WHERE a < 0.5 * top",
        "brands", steps={**LONG, "u": "SELECT feature, value FROM (SELECT abs(total_return) AS total_return, abs(sharpe) AS sharpe, abs(max_dd) AS max_dd, abs(win_rate) AS win_rate FROM long) UNPIVOT (value FOR feature IN (total_return, sharpe, max_dd, win_rate))"},
    ),
    "train_test_match": query(f"SELECT a.symbol, a.horizon, a.model, {r('a.sharpe', 'train_score')}, {r('b.sharpe', 'test_score')}, {r('a.sharpe - b.sharpe', 'overfit_score')} FROM long a JOIN long b ON a.symbol = b.symbol AND a.model = b.model AND a.horizon = 1 AND b.horizon = 3 WHERE a.model <> 'fade'", "brands", steps=LONG),
    "regression_metrics": query(f"SELECT count(*) AS n, {r('sqrt(avg(power(close - vwap, 2)))', 'rmse')}, {r('avg(abs(close - vwap))', 'mae')}, {r('1 - sum(power(close - vwap, 2)) / (var_pop(close) * count(*))', 'r2')} FROM bars", "bars"),
    "position_exposure": query(
        f"SELECT symbol, {r('avg(CASE WHEN position > 0.5 THEN 1.0 ELSE 0.0 END)', 'time_in_market')}, {r('avg(position)', 'avg_position')}, CAST(count(*) FILTER (abs(position - old) > 0.1) AS BIGINT) AS num_trades FROM (SELECT *, {lag('position')} AS old FROM x) GROUP BY symbol",
        "bars", steps={"x": f"SELECT symbol, date, CAST(CASE WHEN close > {mean('close', 20)} THEN 1.0 ELSE 0.5 END AS DOUBLE) AS position FROM bars"},
    ),
    "typical_bars": query(f"SELECT symbol, date, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))}, {r('(high + low + close) / 3', 'vwap')}, CAST(0 AS BIGINT) AS transactions FROM bars", "bars"),
    "latest_observations": query(f"SELECT name, {r('latest', 'latest')}, latest_date, n AS count FROM lt", "panel", steps=SEEN),
    "term_spread": query(f"SELECT {r(chr(40) + 'SELECT latest FROM lt WHERE name = ' + chr(39) + '1-URGENT' + chr(39) + ') - (SELECT latest FROM lt WHERE name = ' + chr(39) + '5-LOW' + chr(39) + ')', 'term_spread')}", "panel", steps=SEEN),
    "daily_map_json": query(f"SELECT symbol || '-' || y AS symbol, {r('a', 'first_close')}, {r('b', 'last_close')}, n AS num_bars, {r('(b / a - 1) * 100', 'change_pct')} FROM (SELECT symbol, year(date) AS y, round(arg_min(close, date), 4) AS a, round(arg_max(close, date), 4) AS b, count(*) AS n FROM bars GROUP BY 1, 2)", "bars"),
    "previous_close": query(
        f"SELECT symbol, {r('c', 'close')}, {r('b', 'prev_close')}, splits, coalesce(array_to_string(list_reverse_sort(days)[1:3], ','), '') AS latest_splits, {r('c - b', 'change')} FROM (SELECT symbol, arg_max(close, date) AS c, arg_max(old, date) AS b, CAST(count(*) FILTER (close < old / 2) AS BIGINT) AS splits, list(CAST(date AS VARCHAR)) FILTER (close < old / 2) AS days FROM (SELECT *, {lag('close')} AS old FROM bars) GROUP BY symbol)",
        "bars",
    ),
    "state_round_trip": "SELECT o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS tier, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 30 END AS holding_days FROM orders JOIN customer ON c_custkey = o_custkey",
    "half_even_rounding": f"SELECT o_orderkey, {r('CAST(round_even(CAST(o_orderkey AS DECIMAL(18, 3)) / 8, 2) AS DOUBLE)', 'x')} FROM orders",
    "clean_text": "SELECT doc_id, md5(text) AS digest FROM documents",
    "summary_lines": "SELECT doc_id AS id, upper(lang) || ' ' || printf('%.2f', doc_id / 7) || ' ' || CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '...' ELSE t END AS line FROM (SELECT *, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t FROM documents)",
    "parsed_times": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN epoch(CAST(o_orderdate AS DATE))::BIGINT WHEN o_orderkey % 4 = 2 THEN epoch(CAST(o_orderdate AS DATE))::BIGINT + 45000 + CASE WHEN year(o_orderdate) < 2000 THEN epoch(CAST(o_orderdate AS DATE) + INTERVAL 100 YEAR)::BIGINT - epoch(CAST(o_orderdate AS DATE))::BIGINT ELSE 0 END END AS seconds FROM orders",
    "bars_cache": query(f"SELECT symbol, date, {r('close', 'close')} FROM bars WHERE symbol = 'A'", "bars"),
    "result_sinks": query(f"SELECT symbol, max(date) AS date, {r('arg_max(round(eq, 5), date)', 'equity')}, count(*) AS days, {r('max(round(eq, 5))', 'peak')} FROM (SELECT symbol, date, close / first_value(close) {ORDER} AS eq FROM tb) GROUP BY symbol", "bars", steps=T),
}
ORACLE["condition_labels"] = query(
    "SELECT symbol, date, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' WHEN rsi IS NOT NULL THEN 'neutral' ELSE 'unknown' END AS rsi_condition, CASE WHEN ch > 0 THEN 'bullish' WHEN ch < 0 THEN 'bearish' WHEN ch IS NOT NULL THEN 'neutral' ELSE 'unknown' END AS macd_signal, CASE WHEN close > up THEN 'above upper band (overbought)' WHEN close < lo THEN 'below lower band (oversold)' WHEN (close - lo) / nullif(up - lo, 0) > 0.7 THEN 'near upper band' WHEN (close - lo) / nullif(up - lo, 0) < 0.3 THEN 'near lower band' WHEN (close - lo) / nullif(up - lo, 0) IS NOT NULL THEN 'middle of bands' ELSE 'unknown' END AS band_position FROM z",
    "bars",
    steps={
        "d": f"SELECT *, {delta('close')} AS ch, close - {lag('close')} AS mv FROM bars",
        "y": "SELECT *, CASE WHEN mv > 0 THEN mv ELSE 0 END AS gain, CASE WHEN mv < 0 THEN -mv ELSE 0 END AS loss FROM d",
        "z": f"SELECT *, {mean('close', 20)} + 2 * {roll('stddev_samp(close)', 'close', 20)} AS up, {mean('close', 20)} - 2 * {roll('stddev_samp(close)', 'close', 20)} AS lo, CASE WHEN count(gain) {frame(14)} >= 14 THEN CASE WHEN max(loss) {frame(14)} > 0 THEN 100 - 100 / (1 + avg(gain) {frame(14)} / avg(loss) {frame(14)}) WHEN max(gain) {frame(14)} > 0 THEN 100.0 END END AS rsi FROM y",
    },
)
