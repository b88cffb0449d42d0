"""Model, preparation and stream queries; those that SQL can express have oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import change, rounded
from candela.operators import discrepancy as g
from candela.operators import features as f
from candela.operators import hidden as h
from candela.operators import learners
from candela.operators import models as m
from candela.operators import sequences as q
from candela.plans.feature_queries import A, _of
from candela.plans.sequence_queries import LEDGER, _walk, _wanted
from candela.plans.label_queries import TAMED, _tamed
from candela.plans.sql import SO_FAR, change as delta, lag, query, r, std
from candela.sources import bars as s
from candela.streaming import twins


def _gaps(spark, sf_dir):
    """Closes of which every seventh bar is missing, and the first three of each symbol."""
    rows = s.bars(spark, sf_dir).withColumn("i", F.row_number().over(f.order()))
    return rows.select("symbol", "date", F.when((F.col("i") > 3) & (F.col("i") % 7 != 0), F.col("close")).alias("x"))


def _features(spark, sf_dir):
    return f.realized_vol(s.bars(spark, sf_dir), (5, 20)).join(f.volume(s.bars(spark, sf_dir)).select("symbol", "date", "volume_sma"), ["symbol", "date"]).na.drop()


def _named(spark, sf_dir):
    """Names of feature columns of the joined frames, found by their types and names."""
    frame = f.returns(s.bars(spark, sf_dir)).join(f.forward_targets(s.bars(spark, sf_dir)), ["symbol", "date"]).join(f.seasonality(s.bars(spark, sf_dir)), ["symbol", "date"])
    return spark.createDataFrame([(n,) for n in m.feature_columns(frame.dtypes)], "feature string")


def _changes(spark, sf_dir):
    """True changes: places where the 20-bar regime moves; found: a third of them, late by up to nine bars."""
    rows = f.regime_labels(s.bars(spark, sf_dir)).withColumn("place", F.row_number().over(f.order())).withColumn("before", F.lag("regime").over(f.order()))
    true = rows.filter("before != regime").select("symbol", "place")
    found = rows.filter("before != regime AND place % 3 = 0").select("symbol", (F.col("place") + F.col("place") % 10).alias("place"))
    return rounded(m.evaluate_changes(true, found))


def _equity(spark, sf_dir):
    """All symbols' ledgers as one account, by day."""
    done = q.ledger(_wanted(spark, sf_dir))
    return rounded(done.groupBy("date").agg(F.sum("equity").alias("equity"), F.count("*").alias("symbols"), F.count_if(F.col("action") != "hold").alias("orders")))


def _samples(spark, sf_dir):
    """By symbol, returns of bars whose closes move like prices, each beside the one before."""
    rows = _tamed(spark, sf_dir).select("symbol", "date", change("close").alias("r"))
    rows = rows.select("symbol", "date", "r", F.lag("r").over(f.order()).alias("before")).filter("before is not null")
    return rows.select(F.col("symbol").alias("sample"), F.unix_date("date").alias("id"), F.array("r", "before").alias("x"))


def _each_two(samples):
    names = samples.select(F.col("sample").alias("a")).distinct()
    return names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def _shifts(spark, sf_dir):
    """The samples of each two symbols by both measures."""
    x = _samples(spark, sf_dir)
    pairs = _each_two(x)
    w = g.wasserstein(x, pairs, 1).withColumnRenamed("distance", "w1").join(g.wasserstein(x, pairs, 2).withColumnRenamed("distance", "w2"), ["a", "b"])
    return rounded(g.mmd(x, pairs, 0.02).join(w, ["a", "b"]), 9)


def _told_later(spark, sf_dir):
    x = f.wasserstein_features(s.bars(spark, sf_dir))
    return rounded(g.nearest_centroid(m.windows(x), m.wasserstein_centroids(x)))


def _quality(spark, sf_dir):
    """Clusters' windows as samples: how far clusters are from each other, and the halves of each."""
    x = f.wasserstein_features(s.bars(spark, sf_dir))
    rows = m.windows(x).join(m.wasserstein_clusters(x).filter("regime >= 0"), ["symbol", "date"])
    return rounded(g.cluster_quality(rows.select(F.concat_ws("-", "symbol", "regime").alias("sample"), F.unix_date("date").alias("id"), F.array_sort("xs").alias("x"))))


QUERIES = {
    "hmm_full": _of(lambda x: h.rolling_states(x, ["vol_norm_return", "realized_vol", "trend_strength"], "realized_vol"), lambda sp, sf: f.hmm_features(_tamed(sp, sf))),
    "sample_shift": _shifts,
    "wkmeans_predict": _told_later,
    "cluster_mmd": _quality,
    "chronological_split": _of(m.split, s.bars),
    "impute_chain": _of(m.impute, _gaps),
    "standard_scale": _of(lambda x: m.standardise(x, ["realized_vol_20d", "volume_sma"]), _features),
    "interactions_poly": _of(lambda x: m.interactions(x, "realized_vol_20d", "volume_sma").withColumn("cube", F.round("cube", 4)), _features),
    "feature_columns": _named,
    "change_point_eval": _changes,
    "sim_equity": _equity,
    "wkmeans": _of(m.wasserstein_clusters, lambda sp, sf: f.wasserstein_features(s.bars(sp, sf))),
    "hmm_forward": _of(m.hidden_states, lambda sp, sf: f.hmm_features(s.bars(sp, sf))),
    "rf_spike": _of(learners.regime_forests, lambda sp, sf: f.vol_predictor(s.bars(sp, sf), s.vix(sp, sf)), lambda sp, sf: f.vol_regime_targets(s.bars(sp, sf))),
    "isotonic_dd": _of(m.drawdown_odds, lambda sp, sf: f.market_risk(s.market(sp, sf), s.vix(sp, sf)), lambda sp, sf: f.market_risk_targets(s.market(sp, sf))),
    "stream_event_ids": lambda sp, sf: twins.run_to_end(twins.deduplicated(twins.events(sp, sf)).select("event_id", "event_type"), "events"),
    "stream_ema": lambda sp, sf: rounded(twins.ema(twins.events(sp, sf))),
    "stream_hysteresis": lambda sp, sf: twins.overlay(twins.events(sp, sf)),
}

FEATURES = {
    "x": f"SELECT *, ln(close / nullif({lag('close')}, 0)) AS lr, volume FROM bars",
    "f0": f"SELECT symbol, date, {std('lr', 5)} * {A} AS v5, {std('lr', 20)} * {A} AS v, CASE WHEN count(volume) OVER w20 >= 20 THEN avg(volume) OVER w20 END AS vs FROM x WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "ft": "SELECT * FROM f0 WHERE v5 IS NOT NULL AND v IS NOT NULL AND vs IS NOT NULL",
}
EVENTS = {"n": "SELECT event_type AS symbol, event_id AS date, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events"}
NAMED = "return_1d return_5d return_10d return_20d log_return_1d momentum_5d momentum_10d momentum_20d gap gap_pct gap_up gap_down day_of_week is_monday is_friday month is_january is_december quarter".split()
ORACLE = {
    "sample_shift": query(
        f"SELECT a, b, {r('ma + mb - 2 * m', 'mmd2', 9)}, {r('w1', 'w1', 9)}, {r('sqrt(w2)', 'w2', 9)} FROM k JOIN (SELECT a, m AS ma FROM k WHERE a = b) USING (a) JOIN (SELECT b, m AS mb FROM k WHERE a = b) USING (b) JOIN w USING (a, b) WHERE a < b",
        "bars",
        steps={
            "t0": f"SELECT symbol, date, close ** {TAMED} AS close FROM bars", "t1": f"SELECT symbol, date, {delta('close')} AS r FROM t0", "t2": f"SELECT symbol AS s, r, {lag('r')} AS q FROM t1", "x": "SELECT * FROM t2 WHERE q IS NOT NULL",
            "k": "SELECT a.s AS a, b.s AS b, avg(exp(-((a.r - b.r) ** 2 + (a.q - b.q) ** 2) / (2 * 0.02 * 0.02))) AS m FROM x a JOIN x b ON a.s <= b.s GROUP BY 1, 2",
            "v": "SELECT s, d, v, row_number() OVER (PARTITION BY s, d ORDER BY v) AS i, count(*) OVER (PARTITION BY s, d) AS n FROM (SELECT s, 0 AS d, r AS v FROM x UNION ALL SELECT s, 1, q FROM x)",
            "e": "SELECT DISTINCT a.s AS a, b.s AS b, a.d, a.n AS na, b.n AS nb, unnest([a.i * b.n, b.i * a.n]) AS u FROM v a JOIN v b ON b.d = a.d AND a.s < b.s AND (b.i = least(a.i, b.n) OR a.i = 1)",
            "e2": "SELECT *, (u - coalesce(lag(u) OVER (PARTITION BY a, b, d ORDER BY u), 0)) / (na * nb) AS w FROM e",
            "w": "SELECT a, b, avg(w1) AS w1, avg(w2) AS w2 FROM (SELECT e2.a, e2.b, e2.d, sum(abs(p.v - q.v) * w) AS w1, sum((p.v - q.v) ** 2 * w) AS w2 FROM e2 JOIN v p ON p.s = e2.a AND p.d = e2.d AND p.i = (u + nb - 1) // nb JOIN v q ON q.s = e2.b AND q.d = e2.d AND q.i = (u + na - 1) // na GROUP BY 1, 2, 3) GROUP BY 1, 2",
        },
    ),
    "feature_columns": "SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMED) + "]) AS feature",
    "chronological_split": query("SELECT symbol, date, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'validate' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)", "bars"),
    "impute_chain": query(
        f"SELECT symbol, date, {r('coalesce(last_value(x IGNORE NULLS) ' + SO_FAR + ', first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)', 'x')} FROM (SELECT symbol, date, CASE WHEN i > 3 AND i % 7 <> 0 THEN close END AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars))",
        "bars",
    ),
    "standard_scale": query(f"SELECT symbol, date, {r('(v - avg(v) OVER (PARTITION BY symbol)) / stddev_pop(v) OVER (PARTITION BY symbol)', 'realized_vol_20d')}, {r('(vs - avg(vs) OVER (PARTITION BY symbol)) / stddev_pop(vs) OVER (PARTITION BY symbol)', 'volume_sma')} FROM ft", "bars", steps=FEATURES),
    "interactions_poly": query(f"SELECT symbol, date, {r('v * vs', 'product')}, {r('v / (vs + 1e-6)', 'ratio')}, {r('v * v', 'square')}, {r('v * v * v', 'cube', 4)} FROM ft", "bars", steps=FEATURES),
    "change_point_eval": query(
        f"SELECT symbol, n_true, n_found, hits, n_true - hits AS misses, n_found - hits AS false_alarms, {r('coalesce(hits / nullif(n_found, 0), 1)', 'precision')}, {r('hits / n_true', 'recall')}, {r('coalesce(2 * hits / nullif(n_found + n_true, 0), 0)', 'f1')}, {r('mean_delay', 'mean_delay')} FROM (SELECT t.symbol, t.n AS n_true, coalesce(u.n, 0) AS n_found, coalesce(h.n, 0) AS hits, coalesce(h.d, 0) AS mean_delay FROM (SELECT symbol, count(*) AS n FROM tr GROUP BY 1) t LEFT JOIN (SELECT symbol, count(*) AS n FROM fo GROUP BY 1) u USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n, avg(b - a) AS d FROM hit GROUP BY 1) h USING (symbol))",
        "bars",
        steps={
            "x": f"SELECT *, {delta('close')} AS ret FROM bars", "y": f"SELECT *, {std('ret', 20)} AS sd FROM x", "k": "SELECT symbol, quantile_cont(sd, 0.33) AS a, quantile_cont(sd, 0.67) AS b FROM y GROUP BY symbol",
            "z": "SELECT y.symbol, y.date, CASE WHEN sd < a THEN 0 WHEN sd > b THEN 2 ELSE 1 END AS regime FROM y JOIN k ON y.symbol = k.symbol", "u0": f"SELECT *, {lag('regime')} AS before, row_number() OVER (PARTITION BY symbol ORDER BY date) AS place FROM z",
            "tr": "SELECT symbol, place FROM u0 WHERE before <> regime", "fo": "SELECT DISTINCT symbol, place + place % 10 AS place FROM u0 WHERE before <> regime AND place % 3 = 0",
            "pr": "SELECT symbol, b, a FROM (SELECT fo.symbol, fo.place AS b, tr.place AS a, row_number() OVER (PARTITION BY fo.symbol, fo.place ORDER BY abs(tr.place - fo.place), tr.place) AS k FROM fo JOIN tr ON tr.symbol = fo.symbol) WHERE k = 1 AND abs(a - b) <= 5",
            "hit": "SELECT symbol, a, min(b) AS b FROM pr GROUP BY 1, 2",
        },
    ),
    "sim_equity": query(f"SELECT date, {r('sum(cash + shares * close)', 'equity')}, count(*) AS symbols, CAST(count(*) FILTER (action <> 'hold') AS BIGINT) AS orders FROM e GROUP BY date", "bars", steps=LEDGER, recursive=True),
    "stream_event_ids": "SELECT event_id, event_type FROM events",
    "stream_ema": query(f"SELECT date AS event_id, symbol AS event_type, {r('m', 'ema_12')} FROM e", recursive=True, steps={**EVENTS, "e": _walk("n", "symbol, date, i, value AS m", "n.symbol, n.date, n.i, CAST(2 AS DOUBLE) / 13 * n.value + CAST(11 AS DOUBLE) / 13 * e.m", "")}),
    "stream_hysteresis": query(
        "SELECT date AS event_id, symbol AS event_type, CAST(CASE WHEN inside THEN 1 ELSE 0 END AS INTEGER) AS position FROM e",
        recursive=True,
        steps={**EVENTS, "e": _walk("n", "symbol, date, i, value / 10 <= 1.5 AS inside, CAST(0 AS BIGINT) AS d", "n.symbol, n.date, n.i, CASE WHEN e.inside THEN n.value / 10 <= 1.5 ELSE e.d + 1 >= 2 AND n.value / 10 < 0.5 END, CASE WHEN e.inside THEN 0 ELSE e.d + 1 END", "")},
    ),
}
