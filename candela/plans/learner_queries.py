"""Queries of trained models and detectors, and oracles where SQL can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import change, rounded
from candela.operators import detectors as d
from candela.operators import features as f
from candela.operators import learners as l
from candela.operators import sequences as q
from candela.operators import trees as t
from candela.operators import tuning as u
from candela.plans.feature_queries import _of
from candela.plans.label_queries import TREND, _tamed
from candela.plans.sql import lag, query, r, roll, std
from candela.sources import bars as s
from candela.sources.shared import new_folder

HORIZONS = (3, 5)
RISKS = "vix_level vix_zscore_60d vix_roc_5d vix_roc_20d vix_percentile_252d vol_of_vix_20d rv_5d rv_20d vol_ratio_5_20 vrp spy_ret_5d trailing_dd_10d".split()
NAMES = ["return_1d", "rsi_normalized", "bb_position", "realized_vol_5d", "realized_vol_20d"]


def _features(spark, sf_dir):
    """Five features of bars whose closes move like prices."""
    bars = _tamed(spark, sf_dir)
    parts = [bars.select("symbol", "date", change("close").alias("return_1d")), f.rsi(bars).select("symbol", "date", "rsi_normalized"), f.bollinger(bars).select("symbol", "date", "bb_position"), f.realized_vol(bars).select("symbol", "date", "realized_vol_5d", "realized_vol_20d")]
    return bars, reduce(lambda a, b: a.join(b, ["symbol", "date"]), parts).na.drop()


def _rows(spark, sf_dir):
    return l.with_targets(*_features(spark, sf_dir), HORIZONS)


def _predicted(spark, sf_dir):
    return l.fit_predict(_rows(spark, sf_dir), NAMES)


def _infer(spark, sf_dir):
    """Four models saved by symbol and horizon, read back and applied to every row."""
    folder, rows = new_folder(spark, "models"), _rows(spark, sf_dir)
    l.fit(rows, NAMES, folder)
    return rounded(l.consensus(rows, NAMES, folder))


def _importance(spark, sf_dir):
    folder = new_folder(spark, "models")
    l.fit(_rows(spark, sf_dir), NAMES, folder, ("decision_tree", "random_forest"))
    return rounded(l.importance(spark.read.parquet(f"{folder}/nodes"), NAMES).filter("kind <> 'gradient_boosting'"))


def _risk(spark, sf_dir):
    """The market's risk features with its volatility over the next ten bars, and the date at which that is known."""
    m = s.market(spark, sf_dir)
    rows = f.market_risk(m, s.vix(spark, sf_dir)).join(f.market_risk_targets(m), "date").na.drop(subset=[c for c in RISKS])
    return rows.withColumn("known", F.lead("date", 10).over(W.orderBy("date")))  # a calendar of days


def _first_tree(spark, sf_dir):
    """A tree of three levels a symbol: the next bar's rise by three figures of the bar."""
    over = W.partitionBy("symbol").orderBy("date")
    rows = s.bars(spark, sf_dir).select(F.col("symbol").alias("model"), ((F.col("high") - F.col("low")) / F.col("close")).alias("spread"), (F.col("open") / F.lag("close").over(over) - 1).alias("gap"), "volume", (F.lead("close").over(over) > F.col("close")).cast("double").alias("y"))
    binned, cuts = t.prepared(rows.filter("y is not null").withColumns({"train": F.lit(True), "w": F.lit(1.0)}), ["spread", "gap", "volume"], 8)
    return rounded(t.tree(binned, cuts, t.Shape(3, 20, 8)).select("model", "node", "feature", "cut", "gain", "value", F.col("n").cast("long").alias("n")))


def _gate_inputs(spark, sf_dir):
    """Figures of a day's lines stand for the chances of change and the run length."""
    rows = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
    return rows.agg((F.avg("l_discount") / 2).alias("cp"), (F.avg("l_quantity") * 2).alias("run"), (F.avg("l_tax") / 2).alias("vol_cp"))


QUERIES = {
    "model_targets": lambda sp, sf: l.with_targets(_tamed(sp, sf), f.realized_vol(_tamed(sp, sf)).select("symbol", "date", "realized_vol_20d").na.drop(), HORIZONS).select("symbol", "date", "horizon", "target", "part"),
    "model_metrics": _of(l.by_part, _predicted),
    "model_backtest": _of(l.backtest, _predicted, _tamed),
    "model_importance": _importance,
    "tree_nodes": _first_tree,
    "vol_regressor": lambda sp, sf: rounded(t.regression_by_year(t.walk_forward_regression(_risk(sp, sf), RISKS, "fwd_realized_vol", "known"))),
    "model_tune": lambda sp, sf: rounded(u.tune(_rows(sp, sf), NAMES, _tamed(sp, sf).select("symbol", "date", change("close").alias("r")))),
    "model_search": _of(lambda x: l.search(x, NAMES), _rows),
    "batch_inference": _infer,
    "scaled_trends": _of(d.scaled_trends, _tamed),
    "bocpd_regimes": _of(d.bocpd_regimes, _tamed),
    "gate_overlay": _of(d.gated, _gate_inputs),
    "detector_v1": _of(d.joint_changes, _tamed),
    "detector_v2": _of(d.alpha_detector, _tamed),
    "grid_search_full": _of(lambda a, b: q.best_of_grid(q.grid_search(a, b, until="1997-12-31")), _tamed, s.vix),
    "bocpd_current": _of(d.current, _tamed),
}

def _raw(t: str, opened: str) -> str:
    return f"CAST(CASE WHEN {t}.vol > 0.1 OR {t}.run < 10 OR ({t}.by_run > 0.9 AND {t}.vol > 0.05) THEN 0.25 WHEN {opened} THEN 1 - greatest({t}.by_cp, {t}.by_run) * 0.25 ELSE 1.0 END AS DOUBLE)"


def _tree_steps(depth: int = 3, bins: int = 8, leaf: int = 20) -> dict[str, str]:
    """A tree level by level: rows (model, id, xs, y) from table x0; nodes in tables split1.. and leaves."""
    shares = ", ".join(f"{k / bins!r}" for k in range(1, bins))
    steps = {
        "cut": f"SELECT model, f, unnest(list_distinct(quantile_disc(v, [{shares}]))) AS c FROM (SELECT model, unnest(xs) AS v, unnest(range(len(xs))) AS f FROM x0) GROUP BY model, f",
        "cuts": "SELECT *, row_number() OVER (PARTITION BY model, f ORDER BY c) - 1 AS bin FROM cut",
        "at0": "SELECT *, 1 AS node FROM x0",
    }
    for level in range(depth):
        steps[f"try{level}"] = f"SELECT a.model, node, f, bin, c, sum(y) FILTER (xs[f + 1] <= c) AS s, count(*) FILTER (xs[f + 1] <= c) AS m, sum(y) AS ss, count(*) AS mm FROM at{level} a JOIN cuts u ON u.model = a.model WHERE node >= {1 << level} GROUP BY ALL"
        steps[f"gain{level}"] = f"SELECT *, s * s / m + (ss - s) ** 2 / (mm - m) - ss * ss / mm AS gain FROM try{level} WHERE m >= {leaf} AND mm - m >= {leaf}"
        steps[f"split{level}"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, node ORDER BY round(gain / mm, 10) DESC, f, bin) AS k FROM gain{level} WHERE round(gain / mm, 10) > 0) WHERE k = 1"
        steps[f"at{level + 1}"] = f"SELECT a.* EXCLUDE (node), CASE WHEN p.f IS NULL THEN a.node ELSE 2 * a.node + CAST(a.xs[p.f + 1] > p.c AS INTEGER) END AS node FROM at{level} a LEFT JOIN split{level} p ON p.model = a.model AND p.node = a.node"
    inner = " UNION ALL ".join(f"SELECT model, node, f, c, gain, ss / mm AS value, mm FROM split{k}" for k in range(depth))
    steps["nodes"] = f"{inner} UNION ALL SELECT model, node, NULL, NULL, 0, avg(y), count(*) FROM at{depth} GROUP BY model, node"
    return steps


ORACLE = {
    "tree_nodes": query(
        f"SELECT model, CAST(node AS INTEGER) AS node, CAST(f AS INTEGER) AS feature, {r('c', 'cut')}, {r('gain', 'gain')}, {r('value', 'value')}, CAST(mm AS BIGINT) AS n FROM nodes", "bars",
        steps={"b0": f"SELECT symbol AS model, (high - low) / close AS spread, coalesce(open / {lag('close')} - 1, 0) AS gap, volume, {lag('close', -1)} AS next, close FROM bars", "x0": "SELECT model, [spread, gap, volume] AS xs, CASE WHEN next > close THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM b0 WHERE next IS NOT NULL", **_tree_steps()},
    ),
    "model_targets": query(
        "SELECT symbol, date, CAST(h AS INTEGER) AS horizon, CAST(CASE WHEN (CASE h WHEN 3 THEN c3 ELSE c5 END) > close THEN 1 ELSE 0 END AS INTEGER) AS target, part FROM (SELECT *, CASE WHEN i + h <= floor(n * 0.6) THEN 'train' WHEN i > floor(n * 0.6) AND i + h <= floor(n * 0.8) THEN 'validate' WHEN i > floor(n * 0.8) THEN 'test' END AS part FROM z, (VALUES (3), (5)) AS v(h)) WHERE part IS NOT NULL AND (CASE h WHEN 3 THEN c3 ELSE c5 END) IS NOT NULL",
        "bars",
        steps={
            **TREND, "v": f"SELECT lr.symbol, lr.date, {std('lr', 20)} AS v FROM lr", "k": "SELECT tb.symbol, tb.date, tb.close FROM tb JOIN v ON v.symbol = tb.symbol AND v.date = tb.date WHERE v IS NOT NULL",
            "z": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n, {lag('close', -3)} AS c3, {lag('close', -5)} AS c5 FROM k",
        },
    ),
    "scaled_trends": query(
        f"SELECT symbol, date, {r('x', 'x')}, {r('coalesce(1 / 252.0::DOUBLE + (1 / 42.0::DOUBLE - 1 / 252.0::DOUBLE) / (1 + exp(-CASE WHEN z IS NOT NULL THEN least(3, greatest(-3, z)) END)), 1 / 126.0::DOUBLE)', 'hazard')} FROM w",
        "bars",
        steps={
            **TREND, "a": "SELECT symbol, date, t21 FROM tr WHERE t21 IS NOT NULL", "b": f"SELECT symbol, date, t21 / greatest({std('t21', 21)}, 1e-6) AS x FROM a", "c": "SELECT * FROM b WHERE x IS NOT NULL",
            "e": f"SELECT *, {std('x', 21)} AS vol FROM c", "w": f"SELECT *, (vol - {roll('avg(vol)', 'vol', 126)}) / nullif({std('vol', 126)}, 0) AS z FROM e",
        },
    ),
    "gate_overlay": query(
        f"SELECT symbol, date, opened AS in_transition, {r('by_cp', 'risk_cp')}, {r('by_run', 'risk_rl')}, {r('pos', 'position')} FROM e",
        recursive=True,
        steps={
            "i0": "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_discount) / 2 AS cp, avg(l_quantity) * 2 AS run, avg(l_tax) / 2 AS vol FROM lineitem GROUP BY 1, 2",
            "n": "SELECT *, least(1, greatest(0, (cp - 0.02) / 0.08)) AS by_cp, least(1, greatest(0, (20 - run) / 15)) AS by_run, cp > 0.1 OR run < 20 OR vol > 0.05 AS fast, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM i0",
            "e": f"SELECT symbol, date, i, by_cp, by_run, cp / 3 AS sm, CAST(fast AS INTEGER) AS opened, CAST(0 AS BIGINT) AS calm, {_raw('n', 'fast')} AS pos FROM n WHERE i = 1 UNION ALL SELECT symbol, date, i, by_cp, by_run, sm, opened, calm, {_raw('z', 'opened = 1')} / 3 + 2 * old / 3 FROM (SELECT y.*, CAST(CASE WHEN was = 0 THEN fast WHEN c >= 5 THEN false ELSE true END AS INTEGER) AS opened, CASE WHEN was = 0 OR c >= 5 THEN 0 ELSE c END AS calm FROM (SELECT x.*, CASE WHEN was = 0 THEN 0 WHEN sm > 0.03 OR run < 40 OR greatest(by_cp, by_run) >= 0.15 THEN 0 ELSE was_calm + 1 END AS c FROM (SELECT n.*, n.cp / 3 + 2 * e.sm / 3 AS sm, e.opened AS was, e.calm AS was_calm, e.pos AS old FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) x) y) z",
        },
    ),
}
