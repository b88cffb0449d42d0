"""Scores, ladders, segments and tables that reports read; sinks and sources of rows as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import change, div, flag, lag, so_far, whole


def fundamentals(rows: DataFrame) -> DataFrame:
    """symbol, pe, pb, roe, margin, revenue_growth, earnings_growth, debt, liquidity, dividend -> scores of quality,
    valuation and health, flags, and missing values filled by the median of all symbols."""
    z = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    median = rows.agg(F.percentile("pe", F.lit(0.5)).alias("median_pe"))
    out = rows.join(F.broadcast(median))
    return out.select(
        "symbol",
        F.coalesce("pe", "median_pe").alias("pe_ratio"),
        div("pe", F.col("earnings_growth") * 100 + 1e-6).alias("pe_to_growth"),
        (z("roe") * 10 + z("margin") * 10 + z("revenue_growth") * 5 - z("debt", 100.0) / 100).alias("quality_score"),
        (-z("pe") / 20 - z("pb") / 3).alias("valuation_score"),
        (z("liquidity", 1.0) * 0.5 + (100 - z("debt", 100.0)) / 100).alias("financial_health"),
        flag(z("dividend") * 100 > 2).alias("dividend_attractive"),
        flag((z("earnings_growth") > 0.15) & (z("pe") > 20)).alias("is_growth_stock"),
        flag((z("pe") > 0) & (z("pe") < 15) & (z("pb") < 2)).alias("is_value_stock"),
    )


def event_proximity(days: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, date and event dates by symbol -> days to the next and since the last event, and the risk they stand for.
    Both are looked up in one ordering of days and events."""
    a = days.select("symbol", "date", F.lit(None).cast("date").alias("event"), F.lit(1).alias("own"))
    b = events.select("symbol", F.col("date"), F.col("date").alias("event"), F.lit(0).alias("own"))
    by = W.partitionBy("symbol").orderBy("date", "own")
    out = a.unionByName(b)
    out = out.withColumn("past", F.last("event", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("coming", F.first("event", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))).filter("own = 1")
    coming = F.when(F.col("past") == F.col("date"), F.col("date")).otherwise(F.col("coming"))
    to, since = F.date_diff(coming, F.col("date")), F.date_diff(F.col("date"), F.col("past"))
    risk = F.when(to.isNull(), "unknown").when(to <= 3, "IMMINENT").when(to <= 7, "HIGH").when(to <= 14, "MODERATE").when(to <= 30, "LOW").otherwise("NONE")
    return out.select("symbol", "date", to.alias("days_to_next"), since.alias("days_since_last"), risk.alias("risk"), flag(since <= 5).alias("post_event_drift"))


def segments(labels: DataFrame) -> DataFrame:
    """symbol, date, regime, r -> runs of equal labels with their ends, length, mean and deviation."""
    out = labels.withColumn("starts", F.coalesce(F.col("regime") != lag("regime"), F.lit(True)))
    out = out.withColumn("run", F.sum(F.col("starts").cast("int")).over(so_far()))
    return out.groupBy("symbol", "run").agg(F.first("regime").alias("regime"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length"), F.avg("r").alias("mean"), F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("std"))


def regime_counts(labels: DataFrame) -> DataFrame:
    """How often each label holds, and all of them, by rollup."""
    return labels.rollup("symbol", "regime").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).select(F.coalesce("symbol", F.lit("all")).alias("symbol"), F.coalesce(F.col("regime").cast("string"), F.lit("all")).alias("regime"), "n", "first", "last")


def regime_days(labels: DataFrame) -> DataFrame:
    """How many days a symbol has spent in the label so far, in all its runs."""
    return labels.select("symbol", "date", "regime", F.row_number().over(W.partitionBy("symbol", "regime").orderBy("date")).alias("regime_days"))


def consensus(votes: DataFrame) -> DataFrame:
    """symbol, date and 0/1 votes (null: none) -> share of ups, what it is called, and how far models agree."""
    g = votes.groupBy("symbol", "date").agg(F.avg(F.col("vote").cast("double")).alias("share"), F.count("vote").alias("votes"))
    s = F.coalesce("share", F.lit(0.0))
    name = F.when(s > 0.75, "STRONG UP").when(s >= 0.5, "WEAK UP").when(s >= 0.25, "WEAK DOWN").otherwise("STRONG DOWN")
    return g.select("symbol", "date", s.alias("share"), "votes", name.alias("consensus"), F.when(s >= 0.5, s).otherwise(1 - s).alias("agreement"))


def drivers(features: DataFrame, target: str, names: list[str], k: int = 5) -> DataFrame:
    """The k features of largest absolute correlation with the target, by one aggregation."""
    g = features.agg(*[F.corr(n, target).alias(n) for n in names])
    out = g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("corr")) for n in names])).alias("x")).select("x.*").filter("corr is not null")
    return out.orderBy(F.desc(F.round(F.abs("corr"), 9)), "feature").limit(k)


def expanding_z(rows: DataFrame, column: str, least: int = 20) -> DataFrame:
    """Each value against the mean and population deviation of those up to it; 0 until there are enough."""
    n, m, s = F.count(column).over(so_far()), F.avg(column).over(so_far()), F.stddev_pop(column).over(so_far())
    return rows.select("symbol", "date", F.when(n >= least, (F.col(column) - m) / F.greatest(s, F.lit(1e-4))).otherwise(0.0).alias("z"))


def timing(positions: DataFrame, crash: float = -0.03, reduced: float = 0.95) -> DataFrame:
    """By symbol: the first crash and the first reduced position, days between, and what of the losses the strategy took."""
    out = positions.withColumn("r", change("close")).withColumn("s", lag("position") * F.col("r"))
    g = out.groupBy("symbol").agg(F.min(F.when(F.col("r") < crash, F.col("date"))).alias("first_crash"), F.min(F.when(F.col("position") < reduced, F.col("date"))).alias("first_reduced"), F.sum(F.when(F.col("r") < 0, F.col("r"))).alias("hold_loss"), F.sum(F.when(F.col("r") < 0, F.col("s"))).alias("strategy_loss"))
    return g.withColumn("days_late", F.date_diff("first_reduced", "first_crash")).withColumn("reduction", 1 - div("strategy_loss", "hold_loss"))


def recovery(bars: DataFrame, start: str, end: str) -> DataFrame:
    """By symbol, within dates: peak, trough after it, the fall, and the first date after the trough, be it beyond the dates,
    at the peak's level. All windows are over whole symbols, so there is one shuffle and nothing is broadcast."""
    inside, over = F.col("date").between(start, end), whole()
    out = bars.select("symbol", "date", "close").withColumn("peak", F.max(F.when(inside, F.col("close"))).over(over))
    out = out.withColumn("peak_date", F.min(F.when(inside & (F.col("close") == F.col("peak")), F.col("date"))).over(over))
    after = inside & (F.col("date") >= F.col("peak_date"))
    out = out.withColumn("trough", F.min(F.when(after, F.col("close"))).over(over))
    out = out.withColumn("trough_date", F.min(F.when(after & (F.col("close") == F.col("trough")), F.col("date"))).over(over))
    back = (F.col("date") > F.col("trough_date")) & (F.col("close") >= F.col("peak"))
    g = out.filter("peak is not null").groupBy("symbol", "peak", "peak_date", "trough", "trough_date").agg(F.min(F.when(back, F.col("date"))).alias("recovered"))
    return g.withColumn("fall", F.col("trough") / F.col("peak") - 1)


def spaced(marks: DataFrame, spacing: int = 5) -> DataFrame:
    """symbol, date, place -> those at least `spacing` places after the last one taken, greedily from the first."""
    from candela.operators.sequences import scan

    def start():
        taken = [None]

        def step(place: int) -> tuple:
            ok = taken[0] is None or place - taken[0] >= spacing
            if ok:
                taken[0] = place
            return (int(ok),)

        return step

    return scan(marks, ["place"], "taken int", start).filter("taken = 1").select("symbol", "date")


def category_tests(long: DataFrame) -> DataFrame:
    """By category and model: mean, t of its difference from 0, share above 0; models above 0 in enough categories."""
    g = long.groupBy("category", "model").agg(F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("sd"), F.count("*").alias("n"), F.avg((F.col("sharpe") > 0).cast("double")).alias("positive"))
    t = div("mean", F.col("sd") / F.sqrt("n"))
    wide = W.partitionBy("model")
    return g.select("category", "model", "mean", t.alias("t"), "n", "positive", (F.sum((F.col("mean") > 0).cast("int")).over(wide) >= 3).alias("universal"))


def validated(decisions: DataFrame) -> DataFrame:
    """JSON decisions by a schema: unknown actions hold, confidence lies within 1 and 10, size within 0 and 1."""
    d = F.from_json("decision", "action STRING, confidence DOUBLE, size DOUBLE")
    out = decisions.select("id", d.alias("d"))
    action = F.when(F.upper("d.action").isin("BUY", "SELL", "HOLD"), F.upper("d.action")).otherwise("HOLD")
    clamp = lambda c, a, b, z: F.least(F.lit(b), F.greatest(F.lit(a), F.coalesce(F.col(c), F.lit(z))))
    return out.select("id", action.alias("action"), clamp("d.confidence", 1.0, 10.0, 5.0).alias("confidence"), clamp("d.size", 0.0, 1.0, 0.0).alias("size"))


def through_files(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """rows appended to files of a kind (json or csv) in two goes and read back by their schema; malformed lines are left
    out."""
    for part in (rows.filter("trade_id % 2 = 0"), rows.filter("trade_id % 2 = 1")):
        writer = part.write.mode("append")
        (writer.json(folder) if kind == "json" else writer.csv(folder, header=True))
    reader = rows.sparkSession.read.schema(rows.schema).option("mode", "DROPMALFORMED")
    return reader.json(folder) if kind == "json" else reader.csv(folder, header=True)


def newest(files: DataFrame) -> DataFrame:
    """Of rows read from files, those of the file changed last (of several, the last name)."""
    f = F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("n"))
    marked = files.select("*", f.alias("__f"))
    return marked.join(F.broadcast(marked.agg(F.max("__f").alias("__f"))), "__f").drop("__f")


def ramp(x: Column, low: float, high: float) -> Column:
    """From 0 at low to 1 at high, null where x is."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low))))


def noisy_or(parts: Column, weights: Column | None = None) -> Column:
    """1 less the product of what each probability leaves, weighted and held within 0 and 1."""
    pairs = F.arrays_zip(parts.alias("p"), (weights if weights is not None else F.transform(parts, lambda _: F.lit(1.0))).alias("w"))
    return 1 - F.aggregate(pairs, F.lit(1.0), lambda a, x: a * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.getField("p") * x.getField("w")))))


def risk_ladder(rows: DataFrame) -> DataFrame:
    """symbol, date, p, q, s (risks) -> their plain and weighted noisy-or, a ramp, and the level they stand for."""
    parts = F.array("p", "q", "s")
    any_ = noisy_or(parts)
    level = F.when(any_ > 0.8, "EXTREME").when(any_ > 0.5, "HIGH").when(any_ > 0.25, "ELEVATED").otherwise("LOW")
    return rows.select("symbol", "date", any_.alias("any"), noisy_or(parts, F.array(F.lit(1.0), F.lit(0.7), F.lit(0.5))).alias("weighted"), ramp(F.col("p"), 0.2, 0.8).alias("ramp"), level.alias("level"))


