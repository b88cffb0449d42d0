"""Labels, ladders, cleaning and small summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import YEAR, change, div, island, lag, last, roll, so_far, std

# Thresholds of the regime rules.
CRISIS_VOL, VERY_HIGH_RISK, HIGH_RISK, MODERATE_RISK, LOW_RISK = 0.40, 0.75, 0.50, 0.35, 0.30
HIGH_VOL, LOW_VOL = 0.22, 0.15
STRONG_BEAR, BEAR, STRONG_BULL, BULL = -0.08, -0.03, 0.06, 0.02
STRONG_DOWN, DOWN, UP = -0.05, -0.01, 0.01
BEARISH = ("bear", "crisis", "bear_transition")


def steps(x: Column, rungs: list[tuple[float, object]], top: object) -> Column:
    """The value of the first rung that x lies below, else top; null where x is."""
    value = reduce(lambda c, rung: c.when(x < rung[0], F.lit(rung[1])), rungs[1:], F.when(x < rungs[0][0], F.lit(rungs[0][1])))
    return F.when(x.isNotNull(), value.otherwise(F.lit(top)))


def complete(rows: DataFrame, target: str, features: list[str], share: float = 0.8) -> DataFrame:
    """Rows with a target and values in at least this share of the features."""
    return rows.na.drop(subset=[target]).na.drop(thresh=-int(-(share * len(features)) // 1), subset=features)


def pruned(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows without the named columns; names that aren't there are passed over."""
    return rows.drop(*names)


def trend_features(bars: DataFrame) -> DataFrame:
    """Log returns summed over 21 and 63 bars, and their yearly deviation over 21."""
    out = bars.select("symbol", "date", F.log1p(change("close")).alias("lr"))
    return out.select("symbol", "date", roll(F.sum, "lr", 21).alias("trend_21"), roll(F.sum, "lr", 63).alias("trend_63"), (std("lr", 21) * float(YEAR) ** 0.5).alias("volatility"))


def regimes(rows: DataFrame) -> DataFrame:
    """symbol, date, risk, trend_21, trend_63, volatility -> the regime by an ordered list of rules.

    One rule looks at the label before: a rise under high risk ends a bearish spell. So each row has two candidate labels,
    after a bearish row and after another, and whether a row ends up bearish is either fixed by the row itself or the
    opposite of the row before (never the same as it). What holds is then the last fixed row's state, turned as often as
    rows have turned it since: windows only, no row-by-row state. A missing risk or trend is consolidation.
    """
    risk, up, t63, vol = F.col("risk"), F.col("trend_21"), F.col("trend_63"), F.col("volatility")
    high, low, moderate = risk >= HIGH_RISK, risk <= LOW_RISK, risk >= MODERATE_RISK
    rises, falls, flat = up >= UP, up <= DOWN, (t63 > BEAR) & (t63 < BULL)
    known = risk.isNotNull() & up.isNotNull() & t63.isNotNull()
    crisis = (vol >= CRISIS_VOL) & (up <= 0.05) | (vol >= 0.35) & (risk >= VERY_HIGH_RISK) & (up <= 0.03) | (up <= -0.20) | (up <= -0.12) & (vol >= 0.30)
    bear = (t63 <= STRONG_BEAR) | (t63 <= BEAR) & (falls | high) | high & (up <= STRONG_DOWN) | (vol >= HIGH_VOL) & falls | high & falls
    bull = (t63 >= BULL) & low & ~(vol >= HIGH_VOL) | (t63 >= STRONG_BULL) & ~high | (t63 >= BULL) & rises & ~high | low & rises & (t63 >= 0) | (vol <= LOW_VOL) & rises & (t63 >= BULL)
    to_bull = (vol >= HIGH_VOL) & rises & (t63 > BEAR) | high & rises | moderate & rises & (t63 >= BULL) | rises & (t63 > BEAR) & ~low
    to_bear = high & ~rises & (t63 > BEAR) | falls & flat | moderate & falls
    yes = lambda c: F.coalesce(c, F.lit(False))
    tail = F.when(yes(bear), "bear").when(yes(bull), "bull").when(yes(to_bull), "bull_transition").when(yes(to_bear), "bear_transition").otherwise("consolidation")
    plain = F.when(~known, "consolidation").when(yes(crisis), "crisis").otherwise(tail)
    after = F.when(~known, "consolidation").when(yes(crisis), "crisis").when(yes(rises & high), "bull_transition").otherwise(tail)
    out = rows.withColumns({"plain": plain, "after": after})
    a, b = F.col("after").isin(*BEARISH), F.col("plain").isin(*BEARISH)
    out = out.withColumns({"fixed": (a == b) | (lag("date").isNull()), "state": b})
    out = out.withColumn("run", island(F.col("fixed")))
    run = W.partitionBy("symbol", "run").orderBy("date")
    out = out.withColumn("bearish", (F.first("state").over(run).cast("int") + F.row_number().over(run) - 1) % 2 == 1)
    return out.withColumn("before", F.coalesce(lag("bearish"), F.lit(False))).select("symbol", "date", F.when(F.col("before"), F.col("after")).otherwise(F.col("plain")).alias("regime"))


def conditions(rows: DataFrame) -> DataFrame:
    """symbol, date, rsi, histogram, close, upper, lower -> what they are called."""
    place = div(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower"))
    rsi = F.when(F.col("rsi") >= 70, "overbought").when(F.col("rsi") <= 30, "oversold").when(F.col("rsi").isNotNull(), "neutral").otherwise("unknown")
    macd = F.when(F.col("histogram") > 0, "bullish").when(F.col("histogram") < 0, "bearish").when(F.col("histogram").isNotNull(), "neutral").otherwise("unknown")
    band = F.when(F.col("close") > F.col("upper"), "above upper band (overbought)").when(F.col("close") < F.col("lower"), "below lower band (oversold)").when(place > 0.7, "near upper band").when(place < 0.3, "near lower band").when(place.isNotNull(), "middle of bands").otherwise("unknown")
    return rows.select("symbol", "date", rsi.alias("rsi_condition"), macd.alias("macd_signal"), band.alias("band_position"))


def risk_levels(rows: DataFrame) -> DataFrame:
    """symbol, date, p (odds of a fall), rv_5, rv_20 -> level, trend of volatility, share to hold and multiple for stops."""
    p, ratio = F.col("p"), div("rv_5", "rv_20")
    bounds = (0.15, 0.30, 0.50, 0.70)
    rung = lambda values: steps(p, list(zip(bounds, values)), values[-1])
    trend = F.when(ratio > 1.2, "RISING").when(ratio < 0.8, "FALLING").otherwise("STABLE")
    return rows.select("symbol", "date", rung(("LOW", "MODERATE", "ELEVATED", "HIGH", "EXTREME")).alias("risk_level"), trend.alias("vol_trend"), rung((1.0, 0.85, 0.65, 0.40, 0.20)).alias("position_pct"), rung((1.0, 1.2, 1.4, 1.7, 2.0)).alias("stop_multiple"))


def portfolio_ladder(positions: DataFrame, vix: DataFrame) -> DataFrame:
    """symbol, date, inside, leaves (0/1) and the index's date and vix -> by date the portfolio's risk level."""
    g = positions.groupBy("date").agg(F.sum("leaves").alias("exits"), F.sum(1 - F.col("inside")).alias("out"), F.count("*").alias("n"))
    level = F.when(F.col("exits") > 0, "HIGH").when(F.col("out") > F.floor(F.col("n") / 2), "ELEVATED").when(F.col("vix") > 25, "MODERATE").otherwise("LOW")
    return g.join(vix, "date", "left").select("date", "exits", "out", level.alias("risk_level"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """symbol, date, state of two models (a: 0 calm to 2 wild; b: 0 falling to 2 rising) -> whether they tell the same risk."""
    out = a.withColumnRenamed("state", "a").join(b.withColumnRenamed("state", "b"), ["symbol", "date"])
    same = F.col("a") + F.col("b") == 2
    return out.select("symbol", "date", "a", "b", same.alias("agreement"), F.when(same, "HIGH").otherwise("LOW").alias("confidence_level"))


def tiers(assets: DataFrame, known: DataFrame, sectors: DataFrame) -> DataFrame:
    """name, sector, beta, cap -> tier and what told it: a list of names, the sector, beta, size, else the default. known
    (name, tier) and sectors (sector, tier) are short lists and broadcast."""
    out = assets.join(F.broadcast(known.withColumnRenamed("tier", "k")), "name", "left").join(F.broadcast(sectors.withColumnRenamed("tier", "s")), "sector", "left")
    beta = F.when(F.col("beta") > 1.3, "tier2").when(F.col("beta").isNotNull(), "tier1")
    cap = F.when(F.col("cap") > 500e9, "tier3")
    source = F.when(F.col("k").isNotNull(), "predefined").when(F.col("s").isNotNull(), "sector").when(beta.isNotNull(), "beta").when(cap.isNotNull(), "market_cap").otherwise("default")
    return out.select("name", F.coalesce("k", "s", beta, cap, F.lit("tier1")).alias("tier"), source.alias("classification_source"))


def tail_rates(bars: DataFrame, k: int = 20, bound: float = 2.0) -> DataFrame:
    """Of the last k standardised returns: how many are beyond the bound, how many negative; the return times the z-score of
    log volume; and the z-score of the range. 0 until there are k. Deviations are of a population."""
    r = F.log1p(change("close"))
    out = bars.select("symbol", "date", r.alias("r"), F.log("volume").alias("v"), F.log(F.col("high") / F.col("low")).alias("h")).filter("r is not null")
    out = out.withColumn("z", F.coalesce(div(F.col("r") - F.avg("r").over(so_far()), F.stddev_pop("r").over(so_far())), F.lit(0.0)))
    full = F.count("z").over(last(k)) >= k
    score = lambda c, least: (F.col(c) - F.avg(c).over(last(k))) / F.greatest(F.stddev_pop(c).over(last(k)), F.lit(least))
    moves = F.max("v").over(last(k)) > F.min("v").over(last(k))
    zero = lambda c: F.when(full, c).otherwise(0.0)
    flags = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).over(last(k))
    spread = F.max("h").over(last(k)) > F.min("h").over(last(k))
    return out.select("symbol", "date", zero(flags(F.abs("z") > bound)).alias("tail_rate"), zero(flags(F.col("z") < 0)).alias("downside_freq"), F.when(full & moves, F.col("z") * score("v", 1e-10)).otherwise(0.0).alias("volume_cond_ret"), F.when(full & spread, score("h", 1e-8)).otherwise(0.0).alias("range_vol_z"))


def garman_klass(bars: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Volatility of a bar from its range and body, at least the root of floor; and where the close lies in the range."""
    hl, co = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    good = (F.least("open", "high", "low", "close") > 0) & (F.col("high") > F.col("low"))
    value = 0.5 * hl * hl - (2 * F.log(F.lit(2.0)) - 1) * co * co
    wide = F.col("high") - F.col("low") >= floor
    return bars.select("symbol", "date", F.sqrt(F.when(good, F.greatest(value, F.lit(floor))).otherwise(floor)).alias("garman_klass"), F.when(wide, (2 * F.col("close") - F.col("high") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0).alias("clv"))


def recent_changes(labels: DataFrame, rows: int = 60, most: int = 5) -> DataFrame:
    """symbol, date, regime -> the last few changes of label within the last rows of each symbol; the first of these rows
    counts as a change."""
    tail = labels.withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("back") <= rows)
    new = tail.withColumn("old", lag("regime")).filter("old is null or old != regime")
    return new.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("k") <= most).select("symbol", "date", "regime")


def above_quantile(probs: DataFrame, q: float = 0.95) -> DataFrame:
    """symbol, date, place, p -> rows whose p is above the symbol's own quantile: what spaced() then thins out."""
    bound = probs.groupBy("symbol").agg(F.percentile("p", F.lit(q)).alias("bound"))
    return probs.join(bound, "symbol").filter("p > bound").select("symbol", "date", "place")


def regime_summary(probs: DataFrame, runs: DataFrame) -> DataFrame:
    """symbol, date, p and symbol, run -> by symbol how many rows, changes and regimes there are, mean and largest odds."""
    n = runs.groupBy("symbol").agg(F.count_distinct("run").alias("n_regimes"))
    g = probs.groupBy("symbol").agg(F.count("*").alias("n_observations"), F.avg("p").alias("avg_change_prob"), F.max("p").alias("max_change_prob"))
    return g.join(n, "symbol").withColumn("n_changepoints", F.col("n_regimes") - 1)


def growth_averages(growth: DataFrame) -> DataFrame:
    """symbol, qoq, yoy -> their means over the quarters that have them."""
    return growth.groupBy("symbol").agg(F.avg("qoq").alias("avg_qoq_growth"), F.avg("yoy").alias("avg_yoy_growth"), F.count("qoq").alias("quarters"))


def _combos(long: DataFrame, top: int) -> DataFrame:
    """Rows of the best combinations of model and horizon by mean score, with their parts as a list."""
    combo = F.concat_ws("+", "model", F.concat(F.lit("h"), F.col("horizon").cast("string")))
    rows = long.withColumns({"combo": combo, "features": F.array("model", F.concat(F.lit("h"), F.col("horizon").cast("string")))})
    best = rows.groupBy("combo").agg(F.avg("sharpe").alias("avg_sharpe")).orderBy(F.desc(F.round("avg_sharpe", 9)), "combo").limit(top)
    return rows.join(F.broadcast(best), "combo")  # top rows


def feature_frequency(long: DataFrame, top: int = 5) -> DataFrame:
    """How often each part is in the best combinations, and these combinations' mean score."""
    one = _combos(long, top).groupBy("combo", "features", "avg_sharpe").agg(F.count("*").alias("n")).select("combo", "avg_sharpe", F.explode("features").alias("feature"))
    g = one.groupBy("feature").agg(F.count("*").alias("appearances"), F.avg("avg_sharpe").alias("avg_sharpe_when_present"), F.array_join(F.slice(F.array_sort(F.collect_list("combo")), 1, 3), " | ").alias("example_combos"))
    return g.withColumn("frequency_pct", F.round(F.col("appearances") / top * 100, 1))


def sector_performance(long: DataFrame, top: int = 5) -> DataFrame:
    """By sector over the best combinations: mean and population deviation of the score, mean fall, how many."""
    return _combos(long, top).groupBy("category").agg(F.avg("sharpe").alias("avg_sharpe"), F.stddev_pop("sharpe").alias("sharpe_std"), F.avg("max_dd").alias("avg_drawdown"), F.count("*").alias("samples"))


def winners_and_losers(long: DataFrame, top: int = 5, k: int = 6) -> DataFrame:
    """The k symbols of highest and the k of lowest mean score over the best combinations."""
    g = _combos(long, top).groupBy("symbol", "category").agg(F.avg("sharpe").alias("avg_sharpe"), F.max("sharpe").alias("best"), F.min("sharpe").alias("worst"), F.stddev_pop("sharpe").alias("sd"))
    g = g.withColumn("consistency", F.col("avg_sharpe") / (F.col("sd") + 0.01)).drop("sd")
    rank = F.round("avg_sharpe", 9)
    sides = [g.orderBy(F.desc(rank), "symbol").limit(k).withColumn("side", F.lit("winner")), g.orderBy(rank, "symbol").limit(k).withColumn("side", F.lit("loser"))]
    return sides[0].unionAll(sides[1])


def sector_best(long: DataFrame) -> DataFrame:
    """By sector, the combination of highest mean score, ties to the first name."""
    rows = long.withColumn("combo", F.concat_ws("+", "model", F.concat(F.lit("h"), F.col("horizon").cast("string"))))
    g = rows.groupBy("category", "combo").agg(F.avg("sharpe").alias("avg_sharpe"), F.avg("max_dd").alias("avg_drawdown"))
    first = W.partitionBy("category").orderBy(F.desc(F.round("avg_sharpe", 9)), "combo")
    return g.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def best_by_horizon(long: DataFrame) -> DataFrame:
    """By horizon and symbol, the model of highest score (ties to the first name), then how often each model is it."""
    first = W.partitionBy("horizon", "symbol").orderBy(F.desc(F.round("sharpe", 9)), "model")
    best = long.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return best.groupBy("horizon", "model").agg(F.count("*").alias("wins"), F.avg("sharpe").alias("mean_sharpe"), F.max("total_return").alias("best_return"))


def low_importance(importance: DataFrame, share: float = 0.1) -> DataFrame:
    """feature, mean_importance -> those below this share of the largest."""
    return importance.withColumn("top", F.max("mean_importance").over(W.partitionBy(F.lit(0)))).filter(F.col("mean_importance") < share * F.col("top")).select("feature", "mean_importance")


def train_and_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """symbol, horizon, model, score of training and back-test -> matched, with what the score loses."""
    out = train.withColumnRenamed("score", "train_score").join(test.withColumnRenamed("score", "test_score"), ["symbol", "horizon", "model"])
    return out.withColumn("overfit_score", F.col("train_score") - F.col("test_score"))


def regression_metrics(scored: DataFrame) -> DataFrame:
    """y, p -> how many, root of the mean squared error, mean absolute error and R squared (null where y is constant)."""
    e = F.col("y") - F.col("p")
    g = scored.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("y")).alias("sst"))
    return g.select("n", "rmse", "mae", (1 - div("sse", "sst")).alias("r2"))


def exposure(positions: DataFrame, threshold: float = 0.1) -> DataFrame:
    """symbol, date, position -> share of days in the market, mean position, and changes of it beyond the threshold."""
    out = positions.withColumn("move", F.abs(F.col("position") - lag("position")))
    return out.groupBy("symbol").agg(F.avg((F.col("position") > 0.5).cast("double")).alias("time_in_market"), F.avg("position").alias("avg_position"), F.count_if(F.col("move") > threshold).alias("num_trades"))


def typical(bars: DataFrame) -> DataFrame:
    """Bars of a source without trades: vwap is the mean of high, low and close, transactions are 0."""
    return bars.select("symbol", "date", "open", "high", "low", "close", "volume", ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("vwap"), F.lit(0).cast("long").alias("transactions"))


def latest_observations(series: DataFrame) -> DataFrame:
    """name, date, value (text; "." or empty: missing) -> by series the latest value that is a number, and how many rows."""
    x = F.when(~F.col("value").isin(".", ""), F.col("value").try_cast("double"))
    return series.groupBy("name").agg(F.max_by("value", F.when(x.isNotNull(), F.col("date"))).try_cast("double").alias("latest"), F.max(F.when(x.isNotNull(), F.col("date"))).alias("latest_date"), F.count("*").alias("count"))


def spread(latest: DataFrame, long: str, short: str) -> DataFrame:
    """name, latest -> one series' latest value less another's; null if either is missing."""
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("latest")))
    return latest.agg((at(long) - at(short)).alias("term_spread"))


def daily_map(files: DataFrame) -> DataFrame:
    """symbol, body (JSON: date -> {open, close}) -> first and last close, change in percent, and how many days."""
    days = files.select("symbol", F.explode(F.from_json("body", "map<string,struct<open:double,close:double>>")).alias("date", "bar"))
    g = days.groupBy("symbol").agg(F.min_by("bar.close", "date").alias("first_close"), F.max_by("bar.close", "date").alias("last_close"), F.count("*").alias("num_bars"))
    return g.withColumn("change_pct", (div("last_close", "first_close") - 1) * 100)


def previous_close(bars: DataFrame) -> DataFrame:
    """By symbol: the last bar's close, the one before, and the change; of splits (a fall below half) the latest three."""
    out = bars.select("symbol", "date", "close", lag("close").alias("before"))
    g = out.groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max_by("before", "date").alias("prev_close"), F.count_if(F.col("close") < F.col("before") / 2).alias("splits"), F.array_join(F.slice(F.sort_array(F.collect_list(F.when(F.col("close") < F.col("before") / 2, F.col("date").cast("string"))), False), 1, 3), ",").alias("latest_splits"))
    return g.withColumn("change", F.col("close") - F.col("prev_close"))


def states_through_json(rows: DataFrame, schema: str) -> DataFrame:
    """rows as JSON objects and back: numbers, dates, nulls and names of an enumeration survive."""
    return rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), schema).alias("s")).select("s.*")


def half_even(rows: DataFrame, column: str, digits: int) -> DataFrame:
    """The column rounded half to even, as decimals."""
    return rows.withColumn(column, F.bround(F.col(column).cast("decimal(30,10)"), digits).cast("double"))


def clean(column: Column) -> Column:
    """Text without what isn't valid UTF-8 and without surrogate escapes written out; null: empty."""
    return F.coalesce(F.regexp_replace(F.make_valid_utf8(column), r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}|\x{FFFD}", ""), F.lit(""))


def summary_line(rows: DataFrame, width: int = 40) -> DataFrame:
    """id, name, value, text -> one line, its text cut at so many characters with an ellipsis."""
    short = F.when(F.length("text") > width, F.concat(F.left("text", F.lit(width)), F.lit("..."))).otherwise(F.coalesce("text", F.lit("")))
    return rows.select("id", F.concat_ws(" ", F.upper("name"), F.format_string("%.2f", F.col("value")), short).alias("line"))


def times(rows: DataFrame) -> DataFrame:
    """id and a moment as text in one of three forms (ISO with Z, epoch milliseconds, month-day-year with AM or PM) -> it
    in seconds since 1970, null for what is none of them."""
    t = F.col("moment")
    iso = F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    ms = F.when(t.rlike(r"^\d+$"), F.timestamp_millis(t.try_cast("long")))
    named = F.try_to_timestamp(F.concat(t, F.lit(" +00:00")), F.lit("MMM-dd-yy hh:mma XXX"))
    return rows.select("id", F.unix_seconds(F.coalesce(ms, iso, named)).alias("seconds"))
