"""Performance, trade and cross-section aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import YEAR, change, div, lag, so_far

ROOT = float(YEAR) ** 0.5


def with_curve(returns: DataFrame) -> DataFrame:
    """symbol, date, r -> with growth (cum) and fall from its peak (dd). Growth starts with the first return, so a first
    loss is no fall."""
    out = returns.filter("r is not null").withColumn("cum", F.product(1 + F.col("r")).over(so_far()))
    return out.withColumn("dd", F.col("cum") / F.max("cum").over(so_far()) - 1)


def daily(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", change("close").alias("r"))


def ml_metrics(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """By symbol (symbol, date, r against date, m): growth over all and by year, Sharpe ratio, deepest fall, win rate, beta, alpha
    and the benchmark's growth on the symbol's own dates, where a missing m counts as 0. num_trades counts how often
    `position`, where returns has such a column, differs from the one before (at first from none); without it there are 0.
    What would divide by zero is 0."""
    by = W.partitionBy("symbol").orderBy("date")
    moved = F.col("position") != F.coalesce(F.lag("position").over(by), F.lit(0)) if "position" in returns.columns else F.lit(False)
    out = with_curve(returns.withColumn("moved", moved)).join(benchmark.select("date", "m"), "date", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    g = out.groupBy("symbol").agg(F.product(1 + F.col("r")).alias("growth"), F.product(1 + F.col("m")).alias("market"), F.count("*").alias("num_days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("dd").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.covar_samp("r", "m").alias("cov"), F.var_samp("m").alias("var"), F.count_if("moved").alias("num_trades"))
    year = lambda c: F.pow(c, YEAR / F.col("num_days")) - 1
    beta = F.coalesce(div("cov", "var"), F.lit(0.0))
    return g.select("symbol", (F.col("growth") - 1).alias("total_return"), year("growth").alias("annualized_return"), F.coalesce(div("mean", "sd") * ROOT, F.lit(0.0)).alias("sharpe_ratio"), "max_drawdown", "win_rate", "num_trades", "num_days", beta.alias("beta"), (year("growth") - beta * year("market")).alias("alpha"), (F.col("market") - 1).alias("benchmark_return"))


def portfolio_metrics(returns: DataFrame, trades: DataFrame) -> DataFrame:
    """Of the equal-weighted portfolio (symbol, date, r) and all trades (pnl, holding_days, commission, slippage): growth,
    volatility, Sharpe, Sortino and Calmar ratios, profit factor, duration and costs. Falls count from the capital put in, so
    a first loss is one. Deviations are of a population; what would divide by zero is 0."""
    one = returns.filter("r is not null").groupBy("date").agg(F.avg("r").alias("r")).withColumn("symbol", F.lit("portfolio"))
    out = with_curve(one).withColumn("dd", F.col("cum") / F.greatest(F.lit(1.0), F.max("cum").over(so_far())) - 1)
    g = out.agg(F.product(1 + F.col("r")).alias("growth"), F.count("*").alias("days"), F.stddev_pop("r").alias("sd"), F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.min("dd").alias("dd"))
    won = F.col("pnl") > 0
    part = lambda fn, c: F.coalesce(fn(F.when(c, F.col("pnl"))), F.lit(0.0))
    t = trades.agg(F.count("*").alias("num_trades"), F.avg(won.cast("double")).alias("win_rate"), part(F.avg, won).alias("avg_win"), part(F.avg, ~won).alias("avg_loss"), F.abs(F.coalesce(div(part(F.sum, won), part(F.sum, ~won)), F.lit(0.0))).alias("profit_factor"), F.avg("holding_days").alias("avg_trade_duration"), F.sum("commission").alias("total_commission"), F.sum("slippage").alias("total_slippage"))
    year = F.pow("growth", YEAR / F.col("days")) - 1
    over = lambda x, y: F.coalesce(div(x, y), F.lit(0.0))
    return g.join(t).select((F.col("growth") - 1).alias("total_return"), year.alias("annualized_return"), (F.col("sd") * ROOT).alias("volatility"), over(year - 0.02, F.col("sd") * ROOT).alias("sharpe_ratio"), over(year - 0.02, F.col("down") * ROOT).alias("sortino_ratio"), F.abs("dd").alias("max_drawdown"), over(year, F.abs("dd")).alias("calmar_ratio"), *t.columns)


def sharpe(kind: str, r: str | Column = "r") -> Column:
    """An aggregate by one of four definitions. Yearly growth is that of the mean log return."""
    x = F.col(r) if isinstance(r, str) else r
    year = F.avg(F.log1p(x)) * YEAR
    return {
        "ml": div(F.avg(x), F.stddev_samp(x)) * ROOT,
        "portfolio": div(year - 0.02, F.stddev_pop(x) * ROOT),
        "detector": div(year, F.stddev_samp(x) * ROOT),
        "study": div(year, F.stddev_pop(x) * ROOT),
    }[kind]


def sharpe_variants(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(*[sharpe(k).alias(f"sharpe_{k}") for k in ("ml", "portfolio", "detector", "study")])


def trade_stats(trades: DataFrame) -> DataFrame:
    """Of all trades; means skip what is missing."""
    won = F.col("pnl") > 0
    return trades.agg(F.count("*").alias("sample_size"), F.count_if(won).alias("num_winners"), F.count_if(~won).alias("num_losers"), F.avg(won.cast("double")).alias("win_rate"), F.avg("pnl_pct").alias("avg_return_pct"), F.sum("pnl").alias("total_pnl"), F.coalesce(F.avg(F.when(won, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_winner_pct"), F.coalesce(F.avg(F.when(~won, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_loser_pct"), F.avg("holding_days").alias("avg_holding_days"))


def trade_cohorts(trades: DataFrame) -> DataFrame:
    """By symbol, tier and regime, missing ones named so: size, win rate, span and a verdict."""
    by = [F.coalesce(c, F.lit(f"unknown_{c}")).alias(c) for c in ("tier", "vol_regime")]
    g = trades.groupBy("symbol", *by).agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl_pct").alias("avg_return_pct"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    verdict = F.when(F.col("n") < 5, "insufficient").when(F.col("win_rate") >= 0.6, "favorable").when(F.col("win_rate") <= 0.4, "unfavorable").otherwise("mixed")
    return g.withColumn("verdict", verdict)


def long_metrics(brands: DataFrame, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """By symbol, horizon and model, the metrics that cross-section reports read. The models are simple rules on monthly
    bars: hold, follow the last return, fade it, stand by a three-month average."""
    out = brands.select("symbol", "date", "close", change("close").alias("r")).withColumn("above", F.col("close") > F.avg("close").over(W.partitionBy("symbol").orderBy("date").rowsBetween(-2, 0)))
    rules = {"hold": F.lit(1.0), "follow": (F.col("r") > 0).cast("double"), "fade": (F.col("r") <= 0).cast("double"), "trend": F.col("above").cast("double")}
    out = out.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("p")) for k, v in rules.items()])))
    out = out.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    by = W.partitionBy("symbol", "rule.model", "horizon").orderBy("date")
    held = F.coalesce(*[F.when(F.col("horizon") == h, F.lag("rule.p", h).over(by)) for h in horizons])
    out = out.select("symbol", "horizon", F.col("rule.model").alias("model"), "date", (held * F.col("r")).alias("r")).filter("r is not null")
    curve = W.partitionBy("symbol", "model", "horizon").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("cum", F.product(1 + F.col("r")).over(curve)).withColumn("dd", F.col("cum") / F.max("cum").over(curve) - 1)
    g = out.groupBy("symbol", "horizon", "model").agg((F.max_by("cum", "date") - 1).alias("total_return"), F.coalesce(div(F.avg("r"), F.stddev_samp("r")) * 12**0.5, F.lit(0.0)).alias("sharpe"), F.min("dd").alias("max_dd"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))
    return g.withColumn("category", F.concat(F.lit("cat"), F.pmod(F.substring_index("symbol", "#", -1).cast("int"), F.lit(4)).cast("string")))


def cross_stock(long: DataFrame) -> DataFrame:
    """By horizon and model over all symbols."""
    return long.groupBy("horizon", "model").agg(F.avg("total_return").alias("mean_return"), F.percentile("total_return", F.lit(0.5)).alias("median_return"), F.stddev_pop("total_return").alias("std_return"), F.avg("sharpe").alias("mean_sharpe"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"), F.avg("max_dd").alias("mean_max_dd"), F.avg("win_rate").alias("mean_win_rate"), F.count("*").alias("num_stocks"))


def best_by_category(long: DataFrame) -> DataFrame:
    """By category, the model of highest mean Sharpe, ties to the first name; and how often it beats holding."""
    hold = long.filter("model = 'hold'").select("symbol", "horizon", F.col("total_return").alias("bh"))
    out = long.join(hold, ["symbol", "horizon"])
    g = out.groupBy("category", "model").agg(F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("total_return") > F.col("bh")).cast("double")).alias("beats"))
    first = W.partitionBy("category").orderBy(F.desc(F.round("mean_sharpe", 9)), "model")
    return g.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def overfit_worst(long: DataFrame, k: int = 3) -> DataFrame:
    """By model, the k symbols whose score falls most from the shorter to the longer horizon."""
    p = long.groupBy("model", "symbol").agg(F.max(F.when(F.col("horizon") == 1, F.col("sharpe"))).alias("train"), F.max(F.when(F.col("horizon") == 3, F.col("sharpe"))).alias("test"))
    p = p.withColumn("overfit_score", F.col("train") - F.col("test"))
    return p.withColumn("place", F.row_number().over(W.partitionBy("model").orderBy(F.desc(F.round("overfit_score", 9)), "symbol"))).filter(F.col("place") <= k)


def leaderboard(bars: DataFrame) -> DataFrame:
    """Symbols of the latest date, by that day's return."""
    out = bars.select("symbol", "date", change("close").alias("r"))
    latest = out.agg(F.max("date").alias("date"))
    out = out.join(F.broadcast(latest), "date")
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("r"), "symbol")))


def importance(long: DataFrame) -> DataFrame:
    """A map of metric to value by row is taken apart; by metric, its mean and largest size, and a category by name."""
    out = long.withColumn("m", F.create_map(*[x for c in ("total_return", "sharpe", "max_dd", "win_rate") for x in (F.lit(c), F.abs(F.col(c)))]))
    out = out.select("horizon", F.explode("m").alias("feature", "value"))
    category = F.when(F.col("feature").rlike("return|sharpe"), "performance").when(F.col("feature").rlike("dd|drawdown"), "risk").otherwise("other")
    return out.groupBy("feature").agg(F.avg("value").alias("mean_importance"), F.max("value").alias("max_importance"), F.count_distinct("horizon").alias("horizons")).withColumn("category", category)


def pairs(long: DataFrame) -> DataFrame:
    """How often two models both beat holding on a symbol and horizon: pairs of a row's set, each once. The set has no more
    members than there are models."""
    hold = long.filter("model = 'hold'").select("symbol", "horizon", F.col("total_return").alias("bh"))
    good = long.join(hold, ["symbol", "horizon"]).filter("model != 'hold' AND total_return >= bh").groupBy("symbol", "horizon").agg(F.array_sort(F.collect_set("model")).alias("models"))
    two = good.select("symbol", F.explode("models").alias("a"), "models").select("symbol", "a", F.explode("models").alias("b")).filter("a < b")
    return two.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


def consistency(long: DataFrame) -> DataFrame:
    """By model, 100 times 0.4 of the share of gains, 0.3 of stability and 0.3 of performance."""
    g = long.groupBy("model").agg(F.avg((F.col("total_return") > 0).cast("double")).alias("positive"), F.avg("sharpe").alias("m"), F.stddev_pop("sharpe").alias("s"))
    stable = 1 / (1 + F.col("s"))
    good = F.least(F.greatest(F.col("m"), F.lit(0.0)), F.lit(1.0))
    return g.select("model", "positive", stable.alias("stability"), good.alias("performance"), ((0.4 * F.col("positive") + 0.3 * stable + 0.3 * good) * 100).alias("consistency"))


def capture(bars: DataFrame, market: DataFrame) -> DataFrame:
    """By symbol, what it takes part in of the market's rises and falls, its share of volatility, beta and correlation. The
    covariance is of a sample and the variance of a population, as in the study."""
    m = market.withColumn("symbol", F.lit("market")).select("date", change("close").alias("m"))
    out = bars.select("symbol", "date", change("close").alias("r")).join(m, "date").filter("r is not null and m is not null")
    side = lambda c, up: F.avg(F.when(F.col("m") > 0 if up else F.col("m") < 0, F.col(c)))
    return out.groupBy("symbol").agg(div(side("r", True), side("m", True)).alias("upside_capture"), div(side("r", False), side("m", False)).alias("downside_capture"), div(F.stddev_samp("r"), F.stddev_samp("m")).alias("vol_ratio"), div(F.covar_samp("r", "m"), F.var_pop("m")).alias("beta"), F.corr("r", "m").alias("corr"))


def corr_buckets(brands: DataFrame) -> DataFrame:
    """Symbols by their correlation with the mean of all (0 with under 50 rows), and the buckets' means."""
    out = brands.select("symbol", "date", change("close").alias("r")).filter("r is not null")
    mean = out.groupBy("date").agg(F.avg("r").alias("m"))
    g = out.join(mean, "date").groupBy("symbol").agg(F.when(F.count("*") >= 50, F.corr("r", "m")).otherwise(0.0).alias("corr"), F.avg(F.log1p("r")).alias("growth"))
    bucket = F.when(F.col("corr") < 0.1, "low").when(F.col("corr") < 0.2, "medium").otherwise("high")
    return g.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("corr").alias("mean_corr"), F.avg("growth").alias("mean_growth"), F.avg((F.col("growth") > 0).cast("double")).alias("win_share"))


PERIODS = [("early", "1995-01-01", "1996-12-31", "train"), ("middle", "1997-01-01", "1998-12-31", "train"), ("late", "1999-01-01", "2001-12-31", "test")]


def scorecard(positions: DataFrame, periods: DataFrame) -> DataFrame:
    """symbol, date, r (of holding), s (of the strategy) by named periods, both ends included: log growth of either and by
    label how often the strategy is ahead. Periods are few and broadcast."""
    out = positions.join(F.broadcast(periods), F.col("date").between(F.col("start"), F.col("end")))
    g = out.groupBy("symbol", "period", "label").agg(F.sum(F.log1p("r")).alias("bh"), F.sum(F.log1p("s")).alias("st"))
    return g.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("st") > F.col("bh")).alias("beats"), F.avg("st").alias("avg_strategy"), F.avg("bh").alias("avg_hold"), F.avg(F.col("st") - F.col("bh")).alias("avg_excess"))


def volume_spikes(bars: DataFrame) -> DataFrame:
    """By symbol: mean and latest volume, their ratio, and which of the last ten bars stand above twice the mean."""
    out = bars.withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    g = out.groupBy("symbol").agg(F.avg("volume").alias("avg_volume"), F.max_by("volume", "date").alias("latest_volume"), F.collect_list(F.when(F.col("back") <= 10, F.col("volume"))).alias("ten"), F.count("*").alias("num_bars"))
    ratio = F.col("latest_volume") / F.col("avg_volume")
    condition = F.when(ratio > 2, "very high").when(ratio > 1.5, "high").when(ratio > 0.8, "normal").when(ratio > 0.5, "low").otherwise("very low")
    return g.select("symbol", "num_bars", "avg_volume", "latest_volume", ratio.alias("volume_ratio"), F.size(F.filter("ten", lambda v: v > 2 * F.col("avg_volume"))).alias("spikes"), condition.alias("condition"))


def put_call(events: DataFrame) -> DataFrame:
    """Options by day, told from events: purchases as calls, errors as puts, k as open interest, value as volume."""
    k = F.get_json_object("props", "$.k").cast("long")
    put, call = F.col("event_type") == "error", F.col("event_type") == "purchase"
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0).cast("double"))
    g = events.groupBy(F.col("ts").cast("date").alias("date")).agg(total(put, F.col("value")).alias("put_volume"), total(call, F.col("value")).alias("call_volume"), total(put, k.cast("double")).alias("put_oi"), total(call, k.cast("double")).alias("call_oi"), F.avg(F.when(k > 0, k.cast("double"))).alias("avg_iv"))
    return g.withColumn("put_call_volume", div("put_volume", "call_volume")).withColumn("put_call_oi", div("put_oi", "call_oi"))


def tone(events: DataFrame) -> DataFrame:
    """By type, the mean of the histogram of k, weighted by value."""
    k = F.get_json_object("props", "$.k").cast("double")
    g = events.groupBy("event_type", k.alias("bin")).agg(F.sum("value").alias("weight"), F.count("*").alias("n"))
    return g.groupBy("event_type").agg(div(F.sum(F.col("bin") * F.col("weight")), F.sum("weight")).alias("tone"), F.sum("n").alias("n"))


def classification(scored: DataFrame) -> DataFrame:
    """y, p (score), predicted -> accuracy, precision, recall, F1, Brier score."""
    y, g = F.col("y") == 1, F.col("predicted") == 1
    out = scored.agg(F.count("*").alias("n"), F.count_if(y & g).alias("tp"), F.count_if(~y & g).alias("fp"), F.count_if(y & ~g).alias("fn"), F.count_if(~y & ~g).alias("tn"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    precision, recall = div("tp", F.col("tp") + F.col("fp")), div("tp", F.col("tp") + F.col("fn"))
    return out.select("n", "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), F.coalesce(precision, F.lit(0.0)).alias("precision"), F.coalesce(recall, F.lit(0.0)).alias("recall"), F.coalesce(div(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "brier")


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by ranks of scores, ties sharing their mean rank. Scores are counted first, so the running sum
    is over different scores and not over rows."""
    c = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    g = c.agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return g.select(div(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("roc_auc"), F.col("np").cast("long").alias("positives"), F.col("nn").cast("long").alias("negatives"))


def lagged(positions: DataFrame) -> DataFrame:
    """symbol, date, close, position -> r and s, the returns of holding and of yesterday's position."""
    out = positions.withColumn("r", change("close"))
    return out.select("symbol", "date", "r", (lag("position") * F.col("r")).alias("s")).filter("r is not null")
