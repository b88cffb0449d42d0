"""Features of a price series: one row a bar in, the same rows with more columns out. All windows run by symbol and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import YEAR, as_of, change, corr, div, flag, island, lag, last, mean, order, roll, so_far, std, whole
from candela.operators.sequences import order_statistics

ANNUAL = float(YEAR) ** 0.5


def returns(bars: DataFrame) -> DataFrame:
    """Lag returns, log return, and the gap from the last close."""
    gap = F.col("open") - lag("close")
    return bars.select(
        "symbol", "date",
        *[change("close", k).alias(f"return_{k}d") for k in (1, 5, 10, 20)],
        F.log(div("close", lag("close"))).alias("log_return_1d"),
        *[change("close", k).alias(f"momentum_{k}d") for k in (5, 10, 20)],
        gap.alias("gap"), div(gap, lag("close")).alias("gap_pct"), flag(gap > 0).alias("gap_up"), flag(gap < 0).alias("gap_down"),
    )


def moving_averages(bars: DataFrame) -> DataFrame:
    """Simple averages of 20, 50 and 200 bars, the price against them, and which lies above which."""
    out = bars.select("symbol", "date", "close", *[mean("close", k).alias(f"sma_{k}") for k in (20, 50, 200)])
    return out.select(
        "symbol", "date", "sma_20", "sma_50", "sma_200",
        *[(div("close", f"sma_{k}") - 1).alias(f"price_to_sma{k}") for k in (20, 50, 200)],
        flag(F.col("sma_20") > F.col("sma_50")).alias("sma20_cross_sma50"), flag(F.col("sma_50") > F.col("sma_200")).alias("sma50_cross_sma200"),
    )


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Relative strength index from simple averages of gains and losses; the first bar counts as no move."""
    delta = F.col("close") - lag("close")
    out = bars.withColumn("gain", F.when(delta > 0, delta).otherwise(0.0)).withColumn("loss", F.when(delta < 0, -delta).otherwise(0.0)).withColumn("shift", (div("close", lag("close", 20)) - 1) * 100)
    # sums of moves that are all zero are zero exactly, so a frame without losses is told from one with
    out = out.withColumn("g", mean("gain", period)).withColumn("l", mean("loss", period)).withColumn("lost", F.max("loss").over(last(period))).withColumn("won", F.max("gain").over(last(period)))
    value = F.when(F.col("lost") > 0, 100 - 100 / (1 + F.try_divide("g", "l"))).when(F.col("won") > 0, F.when(F.col("g").isNotNull(), F.lit(100.0)))
    out = out.withColumn("rsi", value)
    apart = F.col("shift") - F.col("rsi")
    return out.select("symbol", "date", "rsi", ((F.col("rsi") - 50) / 50).alias("rsi_normalized"), apart.alias("rsi_divergence"), (apart / 100).alias("rsi_divergence_normalized"))


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, population: bool = False) -> DataFrame:
    """Bands of so many deviations (sample or population) about the average, their width and the price's place in them."""
    m, s = mean("close", period), roll(F.stddev_pop if population else F.stddev_samp, "close", period)
    out = bars.select("symbol", "date", "close", m.alias("bb_middle"), (m + width * s).alias("bb_upper"), (m - width * s).alias("bb_lower"))
    return out.select("symbol", "date", "bb_upper", "bb_lower", "bb_middle", div(F.col("bb_upper") - F.col("bb_lower"), "bb_middle").alias("bb_width"), div(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")).alias("bb_position"))


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Average true range by simple average; the first bar's range is high less low."""
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    out = bars.withColumn("true_range", true_range)
    return out.select("symbol", "date", "true_range", mean("true_range", period).alias("atr"), div(mean("true_range", period), "close").alias("atr_normalized"))


def volume(bars: DataFrame) -> DataFrame:
    """Volume against its average of 20 bars and against earlier volume."""
    return bars.select("symbol", "date", mean("volume", 20).alias("volume_sma"), div("volume", mean("volume", 20)).alias("volume_ratio"), *[change("volume", k).alias(f"volume_momentum_{k}d") for k in (5, 10)])


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """Running sum of volume signed by the move of the close, and against its average of 50 bars."""
    move = F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("volume"), F.lit(0.0))
    out = bars.withColumn("move", move).withColumn("obv", F.sum("move").over(so_far()))
    return out.select("symbol", "date", "obv", div("obv", mean("obv", 50)).alias("obv_normalized"))


def volume_price_corr(bars: DataFrame, k: int = 10) -> DataFrame:
    return bars.select("symbol", "date", corr("close", "volume", k).alias(f"volume_price_corr_{k}d"))


def realized_vol(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 30, 60)) -> DataFrame:
    """Yearly deviation of log returns."""
    out = bars.withColumn("r", F.log(div("close", lag("close"))))
    return out.select("symbol", "date", *[(std("r", k) * ANNUAL).alias(f"realized_vol_{k}d") for k in spans])


def parkinson(bars: DataFrame) -> DataFrame:
    """Volatility from the range of high and low, and its yearly average of 20 bars."""
    out = bars.withColumn("parkinson_vol", F.sqrt(F.pow(F.log(div("high", "low")), 2) / (4 * F.log(F.lit(2.0)))))
    return out.select("symbol", "date", "parkinson_vol", (mean("parkinson_vol", 20) * ANNUAL).alias("parkinson_vol_20d"))


def vol_regime(bars: DataFrame) -> DataFrame:
    """Three bins of equal width over the whole series' range of 20-bar volatility, closed on the right. Looks ahead: the
    range is that of the whole series."""
    out = realized_vol(bars, (20,)).withColumnRenamed("realized_vol_20d", "v")
    low, high = F.min("v").over(whole()), F.max("v").over(whole())
    bin_ = F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(F.try_divide((F.col("v") - low) * 3, high - low)).cast("int")))
    out = out.withColumn("bin", F.when(F.col("v").isNotNull() & (high > low), bin_))
    return out.select("symbol", "date", F.col("v").alias("realized_vol_20d"), "bin", *[flag(F.col("bin") == i + 1).alias(f"vol_regime_{n}") for i, n in enumerate(("low", "medium", "high"))])


def streaks(bars: DataFrame) -> DataFrame:
    """Rates of change, and how many bars running the close has risen, or not risen."""
    out = bars.withColumn("up_days", flag(F.col("close") > lag("close")))
    out = out.withColumn("run", island(F.coalesce(F.col("up_days") != lag("up_days"), F.lit(True))))
    n = F.row_number().over(W.partitionBy("symbol", "run").orderBy("date")).cast("int")
    return out.select("symbol", "date", *[change("close", k).alias(f"roc_{k}d") for k in (5, 10, 20, 50)], "up_days", F.when(F.col("up_days") == 1, n).otherwise(0).alias("consecutive_ups"), F.when(F.col("up_days") == 0, n).otherwise(0).alias("consecutive_downs"))


def drawdowns(bars: DataFrame) -> DataFrame:
    """Fall from the year's highest close, and for how many bars the close has stood below it."""
    out = bars.withColumn("top", F.max("close").over(last(YEAR)))
    below = (F.col("close") < F.col("top")).cast("int")
    out = out.withColumn("below", below).withColumn("run", F.sum(1 - F.col("below")).over(so_far()))
    lasting = F.sum("below").over(W.partitionBy("symbol", "run").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return out.select("symbol", "date", div(F.col("close") - F.col("top"), "top").alias("drawdown"), lasting.cast("long").alias("drawdown_duration"))


def _over_market(market: DataFrame) -> DataFrame:
    """The market as a series of one symbol, so that its windows run on its own calendar."""
    return market.withColumn("symbol", F.lit("market"))


def market_relative(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Beta, alpha and relative strength against the market. The market's own windows run before it joins."""
    m = _over_market(market).withColumn("mr", change("close")).select("date", F.col("close").alias("mc"), "mr", roll(F.sum, "mr", 5).alias("m5"), roll(F.sum, "mr", 10).alias("m10"), roll(F.var_samp, "mr", 20).alias("mv"))
    out = bars.join(m, "date", "left").withColumn("r", change("close"))
    out = out.withColumn("cov", roll(F.covar_samp, "r", 20, None, "mr")).withColumn("rs", div("close", "mc"))
    return out.select("symbol", "date", div("cov", "mv").alias("beta_20d"), (change("close", 5) - F.col("m5")).alias("alpha_5d"), (change("close", 10) - F.col("m10")).alias("alpha_10d"), F.col("rs").alias("relative_strength"), change("rs", 20).alias("relative_strength_change"))


def seasonality(bars: DataFrame) -> DataFrame:
    """Calendar columns; Monday is day 0."""
    day, month = F.weekday("date"), F.month("date")
    return bars.select("symbol", "date", day.alias("day_of_week"), flag(day == 0).alias("is_monday"), flag(day == 4).alias("is_friday"), month.alias("month"), flag(month == 1).alias("is_january"), flag(month == 12).alias("is_december"), F.quarter("date").alias("quarter"))


def forward_targets(bars: DataFrame, horizons: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Returns still to come, whether they are positive, and their class of five (-1 where unknown). Looks ahead."""
    out = bars
    columns = ["symbol", "date"]
    for h in horizons:
        r = f"target_return_{h}d"
        out = out.withColumn(r, div(lag("close", -h), "close") - 1)
        c = F.col(r)
        klass = F.when(c.isNull(), -1).when(c <= -0.02, 0).when(c <= -0.005, 1).when(c <= 0.005, 2).when(c <= 0.02, 3).otherwise(4)
        columns += [r, flag(c > 0).alias(f"target_direction_{h}d"), klass.cast("double").alias(f"target_class_{h}d")]
    return out.select(*columns)


def volatility_index(bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Features of the volatility index as it stood on each bar's date."""
    out = as_of(bars.select("symbol", "date", "close"), vix)
    out = out.withColumn("change", F.col("vix") - lag("vix")).withColumn("pct", change("vix")).withColumn("r", change("close"))
    out = out.withColumn("ma20", mean("vix", 20, 1)).withColumn("ma50", mean("vix", 50, 1)).withColumn("sd20", std("vix", 20, 1)).withColumn("m60", mean("vix", 60, 20)).withColumn("s60", std("vix", 60, 20)).withColumn("c20", corr("r", "pct", 20, 10))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    level = F.col("vix")
    return out.select(
        "symbol", "date", zero("vix").alias("vix_level"), zero("change").alias("vix_change"), zero("pct").alias("vix_pct_change"), zero("ma20").alias("vix_ma_20"), zero("ma50").alias("vix_ma_50"), zero("sd20").alias("vix_std_20"),
        flag(level > F.col("m60") + 2 * F.col("s60")).alias("vix_spike"), F.when(level < 15, 0).when(level > 25, 2).otherwise(1).alias("vix_regime"), flag(level > F.col("ma20")).alias("vix_trend"), zero("c20").alias("stock_vix_correlation"),
    )


def macro_correlation(bars: DataFrame, panel: DataFrame, names: dict[str, str]) -> DataFrame:
    """Correlation with, and momentum against, named series (prefix -> name). Returns of a series are taken on its own
    calendar and then stand until its next date."""
    series = [_over_market(panel.filter(F.col("name") == name)).select("date", change("close").alias(f"{prefix}_r"), change("close", 20).alias(f"{prefix}_m")) for prefix, name in names.items()]
    out = as_of(bars.select("symbol", "date", "close"), *series)
    out = out.withColumn("r", change("close")).withColumn("m", change("close", 20))
    columns = []
    for p in names:
        columns += [corr("r", f"{p}_r", k).alias(f"{p}_corr_{k}d") for k in (10, 20, 50)] + [(F.col("m") - F.col(f"{p}_m")).alias(f"{p}_momentum_divergence")]
    out = out.select("symbol", "date", *columns)
    gold, oil = F.col("gold_corr_20d"), F.col("oil_corr_20d")
    return out.withColumn("macro_risk_off", flag((gold > 0.3) & (oil < -0.2))).withColumn("macro_risk_on", flag((oil > 0.3) & (gold < -0.2)))


def breadth(panel: DataFrame) -> DataFrame:
    """By date, how many series rose, fell and stood, and what follows from it."""
    move = panel.withColumn("symbol", F.col("name")).withColumn("r", change("close"))
    daily = move.groupBy("date").agg(F.count_if(F.col("r") > 0).alias("advancing"), F.count_if(F.col("r") < 0).alias("declining"), F.count_if(F.col("r") == 0).alias("unchanged"), F.avg("close").alias("close"))
    out = _over_market(daily).withColumn("ad_line", F.sum(F.col("advancing") - F.col("declining")).over(so_far()).cast("double")).withColumn("ad_ratio", F.col("advancing") / (F.col("declining") + 1))
    z = lambda c: div(F.col(c) - mean(c, 50), std(c, 50))
    return out.select("date", "advancing", "declining", "unchanged", "ad_line", "ad_ratio", mean("ad_line", 20).alias("ad_line_ma20"), mean("ad_ratio", 20).alias("ad_ratio_ma20"), (F.col("ad_line") - lag("ad_line", 10)).alias("breadth_momentum_10d"), (z("close") - z("ad_line")).alias("breadth_divergence"), flag(F.col("ad_ratio") > 1.5).alias("breadth_strong"), flag(F.col("ad_ratio") < 0.67).alias("breadth_weak"))


def options_proxy(bars: DataFrame) -> DataFrame:
    """Percentile of 30-bar volatility within its year, and regimes from it."""
    out = bars.withColumn("r", change("close"))
    for k in (10, 30, 60):
        out = out.withColumn(f"v{k}", std("r", k) * ANNUAL)
    out = order_statistics(out.select("symbol", "date", "r", "v10", "v30", "v60"), "v30", YEAR)
    enough = F.col("__held") >= 60
    out = out.withColumn("vol_percentile", F.when(enough, F.col("__below") / F.col("__held") * 100)).withColumn("median", F.when(enough, F.col("__median")))
    high, low = F.coalesce(F.col("vol_percentile") > 75, F.lit(False)), F.coalesce(F.col("vol_percentile") < 25, F.lit(False))
    return out.select("symbol", "date", "vol_percentile", flag(high).alias("vol_regime_high"), flag(low).alias("vol_regime_low"), flag(F.col("v10") > F.col("v30")).alias("vol_expansion"), flag(F.col("v10") < F.col("v30")).alias("vol_contraction"), div("v10", F.col("v60") + 1e-6).alias("vol_term_structure"), flag(F.col("v30") > 2 * F.col("median")).alias("vol_spike"), div("r", F.col("v30") / ANNUAL + 1e-6).alias("vol_adjusted_return"), flag(high & (F.col("r") < 0)).alias("vol_fear"), flag(low & (F.col("r") > 0)).alias("vol_complacency"))


def market_risk(market: DataFrame, vix: DataFrame) -> DataFrame:
    """The twelve features of the market's risk, from data up to each date."""
    out = as_of(_over_market(market).select("symbol", "date", "close"), vix).withColumn("r", change("close")).withColumn("vr", change("vix"))
    out = order_statistics(out, "vix", YEAR)
    out = out.withColumn("rv5", std("r", 5) * ANNUAL).withColumn("rv20", std("r", 20) * ANNUAL).withColumn("top10", roll(F.max, "close", 10))
    return out.select(
        "date", F.col("vix").alias("vix_level"), div(F.col("vix") - mean("vix", 60), std("vix", 60)).alias("vix_zscore_60d"), change("vix", 5).alias("vix_roc_5d"), change("vix", 20).alias("vix_roc_20d"), F.when(F.col("__held") >= YEAR, F.col("__below") / (YEAR - 1)).alias("vix_percentile_252d"),
        std("vr", 20).alias("vol_of_vix_20d"), F.col("rv5").alias("rv_5d"), F.col("rv20").alias("rv_20d"), div("rv5", "rv20").alias("vol_ratio_5_20"), div(F.col("vix") / 100, "rv20").alias("vrp"), change("close", 5).alias("spy_ret_5d"), div(F.col("close") - F.col("top10"), "top10").alias("trailing_dd_10d"),
    )


def market_risk_targets(market: DataFrame, threshold: float = 0.03, ahead: int = 10) -> DataFrame:
    """Deepest fall, whether it passes the threshold, and deviation of returns over the next bars. Looks ahead. Rows with
    fewer bars to come have no fall and flag 0."""
    out = _over_market(market).withColumn("r", change("close"))
    over = order().rowsBetween(1, ahead)
    full = F.count("close").over(over) >= ahead
    out = out.withColumn("fwd_max_dd", F.when(full, 1 - div(F.min("close").over(over), "close"))).withColumn("fwd_realized_vol", F.when(full, F.stddev_pop("r").over(over) * ANNUAL))
    return out.select("date", "fwd_max_dd", flag(F.col("fwd_max_dd") > threshold).cast("double").alias("drawdown_flag"), "fwd_realized_vol")


def quarterly_growth(quarters: DataFrame) -> DataFrame:
    """symbol, quarter (a date) and value -> growth against the quarter before and a year before, over the size of that
    value; no growth from nothing."""
    order = W.partitionBy("symbol").orderBy("quarter")
    grown = lambda k: div(F.col("value") - F.lag("value", k).over(order), F.abs(F.nullif(F.lag("value", k).over(order), F.lit(0.0))))
    return quarters.select("symbol", "quarter", "value", grown(1).alias("qoq"), grown(4).alias("yoy"))


def vol_predictor(bars: DataFrame, vix: DataFrame, delay: int = 1) -> DataFrame:
    """What the volatility predictor sees on a date: everything `delay` bars old. The index is taken on the bars' own dates
    only and then stands."""
    out = bars.select("symbol", "date", "close").join(vix, "date", "left")
    out = out.withColumn("v", F.last("vix", ignorenulls=True).over(so_far())).withColumn("r", change("close")).withColumn("a", F.abs("r"))
    out = out.withColumn("velocity", F.col("v") - lag("v", 5))
    for k in (5, 10, 20, 60):
        out = out.withColumn(f"rv{k}", std("r", k) * ANNUAL)
    limit = F.when(F.count("a").over(last(60)) >= 60, F.percentile("a", F.lit(0.95)).over(last(60)))
    out = out.withColumn("extreme", flag(F.col("a") > limit)).withColumn("low60", roll(F.min, "rv20", 60)).withColumn("sd60", std("v", 60)).withColumn("m60", mean("v", 60)).withColumn("sma10", mean("v", 10)).withColumn("sma50", mean("close", 50)).withColumn("top60", roll(F.max, "close", 60)).withColumn("acceleration", F.col("velocity") - lag("velocity", 5))
    seen = {
        "vix": F.col("v"), "vix_zscore": div(F.col("v") - F.col("m60"), F.col("sd60") + 1e-10), "vix_mom_5": change("v", 5), "vix_mom_10": change("v", 10), "vix_vs_sma": div("v", "sma10") - 1, "vix_acceleration": F.col("acceleration"),
        **{f"rvol_{k}": F.col(f"rv{k}") for k in (5, 10, 20, 60)}, "vol_mom": div("rv20", "rv60") - 1, "vol_compression": div("rv20", F.col("low60") + 1e-10) - 1, "sma_deviation": div("close", "sma50") - 1, "drawdown": div("close", "top60") - 1, "return_5d": change("close", 5), "return_20d": change("close", 20), "extreme_days_5": roll(F.sum, "extreme", 5).cast("double"),
    }
    now = out.select("symbol", "date", *[c.alias(n) for n, c in seen.items()])
    return now.select("symbol", "date", *[lag(n, delay).alias(n) for n in seen])


def vol_regime_targets(bars: DataFrame, back: int = 60, ahead: int = 5, delay: int = 1) -> DataFrame:
    """Whether volatility is below or above its median, and whether it leaves that side over the next bars. Looks ahead."""
    out = bars.withColumn("r", change("close")).withColumn("rv", std("r", 20) * ANNUAL).withColumn("current_vol", lag("rv", delay))
    out = out.withColumn("vol_median", F.when(F.count("current_vol").over(last(back)) >= back, F.percentile("current_vol", F.lit(0.5)).over(last(back))))
    coming = order().rowsBetween(1, ahead)
    out = out.withColumn("future", F.when(F.count("r").over(coming) >= ahead, F.stddev_samp("r").over(coming) * ANNUAL))
    low, high = F.col("current_vol") <= F.col("vol_median"), F.col("current_vol") > F.col("vol_median")
    rises, falls = F.col("future") > F.col("vol_median"), F.col("future") <= F.col("vol_median")
    both = lambda a, b: flag(F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False)))
    return out.select("symbol", "date", flag(low).alias("current_low"), flag(high).alias("current_high"), both(low, rises).alias("spike_target"), both(high, falls).alias("calm_target"), "current_vol", "vol_median")


def rolling_beta(bars: DataFrame, market: DataFrame, k: int = 60) -> DataFrame:
    """By symbol: the last rolling beta and fit, beta over all, and how the rolling beta has spread and moved of late."""
    m = market.select("date", F.col("close").alias("mc"))
    out = bars.join(m, "date").withColumn("r", change("close")).withColumn("mr", change("mc")).filter("r is not null and mr is not null")
    over = last(k)
    out = out.withColumn("cov", F.covar_samp("r", "mr").over(over)).withColumn("var", F.var_samp("mr").over(over)).withColumn("own", F.var_samp("r").over(over)).withColumn("n", F.count("*").over(over))
    out = out.withColumn("beta", F.when(F.col("n") >= k, div("cov", "var"))).withColumn("r2", F.when(F.col("n") >= k, div(F.pow("cov", F.lit(2)), F.col("var") * F.col("own"))))
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    out = out.withColumn("back", back)
    g = out.groupBy("symbol").agg(
        F.max_by("beta", "date").alias("current_beta"), F.max_by("r2", "date").alias("current_r2"), (F.covar_samp("r", "mr") / F.var_samp("mr")).alias("full_beta"), F.pow(F.corr("r", "mr"), 2).alias("full_r2"),
        F.avg("beta").alias("beta_mean"), F.stddev_samp("beta").alias("beta_std"), F.min("beta").alias("beta_min"), F.max("beta").alias("beta_max"), F.count("beta").alias("n_beta"),
        F.avg(F.when(F.col("back") <= 20, F.col("beta"))).alias("recent"), F.avg(F.when(F.col("back").between(21, 40), F.col("beta"))).alias("older"),
    )
    before = F.when(F.col("n_beta") >= 40, F.col("older")).otherwise(F.col("beta_mean"))
    trend = F.when(F.col("n_beta") < 20, "unknown").when(F.col("recent") > before + 0.05, "rising").when(F.col("recent") < before - 0.05, "falling").otherwise("stable")
    b = F.col("current_beta")
    label = F.when(b >= 1.5, "very high").when(b >= 1.2, "high").when(b >= 0.8, "market").when(b >= 0.5, "low").when(b >= 0, "very low").otherwise("negative")
    return g.select("symbol", "current_beta", "current_r2", "full_beta", "full_r2", "beta_mean", "beta_std", F.when(F.abs("beta_mean") > 0.01, F.abs(F.col("beta_std") / F.col("beta_mean"))).alias("beta_cv"), "beta_min", "beta_max", trend.alias("beta_trend"), label.alias("beta_label"))


SPANS = {21: 0.1, 63: 0.2, 126: 0.3, 252: 0.4}


def relative_strength(bars: DataFrame, market: DataFrame) -> DataFrame:
    """By symbol, its return less the market's between the last bar and the one `span` bars from the end, for several
    spans, and their weighted mean over the spans there are."""
    m = market.select("date", F.col("close").alias("mc"))
    out = bars.join(m, "date").withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    at = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    g = out.groupBy("symbol").agg(*[(at("close", 1) / at("close", k) - at("mc", 1) / at("mc", k)).alias(f"rs_{k}d") for k in SPANS])
    there = [F.when(F.col(f"rs_{k}d").isNotNull(), F.lit(w)).otherwise(0.0) for k, w in SPANS.items()]
    total, weight = sum(F.coalesce(F.col(f"rs_{k}d"), F.lit(0.0)) * w for k, w in SPANS.items()), sum(there[1:], there[0])
    out = g.withColumn("composite", F.try_divide(total, weight))
    return out.withColumn("label", F.when(F.col("composite") > 0.05, "leader").when(F.col("composite") < -0.05, "laggard").otherwise("in line"))


def hmm_features(bars: DataFrame) -> DataFrame:
    """Inputs of the hidden-state model: rows where all are known."""
    out = bars.withColumn("log_return", F.log(div("close", lag("close"))))
    out = out.withColumn("realized_vol", std("log_return", 20) * ANNUAL).withColumn("ma", mean("close", 50)).withColumn("volume_ratio", div("volume", mean("volume", 20)))
    out = out.select("symbol", "date", "close", "log_return", "realized_vol", div("log_return", F.col("realized_vol") / ANNUAL).alias("vol_norm_return"), div(F.col("close") - F.col("ma"), "ma").alias("trend_strength"), "volume_ratio", F.log("volume_ratio").alias("log_volume_ratio"))
    return out.na.drop()


def wasserstein_features(bars: DataFrame, k: int = 20) -> DataFrame:
    """Inputs of the distribution clustering: rows where all are known."""
    out = bars.withColumn("returns", change("close")).withColumn("log_returns", F.log(div("close", lag("close"))))
    out = out.withColumn("realized_vol", std("returns", k)).withColumn("volume_ma", mean("volume", k))
    out = out.select("symbol", "date", "returns", "log_returns", "realized_vol", F.abs(mean("returns", k)).alias("trend_strength"), "volume_ma", div(F.col("volume") - F.col("volume_ma"), F.col("volume_ma") + 1e-10).alias("volume_momentum"), change("close", 10).alias("momentum_10d"), change("close", 20).alias("momentum_20d"), div(F.col("high") - F.col("low"), "close").alias("hl_range"), div("returns", F.col("realized_vol") + 1e-10).alias("vol_adj_returns"))
    return out.na.drop()


def regime_labels(bars: DataFrame) -> DataFrame:
    """Labels 0, 1, 2 below, between and above the whole series' 33 and 67 percent quantiles of 20-bar deviation, and flags
    that follow. Looks ahead: the quantiles are those of the whole series."""
    out = bars.withColumn("r", change("close")).withColumn("v", std("r", 20))
    cut = lambda q: F.percentile("v", F.lit(q)).over(whole())
    out = out.withColumn("a", cut(0.33)).withColumn("b", cut(0.67))
    out = out.withColumn("regime", F.when(F.col("v") < F.col("a"), 0).when(F.col("v") > F.col("b"), 2).otherwise(1))
    moved = F.abs(F.col("regime") - lag("regime"))
    out = out.withColumn("moved", moved)
    ahead = order().rowsBetween(0, W.unboundedFollowing)
    return out.select("symbol", "date", "regime", flag(F.col("regime") == 2).alias("regime_trend_bull"), flag(F.col("regime") == 0).alias("regime_trend_bear"), F.coalesce(F.first("moved", ignorenulls=True).over(ahead), F.lit(1)).cast("double").alias("regime_change"))


def sentiment(bars: DataFrame, scores: DataFrame) -> DataFrame:
    """scores: symbol, date, sentiment_score, sentiment_count. Days without news are neutral."""
    out = bars.select("symbol", "date").join(scores, ["symbol", "date"], "left").withColumn("s", F.coalesce("sentiment_score", F.lit(0.0))).withColumn("n", F.coalesce("sentiment_count", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("symbol", "date", F.col("s").alias("sentiment_score"), F.col("n").cast("long").alias("sentiment_count"), zero(F.col("s") - lag("s", 3)).alias("sentiment_momentum_3d"), zero(F.col("s") - lag("s", 7)).alias("sentiment_momentum_7d"), zero(std("s", 14)).alias("sentiment_volatility"), flag(F.col("s") > 0).alias("sentiment_positive"), flag(F.abs("s") > 0.5).alias("sentiment_extreme"), (F.abs("s") * F.log1p("n")).alias("sentiment_strength"))


def equity_curve(bars: DataFrame) -> DataFrame:
    """Growth of one unit held from the first bar on, its peak, its fall from it and the deepest so far."""
    out = bars.withColumn("r", F.coalesce(change("close"), F.lit(0.0))).withColumn("equity", F.product(1 + F.col("r")).over(so_far()))
    out = out.withColumn("peak", F.max("equity").over(so_far())).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    return out.select("symbol", "date", "equity", "peak", "drawdown", F.min("drawdown").over(so_far()).alias("max_drawdown"))


def position_returns(positions: DataFrame, cost: float = 0.001) -> DataFrame:
    """symbol, date, close, position -> the return of yesterday's position less the cost of today's change of it."""
    out = positions.withColumn("r", change("close")).withColumn("traded", F.coalesce(F.abs(F.col("position") - lag("position")), F.lit(0.0)))
    net = F.coalesce(lag("position") * F.col("r"), F.lit(0.0)) - F.col("traded") * cost
    return out.select("symbol", "date", "position", "traded", net.alias("net_return"))
