"""Strategies by name, actions by regime and position, studies of parameter sets, calls repeated after failures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.frames import lag, order
from candela.operators import sequences as q

T = TypeVar("T")

# What to do by model, regime and position; False: not in long-only accounts. All else holds.
ACTIONS = [
    ("wasserstein", "low_vol", "flat", "buy", True), ("wasserstein", "low_vol", "short", "cover", False), ("wasserstein", "high_vol", "long", "sell", True), ("wasserstein", "high_vol", "flat", "short", False),
    ("hmm", "bullish", "flat", "buy", True), ("hmm", "bullish", "short", "cover", False), ("hmm", "bearish", "long", "sell", True), ("hmm", "bearish", "flat", "short", False),
]
# Below this index level, the position without and with good odds of a calm.
EXIT_LADDER = [(25, 1.0, 1.0), (35, 0.85, 0.90), (50, 0.75, 0.85), (65, 0.70, 0.80)]


def actions(rows: DataFrame) -> DataFrame:
    """symbol, date, model, regime, position, long_only (0/1) -> the action; the table of actions is short and broadcast."""
    table = rows.sparkSession.createDataFrame(ACTIONS, "model string, regime string, position string, what string, always boolean")
    out = rows.join(F.broadcast(table), ["model", "regime", "position"], "left")
    may = F.col("always") | (F.col("long_only") == 0)
    return out.select("symbol", "date", "model", "regime", "position", "long_only", F.coalesce(F.when(may, F.col("what")), F.lit("hold")).alias("action"))


def early_exit(rows: DataFrame, spike: float = 0.5, calm: float = 0.35, warned: float = 0.65) -> DataFrame:
    """date, vix, spike_prob, calm_prob, low_vol (0/1) -> position and why: the index's level in a wild market, the odds of
    a spike in a calm one. Nothing is remembered."""
    good = F.col("calm_prob") > calm
    level: Column | None = None
    for bound, plain, better in EXIT_LADDER:
        value = F.when(good, better).otherwise(plain)
        level = F.when(F.col("vix") < bound, value) if level is None else level.when(F.col("vix") < bound, value)
    level = level.otherwise(F.when(good, 0.75).otherwise(0.65))
    wild, warns = F.col("low_vol") == 0, F.col("spike_prob") > spike
    return rows.select("date", F.when(wild, level).when(warns, warned).otherwise(1.0).alias("position"), F.when(wild, "HIGH_VOL").when(warns, "ML_WARNING").otherwise("NORMAL").alias("reason"))


def universal(searched: DataFrame) -> DataFrame:
    """Of grid_search's rows, combinations with a positive excess for every symbol in training, with their mean excess."""
    n = searched.select("symbol").distinct().count()
    train = searched.filter("part = 'train'")
    g = train.groupBy("back", "leave", "enter", "days").agg(F.count_if(F.col("excess") > 0).alias("wins"), F.avg("excess").alias("avg_excess"))
    return g.filter(F.col("wins") == n)


def around_changes(changes: DataFrame, returns: DataFrame, k: int = 5) -> DataFrame:
    """symbol, date of changes and symbol, date, r -> mean and deviation of the k returns before each and of the k from it
    on, and how they differ; null where there are fewer than k."""
    before, after = order().rowsBetween(-k, -1), order().rowsBetween(0, k - 1)
    full = lambda over, c: F.when(F.count("r").over(over) >= k, c)
    out = returns.select("symbol", "date", full(before, F.avg("r").over(before)).alias("mean_before"), full(after, F.avg("r").over(after)).alias("mean_after"), full(before, F.stddev_pop("r").over(before)).alias("vol_before"), full(after, F.stddev_pop("r").over(after)).alias("vol_after"))
    out = out.withColumns({"momentum_shift": F.col("mean_after") - F.col("mean_before"), "vol_shift": F.col("vol_after") - F.col("vol_before")})
    return out.join(changes.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")


def buy_and_hold(bars: DataFrame, vix: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", "close", F.lit(1.0).alias("position"))


def roc(tier: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The rate-of-change overlay of one tier, or of each symbol's own."""

    def run(bars: DataFrame, vix: DataFrame) -> DataFrame:
        params = q.tier_table(bars.sparkSession)
        if tier:
            t = q.TIERS[tier]
            params = bars.select("symbol").distinct().select("symbol", F.lit(tier).alias("tier"), F.lit(t.back).alias("back"), F.lit(t.leave).alias("leave"), F.lit(t.enter).alias("enter"), F.lit(t.days).alias("days"))
        return q.roc_overlay(bars, vix, params).select("symbol", "date", "close", F.col("position").cast("double").alias("position"))

    return run


def roc_by_volatility(target: float = 0.15, tier: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The overlay's position times target over the yearly deviation of 20 returns before, between 0.25 and 1."""
    from candela.functions.frames import YEAR, change, std

    def run(bars: DataFrame, vix: DataFrame) -> DataFrame:
        out = roc(tier)(bars, vix).withColumn("r", change("close"))
        out = out.withColumn("v", std("r", 20) * float(YEAR) ** 0.5).withColumn("v", lag("v"))
        share = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.25), target / F.nullif(F.col("v"), F.lit(0.0)))), F.lit(1.0))
        return out.select("symbol", "date", "close", (F.col("position") * share).alias("position"))

    return run


def create(config: dict) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A strategy, (bars, vix) -> symbol, date, close, position, from a configuration; an unknown type buys and holds."""
    tier = None if config.get("tier", "auto") == "auto" else config["tier"]
    made = {"vix_roc": lambda: roc(tier), "vix_roc_vol": lambda: roc_by_volatility(config.get("target", 0.15), tier)}
    return made.get(config.get("type", "baseline"), lambda: buy_and_hold)()


def repeated(call: Callable[[], T], failures: tuple[type[Exception], ...] = (OSError,), times: int = 3, wait: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; after each of the named failures it is repeated, up to `times` calls, with growing pauses."""
    for i in range(times):
        try:
            return call()
        except failures:
            if i == times - 1:
                raise
            sleep(wait * factor**i)
    raise ValueError("times must be positive")


def identifiers(rows: DataFrame, columns: Iterable[str], prefix: str = "trade") -> DataFrame:
    """rows with `uid`, the same for the same values of the columns whenever it is made: a repeated task writes no second id."""
    return rows.withColumn("uid", F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 16)))
