"""The online feature engine as a stream: one state a symbol, of numbers and of its last bars, that expires."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candela.sources.shared import new_folder, written
from candela.streaming.twins import run_to_end

# Weight of the newest squared return, rows of the rates, and the bound of a tail.
ALPHA, ROWS, BOUND = 0.06, 20, 2.0
OUT = "symbol string, date date, ret_z double, sigma double, clv double, gap_z double, tail_rate double, downside_freq double, volume_cond_ret double, range_vol_z double"
DAY_MS = 86_400_000
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _score(xs: list[float], least: float) -> float:
    mean = sum(xs) / len(xs)
    return (xs[-1] - mean) / max(math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs)), least)


class Features(StatefulProcessor):
    """State of a symbol: `seen` (last date and close, running variance, and count, mean and squares of returns), and `past`,
    its last ROWS standardised returns, log volumes and ranges. Bars of a micro-batch are taken in order of their dates; a
    bar no later than the last one seen is late and gives no row. A symbol without a bar for `days` of event time is
    forgotten, and starts anew when it comes again."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "day long, close double, var double, n long, mean double, m2 double")
        self.past = handle.getListState("past", "z double, v double, h double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("day", kind="stable")
        state = self.seen.get() if self.seen.exists() else None
        past = [tuple(x) for x in self.past.get()] if self.past.exists() else []
        out = []
        for b in bars.itertuples():
            if state is not None and b.day <= state[0]:
                continue
            if state is None:
                state = (b.day, b.close, 0.0001, 0, 0.0, 0.0)
                continue
            _, before, var, n, mean, m2 = state
            r, sigma = math.log(b.close / before), math.sqrt(max(var, 1e-12))
            n, step = n + 1, r - mean
            mean += step / n
            m2 += step * (r - mean)
            sd = math.sqrt(max(m2 / n, 0.0))
            past = [*past, ((r - mean) / sd if n > 1 and sd > 0 else 0.0, math.log(b.volume), math.log(b.high / b.low))][-ROWS:]
            rates = (0.0, 0.0, 0.0, 0.0)
            if len(past) == ROWS:
                z, v, h = (list(x) for x in zip(*past))
                rates = (sum(abs(x) > BOUND for x in z) / ROWS, sum(x < 0 for x in z) / ROWS, z[-1] * _score(v, 1e-10) if max(v) > min(v) else 0.0, _score(h, 1e-8) if max(h) > min(h) else 0.0)
            place = (2 * b.close - b.high - b.low) / (b.high - b.low) if b.high > b.low else 0.0
            out.append((key[0], pd.Timestamp(b.day, unit="D").date(), r / sigma, sigma, place, math.log(b.open / before) / sigma, *rates))
            state = (b.day, b.close, ALPHA * r * r + (1 - ALPHA) * var, n, mean, m2)
        if state is not None:
            self.seen.update(tuple(state))
            if past:
                self.past.put(past)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((int(state[0]) + self.days) * DAY_MS)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.past.clear()
        return iter([])

    def close(self) -> None:
        pass


def online_features(stream: DataFrame, days: int = 3650, late: str = "0 days") -> DataFrame:
    """A stream of bars (symbol, date, open, high, low, close, volume) -> each bar's features from those before it, the same
    as the batch operators'; a symbol's first bar gives none."""
    marked = stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late).withColumn("day", F.unix_date("date").cast("long"))
    rows = marked.select("symbol", "ts", "day", "open", "high", "low", "close", "volume")
    return rows.groupBy("symbol").transformWithStateInPandas(Features(days), OUT, "Append", "EventTime")


def landed(bars: DataFrame, label: str = "landing") -> str:
    """bars as files of a folder, a year in each, in order: what a stream reads one after another."""
    folder, held = new_folder(bars.sparkSession, label), written(bars, "bars")
    for (year,) in sorted(held.select(F.year("date")).distinct().collect()):  # a row a year
        held.filter(F.year("date") == year).coalesce(1).write.mode("append").parquet(folder)
    return folder


def replay(spark: SparkSession, bars: DataFrame) -> DataFrame:
    """bars sent through the stream, a file a micro-batch, and what came out."""
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(landed(bars))
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        return run_to_end(online_features(stream), "features")
    finally:
        spark.conf.set(STORE[0], before)
