"""Structured Streaming twins of batch operators: same rows, from state that lives between micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators.sequences import hysteresis_start
from candela.sources.shared import new_folder


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a table of the shared folder and read it; offsets and state are checkpointed beside it."""
    spark = stream.sparkSession
    out, marks = new_folder(spark, label), new_folder(spark, f"{label}-checkpoint")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def windowed(stream: DataFrame, width: str = "6 hours", late: str = "0 seconds") -> DataFrame:
    """Counts and sums by event-time window and type; a window is given once the watermark has passed it."""
    marked = stream.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def in_order(stream: DataFrame, label: str, outputs: str, start: Callable[[tuple | None], Callable[[float | None], tuple]]) -> DataFrame:
    """event_id, event_type and outputs (a DDL list) for each event of a drained stream, each type's values in order of event_id.

    A micro-batch comes in no order, and a type's rows in several Arrow batches, so each micro-batch is sorted, and each
    type's rows stream through a task with constant state. The state is the outputs of a type's last event; it is kept as
    a table from one micro-batch to the next, and start() makes a step from it, or from None where a type is new. Ids that
    are null come last, as in SQL. Events of a later micro-batch count as later.
    """
    spark = stream.sparkSession
    out, marks = new_folder(spark, label), new_folder(spark, f"{label}-checkpoint")
    names, done = [x.strip().split(" ")[0] for x in outputs.split(",")], []
    schema, state = f"event_id long, event_type string, {outputs}", f"struct<{', '.join(x.strip().replace(' ', ':') for x in outputs.split(','))}>"
    types = {"double": pa.float64(), "int": pa.int32()}
    kinds = [types[x.strip().split(" ")[1]] for x in outputs.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            held = []
            for i, (kind, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if step is None or kind != now:
                    before = batch.column(3)[i].as_py()
                    now, step = kind, start(before and tuple(before.values()))
                held.append(step(x))
            columns = list(zip(*held)) if held else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["event_id", "event_type", *names])

    def take(batch: DataFrame, n: int) -> None:
        rows = batch.select("event_id", "event_type", "value")
        if done:
            states = batch.sparkSession.read.schema(f"kind string, before {state}").parquet(f"{out}/states-{done[-1]}")
            rows = rows.join(states, F.col("event_type").eqNullSafe(F.col("kind")), "left").drop("kind")
        else:
            rows = rows.withColumn("before", F.lit(None).cast(state))
        dealt = rows.repartition("event_type").sortWithinPartitions("event_type", F.col("event_id").asc_nulls_last())
        dealt.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{out}/rows-{n}")
        told = batch.sparkSession.read.schema(schema).parquet(f"{out}/rows-{n}")
        last = told.groupBy(F.col("event_type").alias("kind")).agg(F.max_by(F.struct(*names), F.struct(F.col("event_id").isNull(), "event_id")).alias("before"))
        if done:
            last = last.unionAll(states.join(last.select(F.col("kind").alias("k")), F.col("kind").eqNullSafe(F.col("k")), "left_anti"))
        last.write.mode("overwrite").parquet(f"{out}/states-{n}")
        done.append(n)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(*[f"{out}/rows-{n}" for n in done]) if done else spark.createDataFrame([], schema)


def _ema(before: tuple | None) -> Callable[[float | None], tuple]:
    state = list(before or ())

    def step(x: float | None) -> tuple:
        state[:] = [x if not state else None if x is None or state[0] is None else 2 / 13 * x + 11 / 13 * state[0]]
        return (state[0],)

    return step


def ema(stream: DataFrame) -> DataFrame:
    """Exponential average of each type's values in order of event_id; its state is a number a type. A null makes all that
    follow null."""
    return in_order(stream, "ema", "ema_12 double", _ema)


def _overlay(before: tuple | None) -> Callable[[float | None], tuple]:
    step = hysteresis_start(before is None or before[0] == 1, before[1] if before else 0)

    def take(x: float | None) -> tuple:
        position = step(0, float("inf") if x is None or x != x else x / 10, 0, 1.5, 0.5, 2)[0]
        return position, min(2, step.state[1])  # it waits for two at most

    return take


def overlay(stream: DataFrame) -> DataFrame:
    """The hysteresis of the overlay, fed by each type's values in order of event_id: out above 15, in again below 5 after
    two values. Nulls and NaN are out, as in SQL."""
    return in_order(stream, "overlay", "position int, days int", _overlay).drop("days")
