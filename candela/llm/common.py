"""Helpers the operators share: input tables, tables cut into the shared folder, lookups that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of the rows is heavy, so there are at most 1 / HEAVY_SHARE heavy keys to broadcast.
HEAVY_SHARE = 1 / 2000
#: Where no key has so many narrow rows none is treated as heavy: a task bears as many.
BEARABLE = 10_000
#: Places over which the rows of heavy keys are dealt.
SPREAD = 4096
#: Rows of an Arrow batch that become Python objects at a time.
SLICE = 256


#: Bounds of the batches that go to Python workers, so that their memory doesn't follow the length of the texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and they are
    one process (tests); on a cluster it must be set."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="candela-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/candela/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{label}"


def clean(spark: SparkSession) -> bool:
    """Delete what this application has kept in the shared folder; what reads of it must be done by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/candela/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: cuts the lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows and bytes of text are broadcast.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 16 << 20


def is_small(df: DataFrame, text: Column | None = None) -> bool:
    """Whether df, of a few numbers a row and perhaps this text, may be broadcast."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(8) if text is None else F.octet_length(text)), F.lit(0))).first()
    return rows <= SMALL_ROWS and size <= SMALL_BYTES


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of few rows, so that long texts never stand in memory by the thousand."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def smallest(df: DataFrame, by: list[str], k: int, total: int) -> DataFrame:
    """The k rows with the smallest hashes of `by`, of about `total`. Rows that can't be among them are left out before the
    sort, so that the task that merges meets about 2 k rows, however many tasks there are."""
    h = F.xxhash64(*by)
    share = (2 * k + 1000) / max(1, total)
    some = df if share >= 1 else df.filter(h <= F.lit(int(-(1 << 63) + share * (1 << 64))).cast("long"))
    return some.orderBy(h, *by).limit(k)


def release() -> None:
    """Give what a task has freed back to the system: workers outlive their tasks, and a later stage needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, types: dict[str, pa.DataType], setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow by slices; step gives columns by name as lists. setup runs once a task and is handed to step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        arrow = pa.schema(list(types.items()))
        for piece in slices(batches):
            out = step(piece, state) if setup else step(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], schema=arrow)
        state = piece = out = None
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def lookup(left: DataFrame, right: DataFrame, key: str, n: str, spread_by: list[Column], total: int | None = None, right_key: str | None = None, wide: bool = False, most: int | None = None, merge: bool = False) -> DataFrame:
    """left, with the other columns of right by key (null where there is no such key).

    right has each key once and, as column n, how many rows of left have it. The few keys that hold a large share of
    left (at most 1 / HEAVY_SHARE of them) are broadcast; the others are joined by a shuffle, in which rows of heavy
    keys are dealt out by spread_by. right should be a kept table: it is read three times. A null key matches nothing and
    is dealt out likewise. right_key: the key's name in right, if another.
    total, most: the sum and the largest of n, where the caller knows them. Where no key is heavy nothing is broadcast as
    heavy, as empty broadcasts are the driver's work too.
    wide: left holds whole texts; the join by shuffle is then the same at every size, whether or not right would fit a
    broadcast. merge: so it is for narrow rows.
    """
    by = right_key or key
    values = [c for c in right.columns if c not in (by, n)]
    if total is None:
        total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(2, -(-total * HEAVY_SHARE // 1))
    if most is not None and most < max(least, 0 if wide else BEARABLE):
        rest = right.select(F.col(by).alias("__lk"), F.lit(-1).cast("long").alias("__lp"), *[F.col(c).alias(f"__l_{c}") for c in values])
        place = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))).otherwise(F.lit(-1)).cast("long")
        found = left.withColumn("__p", place).join(rest.hint("merge") if wide or merge else rest, (F.col(key) == F.col("__lk")) & (F.col("__p") == F.col("__lp")), "left")
        return found.select(*[F.col(c) for c in left.columns], *[F.col(f"__l_{c}").alias(c) for c in values])
    heavy = right.filter(F.col(n) >= least).select(F.col(by).alias("__hk"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__h_{c}") for c in values])
    light = right.filter(F.col(n) < least).select(F.col(by).alias("__lk"), F.lit(-1).cast("long").alias("__lp"), *[F.col(c).alias(f"__l_{c}") for c in values])
    one = left.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    place = F.when(F.col("__hit") | F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))).otherwise(F.lit(-1)).cast("long")
    two = one.withColumn("__p", place).join(light.hint("merge") if wide or merge else light, (F.col(key) == F.col("__lk")) & (F.col("__p") == F.col("__lp")), "left")
    return two.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__l_{c}")).alias(c) for c in values])
