"""A stored index of vectors: files by centroid, read only where a search probes; upserts, deletions and a metadata filter.

Below folder: centroids (list, c), data (partitioned by list: vec_id, x, meta columns, seq) and changes (vec_id, seq, gone). A
vector that changes is appended under a new seq; of its versions the last counts, wherever it is filed. `compact` writes
what counts into a new folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from candela.sources.shared import SMALL_ROWS, written

#: Vectors that centroids are fitted on, those with the smallest hashes of their ids, and rounds of fitting.
SAMPLE, ROUNDS = 10_000, 12
#: Pieces that a list is cut into, so that no task holds a whole one.
PIECES = 4


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(vectors: DataFrame, lists: int) -> np.ndarray:
    """Unit centroids of a bounded sample, by rounds of assignment and averages."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    x = _unit(_rows(some["x"].combine_chunks()))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.bincount(at, minlength=len(c))[:, None] > 0, _unit(sums), c)
    return c


def _filed(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vectors with `list`, that of the nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for b in batches:
            near = np.argmax(_unit(_rows(b.column("x"))) @ shared.value.T, axis=1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], names=[*b.schema.names, "list"])

    return vectors.mapInArrow(run, StructType([*vectors.schema, StructField("list", IntegerType())]))


def _centroids(spark: SparkSession, folder: str) -> np.ndarray:
    """As many rows as lists."""
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").toArrow()
    return _rows(rows["c"].combine_chunks())


def build(vectors: DataFrame, folder: str, lists: int = 64) -> None:
    """vectors: vec_id, x (an array of numbers, of one length) and any other columns, which a search may filter by."""
    spark, c = vectors.sparkSession, fit(vectors, lists)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, c array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    _filed(vectors, c).withColumn("seq", F.lit(0)).repartition("list").write.partitionBy("list").parquet(f"{folder}/data")
    spark.createDataFrame([], "vec_id long, seq int, gone boolean").write.parquet(f"{folder}/changes")


def _next(spark: SparkSession, folder: str) -> int:
    return (spark.read.parquet(f"{folder}/changes").agg(F.max("seq")).first()[0] or 0) + 1


def upsert(vectors: DataFrame, folder: str) -> None:
    """Vectors that are new or take the place of those with their ids."""
    spark = vectors.sparkSession
    seq = _next(spark, folder)
    held = written(vectors.withColumn("seq", F.lit(seq)), "upserts")
    _filed(held, _centroids(spark, folder)).repartition("list").write.mode("append").partitionBy("list").parquet(f"{folder}/data")
    held.select("vec_id", F.lit(seq).alias("seq"), F.lit(False).alias("gone")).write.mode("append").parquet(f"{folder}/changes")


def delete(ids: DataFrame, folder: str) -> None:
    seq = _next(ids.sparkSession, folder)
    ids.select("vec_id", F.lit(seq).alias("seq"), F.lit(True).alias("gone")).write.mode("append").parquet(f"{folder}/changes")


def current(spark: SparkSession, folder: str, lists: list[int] | None = None) -> DataFrame:
    """The vectors that count, of some lists or all: only these lists' files are read."""
    data = spark.read.parquet(f"{folder}/data")
    if lists is not None:
        data = data.filter(F.col("list").isin(lists))
    changes = spark.read.parquet(f"{folder}/changes").groupBy("vec_id").agg(F.max("seq").alias("last"), F.max_by("gone", "seq").alias("gone"))
    changes = F.broadcast(changes) if spark.read.parquet(f"{folder}/changes").count() <= SMALL_ROWS else changes
    out = data.join(changes, "vec_id", "left").filter((F.col("seq") == F.coalesce("last", F.lit(0))) & ~F.coalesce("gone", F.lit(False)))
    return out.drop("last", "gone", "seq")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The index anew, with the same centroids and without versions that no longer count."""
    spark.read.parquet(f"{folder}/centroids").write.parquet(f"{into}/centroids")
    current(spark, folder).withColumn("seq", F.lit(0)).repartition("list").write.partitionBy("list").parquet(f"{into}/data")
    spark.createDataFrame([], "vec_id long, seq int, gone boolean").write.parquet(f"{into}/changes")


def probed(spark: SparkSession, folder: str, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, q, list: each query (query_id, x) with the lists of its nearest centroids."""
    shared = spark.sparkContext.broadcast(_centroids(spark, folder))

    def run(batches):
        for b in batches:
            near = np.argsort(-(_unit(_rows(b.column("x"))) @ shared.value.T), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, 0), int)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("x").cast(pa.list_(pa.float64())), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    told = queries.select("query_id", "x").mapInArrow(run, "query_id long, q array<double>, lists array<int>")
    return told.select("query_id", "q", F.explode("lists").alias("list"))


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 6, probes: int = 8, where: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of the lists probed, the k vectors of largest cosine to each query (query_id, x), itself
    left out, ties to the smaller id. where: a condition on the index's other columns.

    Lists meet their queries by a join on the list, of which only those that some query probes are read."""
    asked = written(probed(spark, folder, queries, probes), "probes")
    lists = [r[0] for r in asked.select("list").distinct().collect()]  # no more than there are lists
    held = current(spark, folder, lists)
    held = held.filter(where) if where is not None else held

    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        ids, x = rows["vec_id"].to_numpy(), _unit(_rows(rows["x"].combine_chunks()))
        qid, q = queries["query_id"].to_numpy(), _unit(_rows(queries["q"].combine_chunks()))
        out = []
        for i in range(0, len(qid), 256):
            s = q[i : i + 256] @ x.T
            s[qid[i : i + 256, None] == ids[None]] = -np.inf
            top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
            a, b = np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()
            ok = np.isfinite(s[a, b])
            out.append(pa.table([pa.array(qid[i + a[ok]]), pa.array(ids[b[ok]]), pa.array(s[a[ok], b[ok]])], schema=schema))
        return pa.concat_tables(out)

    pieces = held.select("list", "vec_id", "x").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(PIECES)))
    sent = asked.withColumn("piece", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PIECES)])))
    found = pieces.groupBy("list", "piece").cogroup(sent.groupBy("list", "piece")).applyInArrow(lambda key, a, b: run(key, a, b), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
