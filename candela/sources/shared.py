"""The folder that driver and executors share, for stream checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, or below a temporary folder where that is unset and driver and executors are one
    process (tests); on a cluster it must be set."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or tempfile.mkdtemp(prefix="candela-")
    return f"{top.rstrip('/')}/candela/{sc.applicationId}/{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of the shared folder, read back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, a table of few numbers a row, marked for broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
