"""Queries of sources, the stored index and the stateful stream, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import rounded
from candela.operators import vector_index as v
from candela.plans.label_queries import ORACLE as LABEL_ORACLE
from candela.plans.sequence_queries import ORACLE as SEQUENCE_ORACLE
from candela.plans.sql import query, r
from candela.sources import bars as s
from candela.sources import provider
from candela.sources.shared import new_folder, written
from candela.streaming import engine

FROM, TO, MISSING = "1995-01-01", "1999-06-30", "1996-02-01"


def _provider(spark, sf_dir):
    """Bars landed as a provider's answers, of which the first symbol lacks its first year, and in full as a second one's;
    read back between two dates."""
    bars = written(s.bars(spark, sf_dir), "bars")
    first, second = new_folder(spark, "provider"), new_folder(spark, "second")
    provider.land(bars.filter((F.col("symbol") != "A") | (F.col("date") >= MISSING)), first)
    provider.land(bars, second, "DELAYED")
    provider.register(spark)
    read = spark.read.format("provider_bars").options(path=first, second=second, start=FROM).load()
    return read.filter(F.col("date") <= F.lit(TO).cast("date"))


def _index(spark, sf_dir):
    """An index of the embeddings, of which each 97th is turned round afterwards and each 101st removed; all lists are probed
    for each 50th vector as it was, and vectors of label 0 are left out."""
    rows = s.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    folder = new_folder(spark, "index")
    v.build(rows, folder, 16)
    v.upsert(rows.filter("vec_id % 97 = 1").withColumn("x", F.transform("x", lambda c: -c)), folder)
    v.delete(rows.filter("vec_id % 101 = 1").select("vec_id"), folder)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "x")
    return rounded(v.search(spark, folder, asked, 6, 16, F.col("label") != 0))


QUERIES = {
    "provider_bars": lambda sp, sf: rounded(_provider(sp, sf).drop("vwap")),
    "provider_complete": lambda sp, sf: provider.completeness(_provider(sp, sf), FROM),
    "vector_index": _index,
    "stream_features": lambda sp, sf: rounded(engine.replay(sp, s.bars(sp, sf))),
}

BARS = f"SELECT * FROM bars WHERE date BETWEEN DATE '{FROM}' AND DATE '{TO}'"
ORACLE = {
    "provider_bars": query(f"SELECT symbol, date, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}, transactions, CASE symbol WHEN 'A' THEN 'second' ELSE 'path' END AS provider FROM ({BARS})", "bars"),
    "provider_complete": query(f"SELECT symbol, min(date) AS first, max(date) AS last, count(*) AS bars, min(date) - DATE '{FROM}' < 30 AS complete FROM ({BARS}) GROUP BY symbol", "bars"),
    "vector_index": query(
        f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {r('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, CASE WHEN e.vec_id % 97 = 1 THEN -1 ELSE 1 END * list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND e.label <> 0 AND e.vec_id % 101 <> 1)) WHERE rank <= 6"
    ),
    "stream_features": f"SELECT * FROM ({SEQUENCE_ORACLE['feature_engine_online']}) JOIN ({LABEL_ORACLE['tail_rates']}) USING (symbol, date)",
}
