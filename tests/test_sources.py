"""The provider's data source, the stored index and the stateful stream: what is read, pruned, replaced, late or forgotten."""

import datetime as dt

import duckdb
import numpy as np
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import vector_index as v
from candela.plans import model_queries
from candela.sources import provider
from candela.streaming import engine, twins
from candela.streaming.twins import run_to_end


def bars(spark, symbol, first, n):
    days = pd.date_range(first, periods=n, freq="5D").date
    rng = np.random.default_rng(n)
    close = 50 + rng.normal(size=n).cumsum()
    return spark.createDataFrame(pd.DataFrame({"symbol": symbol, "date": days, "open": close + 0.1, "high": close + 1, "low": close - 1, "close": close, "volume": rng.uniform(1e3, 2e3, n), "vwap": close, "transactions": range(n)}))


def load(spark, **options):
    provider.register(spark)
    return spark.read.format("provider_bars").options(**options).load()


@pytest.fixture
def landing(spark, tmp_path):
    """x is whole in both; y lacks 200 days in the first; z lacks 40, which is borne; only the second has w."""
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    whole = [bars(spark, s, "2000-01-03", 300) for s in "xyz"]
    a = whole[0].unionByName(whole[1].filter("date > '2000-07-21'")).unionByName(whole[2].filter("date > '2000-02-12'"))
    provider.land(a, first)
    provider.land(whole[0].unionByName(whole[1]).unionByName(whole[2]).unionByName(bars(spark, "w", "2001-01-01", 10)), second)
    return first, second


def test_second_source_where_too_much_lacks(spark, landing):
    out = load(spark, path=landing[0], second=landing[1], start="2000-01-01")
    got = {r.symbol: (r.n, r.p) for r in out.groupBy("symbol").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("provider"))).alias("p")).collect()}
    assert got == {"x": (300, "path"), "y": (300, "second"), "z": (291, "path"), "w": (10, "second")}
    told = {r.symbol: r.complete for r in provider.completeness(out, "2000-01-01").collect()}
    assert told == {"x": True, "y": True, "z": False, "w": False}
    alone = load(spark, path=landing[0], start="2000-01-01")
    assert alone.filter("symbol = 'y'").agg(F.min("date")).first()[0] > dt.date(2000, 7, 21)


def test_filters_leave_partitions_out(spark, landing):
    reader = provider.BarsReader({"path": landing[0]})
    assert len(reader.partitions()) == 15
    held = [provider.EqualTo(("symbol",), "x"), provider.GreaterThanOrEqual(("date",), dt.date(2001, 5, 1)), provider.LessThan(("date",), dt.date(2002, 1, 1))]
    assert list(reader.pushFilters(held)) == held  # Spark applies them too
    assert [(p.symbol, p.year) for p in reader.partitions()] == [("x", 2001), ("x", 2002)]
    out = load(spark, path=landing[0]).filter("symbol = 'x' AND date BETWEEN '2001-05-01' AND '2001-12-31'")
    assert out.count() == bars(spark, "x", "2000-01-03", 300).filter("date BETWEEN '2001-05-01' AND '2001-12-31'").count()
    assert out.rdd.getNumPartitions() == 1
    assert load(spark, path=landing[0]).filter("symbol = 'nobody'").count() == 0


def test_an_error_of_the_provider_fails_the_read(spark, tmp_path):
    provider.land(bars(spark, "x", "2000-01-03", 5), str(tmp_path / "bad"), "ERROR")
    with pytest.raises(Exception, match="the provider said ERROR"):
        load(spark, path=str(tmp_path / "bad")).count()


def vectors(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16))
    return x, spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "vec_id long, x array<double>, kind int")


def exact(x, asked, k, allowed=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = u @ u[q]
        ids = [i for i in range(len(x)) if i != q and (allowed is None or i in allowed)]
        out[q] = sorted(ids, key=lambda i: (-round(s[i], 12), i))[:k]  # noqa: B023
    return out


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_index(spark, tmp_path):
    x, df = vectors(spark)
    folder = str(tmp_path / "index")
    v.build(df, folder, 12)
    asked = df.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "x")
    ids = list(range(0, 900, 30))
    assert found(v.search(spark, folder, asked, 5, 12)) == exact(x, ids, 5)
    some, want = found(v.search(spark, folder, asked, 5, 4)), exact(x, ids, 5)
    assert np.mean([len(set(some[q]) & set(want[q])) / 5 for q in ids]) >= 0.9
    files = lambda lists: len(v.current(spark, folder, lists).inputFiles())
    read = lambda lists: v.current(spark, folder, lists)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in read([1, 2]) or "list#" in read([1, 2]).split("PartitionFilters: [")[1].split("]")[0]
    assert files(None) > 0 and v.current(spark, folder, [1, 2]).select("list").distinct().count() == 2
    only = exact(x, ids, 5, {i for i in range(900) if i % 3 == 1})
    assert found(v.search(spark, folder, asked, 5, 12, F.col("kind") == 1)) == only


def test_index_of_changes(spark, tmp_path):
    x, df = vectors(spark, 200)
    folder, into = str(tmp_path / "index"), str(tmp_path / "compact")
    v.build(df, folder, 6)
    y = np.vstack([x, x[:3] + 0.01])
    y[5], y[7] = -x[5], x[9] * 1.5
    changed = spark.createDataFrame([(i, y[i].tolist(), 0) for i in (5, 7, 200, 201, 202)], "vec_id long, x array<double>, kind int")
    v.upsert(changed, folder)
    v.delete(spark.createDataFrame([(11,), (202,)], "vec_id long"), folder)
    v.upsert(spark.createDataFrame([(202, y[202].tolist(), 0)], "vec_id long, x array<double>, kind int"), folder)
    asked = spark.createDataFrame([(i, y[i].tolist()) for i in (0, 2, 9)], "query_id long, x array<double>")
    want = exact(y, [0, 2, 9], 4, set(range(203)) - {11})
    assert want[0][0] == 200 and want[2][0] == 202 and want[9][0] == 7
    assert found(v.search(spark, folder, asked, 4, 6)) == want
    assert v.current(spark, folder).count() == 202
    v.compact(spark, folder, into)
    assert found(v.search(spark, into, asked, 4, 6)) == want and spark.read.parquet(f"{into}/data").count() == 202


def feed(spark, folder, *batches, days=3650):
    """Batches of bars sent one after another."""
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set(*engine.STORE)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return run_to_end(engine.online_features(stream, days), "features").toPandas()


def test_stream_of_late_and_repeated_bars(spark, tmp_path):
    b = bars(spark, "x", "2000-01-03", 40)
    late = b.filter("date < '2000-03-01'").withColumn("close", F.lit(1.0))
    one = feed(spark, str(tmp_path / "a"), b)
    parts = feed(spark, str(tmp_path / "b"), b.filter("date < '2000-04-01'"), late, b.filter("date >= '2000-04-01'"))
    key = lambda f: f.sort_values("date").reset_index(drop=True)
    pd.testing.assert_frame_equal(key(one), key(parts))
    assert len(one) == 39 and (key(one).tail(20).downside_freq > 0).all()


def test_stream_forgets(spark, tmp_path):
    """x pauses for two years while y goes on: its state expires, and its next bar is a first one again."""
    x1, x2 = bars(spark, "x", "2000-01-03", 10), bars(spark, "x", "2002-06-03", 4)
    y = [bars(spark, "y", d, 3) for d in ("2000-03-01", "2001-08-01", "2002-05-01")]
    out = feed(spark, str(tmp_path / "c"), x1, *y, x2, days=100)
    x = out[out.symbol == "x"]
    assert len(x) == 9 + 3 and sorted(x.date)[9] > dt.date(2002, 6, 3)
    kept = feed(spark, str(tmp_path / "d"), x1, *y, x2)
    assert len(kept[kept.symbol == "x"]) == 9 + 4


def shuffled_events(spark, tmp_path, n, name="events"):
    """Events of two types, their ids in no order, and some without a value."""
    rng = np.random.default_rng(5)
    value = [None if x < 0.02 else float(v) for x, v in zip(rng.random(n), rng.exponential(10, n))]
    rows = [(i, "ab"[i % 7 // 4], value[i]) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1)
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return df


@pytest.mark.parametrize("name", ["stream_hysteresis", "stream_ema"])
def test_stream_takes_events_in_order(spark, tmp_path, name):
    """Several Arrow batches a type: each used to be sorted alone, in whatever order they came."""
    shuffled_events(spark, tmp_path, 3000)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "100")
    try:
        assert oracle.compare(model_queries.QUERIES[name](spark, str(tmp_path)), con, model_queries.ORACLE[name]) == ""
    finally:
        spark.conf.set(size, before)


def test_stream_keeps_its_state_between_micro_batches(spark, tmp_path):
    all_ = shuffled_events(spark, tmp_path, 600)
    for a, b in ((0, 250), (250, 251), (251, 600)):
        all_.filter(F.col("event_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    parts = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/parts")
    for step in (twins.overlay, twins.ema):
        assert sorted(step(parts).collect(), key=lambda x: x[0]) == sorted(step(twins.events(spark, str(tmp_path))).collect(), key=lambda x: x[0])
