"""Lookups under hot keys, samples, tables of the shared folder, components."""

import random
import subprocess
import sys

from pyspark.sql import functions as F

from candela.llm import common, graph
from candela.llm.common import free_name, keep, lookup, smallest
from candela.llm.graph import components


def test_lookup_with_hot_null_and_unknown_keys(spark):
    keys = ["hot"] * 500 + [None] * 300 + [f"k{i}" for i in range(200)] + ["k7"] * 3 + ["unknown"]
    left = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    right = keep(spark.createDataFrame([("hot", 500, "H"), *((f"k{i}", 4 if i == 7 else 1, f"v{i}") for i in range(200))], "key string, n long, v string"), "right")
    for wide in (False, True):
        out = {r["id"]: r["v"] for r in lookup(left, right, "key", "n", [F.col("id")], wide=wide).collect()}
        assert len(out) == len(keys)
        assert all(out[i] == {"hot": "H", None: None, "unknown": None}.get(k, f"v{k[1:]}" if k and k[0] == "k" else None) for i, k in enumerate(keys))


def test_lookup_in_an_empty_table(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "id long, key string")
    right = keep(spark.createDataFrame([], "key string, n long, v string"), "empty")
    assert [r["v"] for r in lookup(left, right, "key", "n", [F.col("id")]).collect()] == [None, None]


def test_smallest_equals_the_plain_sort(spark):
    rows = spark.range(50_000).select("id")
    want = {r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()}
    assert {r["id"] for r in smallest(rows, ["id"], 100, 50_000).collect()} == want


def test_kept_tables_outlive_their_source(spark):
    kept = keep(spark.createDataFrame([(1, None)], "a long, b string"), "t")
    assert kept.collect() == [(1, None)] and keep(kept.limit(0), "none").count() == 0
    assert free_name(kept, "A") == "A_"


def test_components_of_random_graphs(spark):
    r = random.Random(0)
    for n, m in ((60, 40), (40, 100), (30, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1030)] + [(2000, 2000 + i) for i in range(1, 200)]
        root = {x: x for e in edges for x in e}
        for _ in range(40):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(got.get(x, x) == y for x, y in root.items())
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0


def test_nothing_is_broadcast_for_keys_of_which_none_is_heavy(spark):
    left = spark.createDataFrame([(i, f"k{i % 5000}" if i % 7 else None) for i in range(10_000)], "id long, key string")
    right = keep(left.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.concat(F.lit("v"), "key").alias("v")), "right")
    for wide in (False, True):
        found = lookup(left, right, "key", "n", [F.col("id")], wide=wide)
        assert "broadcast" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert {(r["id"], r["v"]) for r in found.collect()} == {(i, f"vk{i % 5000}" if i % 7 else None) for i in range(10_000)}


def test_components_and_lookups_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BEARABLE", 0)
    monkeypatch.setattr(graph, "BEARABLE", 0)
    test_components_of_random_graphs(spark)
    test_lookup_with_hot_null_and_unknown_keys(spark)


def test_stars_take_no_round(spark, monkeypatch):
    """The links of small groups are stars as they come: a round would change nothing."""
    kept = []
    monkeypatch.setattr(graph, "keep", lambda df, label: kept.append(label) or keep(df, label))
    edges = [(a, a + k) for a in range(0, 1000, 10) for k in (1, 2)]
    assert {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(b, a) for a, b in edges}
    assert kept == ["edges"]


def test_freed_memory_goes_back(spark):
    """In a process of its own: what lies below a live object stays with the process until it is released."""
    code = """
import re
from candela.llm.common import release
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
x = [bytes(2000) for _ in range(100_000)]
x = x[-1:]
before = held()
release()
print(before - held())
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 100
