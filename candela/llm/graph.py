"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import BEARABLE, keep, lookup

#: Contraction needs a number of rounds that grows with the square of the logarithm of the nodes at most.
ROUNDS = 60


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _ends(e: DataFrame) -> tuple[int, int, bool]:
    """Of links u > v: their ends, the most at one node, and whether some node has a smaller neighbour and another link;
    if none has, every node is linked to its component's smallest alone."""
    end = lambda x, up: F.struct(F.col(x).alias("x"), F.lit(up).alias("up"))
    by = e.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return tuple(by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max((F.col("up") > 0) & (F.col("n") > 1)), F.lit(False))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b of one orderable type, either direction, repeats and loops allowed) -> node, root: each node of an
    edge between different nodes, with the smallest node it is connected to. No edges: no rows.

    Each round replaces every node's links by links to its smallest neighbour: first those to larger neighbours, then
    those to smaller ones, until all are stars. Each round ends in a kept table; within one, what is read several times is
    cached, and what a lost executor had of it is worked out anew from the round's start.
    """
    e = keep(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        total, most, unlike_star = _ends(e)
        if not unlike_star:
            break
        # no node gets more rows in either step; the nodes' minima are read twice only where some are heavy
        known = {"total": total, "most": most, "merge": True}
        shared = lambda x: x.persist() if most >= BEARABLE else x  # noqa: E731, B023
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = shared(_mins(both))
        large = lookup(both, first, "u", "n", [F.col("u"), F.col("v")], **known).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct().persist()
        second = shared(_mins(large))
        small = lookup(large, second, "u", "n", [F.col("u"), F.col("v")], **known)
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = keep(small.filter("u != v").distinct(), "small")
        for cached in (first, large, second):
            cached.unpersist()
    else:
        raise RuntimeError(f"no components after {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
