"""Distances between samples of any sizes: maximum mean discrepancy by blocks, and p-Wasserstein distances by merged quantile
functions. Samples are rows (sample, id, x), x an array of the same length everywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.sources.shared import small, written

#: Rows of a block; a task holds two blocks and their kernel matrix.
BLOCK = 1_024


def _kernel_sum(sigma: float):
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("total", pa.float64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = (np.array(t["x"].to_pylist(), float) for t in (left, right))
        far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
        return pa.table([[key[0].as_py()], [key[1].as_py()], [float(np.exp(-np.maximum(far, 0) / (2 * sigma * sigma)).sum())]], schema=schema)

    return run


def kernel_sums(samples: DataFrame, pairs: DataFrame, sigma: float = 1.0, block: int = BLOCK) -> DataFrame:
    """a, b, total: for each of the pairs (a, b) of samples, the sum of the Gaussian kernel over all rows of a with all of b.

    Samples are cut into blocks by a hash of the id, each block of a meets each of b in a task, and sums are added; a sample
    of any size is met in bounded tasks, as many as the square of its blocks."""
    sizes = samples.groupBy("sample").agg(F.ceil(F.count("*") / block).alias("blocks"))
    held = written(samples.join(small(written(sizes, "sizes")), "sample").withColumn("own", F.pmod(F.xxhash64("id"), "blocks")), "blocks")
    counts = small(written(held.select("sample", "blocks").distinct(), "counts"))
    other = lambda side, name: counts.select(F.col("sample").alias(side), F.col("blocks").alias(name))
    wanted = pairs.select("a", "b").distinct().join(other("a", "na"), "a").join(other("b", "nb"), "b")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = held.withColumnRenamed("sample", "a").join(small(wanted), "a").select("a", "b", F.col("own").alias("i"), every("nb").alias("j"), "x").toDF("a", "b", "i", "j", "x")
    right = held.withColumnRenamed("sample", "b").join(small(wanted), "b").select("a", "b", every("na").alias("i"), F.col("own").alias("j"), "x")
    run = _kernel_sum(sigma)
    met = left.groupBy("a", "b", "i", "j").cogroup(right.groupBy("a", "b", "i", "j")).applyInArrow(lambda key, x, y: run(key, x, y), "a string, b string, total double")
    return met.groupBy("a", "b").agg(F.sum("total").alias("total"))


def mmd(samples: DataFrame, pairs: DataFrame, sigma: float = 1.0, block: int = BLOCK) -> DataFrame:
    """a, b, mmd2: the squared maximum mean discrepancy of each pair of samples, all terms with themselves included (0 of a
    sample with itself). Samples without rows give no pair; rows with a null x are ignored."""
    rows = written(samples.filter("x is not null"), "samples")
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    own = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"))
    sums = written(kernel_sums(rows, pairs.unionByName(own), sigma, block), "sums")
    n = rows.groupBy("sample").agg(F.count("*").alias("n"))
    mean = sums.join(n.select(F.col("sample").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("sample").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("total") / F.col("na") / F.col("nb")).alias("m"))
    mean = written(mean, "means")
    self_ = lambda side: mean.filter("a = b").select(F.col("a").alias(side), F.col("m").alias(f"m{side}"))
    out = pairs.join(mean, ["a", "b"]).join(self_("a"), "a").join(self_("b"), "b")
    return out.select("a", "b", (F.col("ma") + F.col("mb") - 2 * F.col("m")).alias("mmd2"))


def cluster_quality(samples: DataFrame, sigma: float = 1.0) -> DataFrame:
    """kind ('within' or 'between'), a, b, mmd2: samples (sample, id, x) are clusters; each is set against every other, and
    its rows of even hashes against the odd ones."""
    names = samples.select("sample").distinct()
    other = names.select(F.col("sample").alias("b"))
    between = names.select(F.col("sample").alias("a")).join(other, F.col("a") < F.col("b"))
    half = F.concat_ws("|", "sample", F.pmod(F.xxhash64("id"), F.lit(2)).cast("string"))
    halves = mmd(samples.withColumn("sample", half), names.select(F.concat("sample", F.lit("|0")).alias("a"), F.concat("sample", F.lit("|1")).alias("b")), sigma)
    within = halves.select(F.lit("within").alias("kind"), F.regexp_replace("a", r"\|0$", "").alias("a"), F.regexp_replace("b", r"\|1$", "").alias("b"), "mmd2")
    return mmd(samples, between, sigma).select(F.lit("between").alias("kind"), "a", "b", "mmd2").unionByName(within)


def wasserstein(samples: DataFrame, pairs: DataFrame, p: int = 1) -> DataFrame:
    """a, b, distance: the p-Wasserstein distance of each pair of samples, of any sizes: by dimension the integral over u of
    the p-th power of the difference of their quantile functions at u; the mean over dimensions, to the power 1 / p.

    Both quantile functions are steps: of n values in order, the i-th reaches to u = i / n. Steps of a pair are put in one
    order by i n' and i' n, whole numbers, and each piece between two ends has the values that come next on either side.
    Null values are ignored; a dimension of which one side has no value isn't counted; a pair needs one."""
    by = W.partitionBy("sample", "d")
    each = samples.select("sample", F.posexplode("x").alias("d", "v")).filter("v is not null").withColumns({"i": F.row_number().over(by.orderBy("v")).cast("long"), "n": F.count("*").over(by)})
    each = written(each, "steps")
    wanted = small(written(pairs.select("a", "b").distinct(), "pairs"))
    sides = []
    for side in ("a", "b"):
        mine = each.withColumnRenamed("sample", side).join(wanted, side)
        sides.append(mine.select("a", "b", "d", F.lit(side).alias("side"), "v", "i", "n"))
    both = sides[0].unionByName(sides[1])
    pair = W.partitionBy("a", "b", "d")
    size = lambda s: F.max(F.when(F.col("side") == s, F.col("n"))).over(pair)
    both = both.withColumns({"na": size("a"), "nb": size("b")}).filter("na is not null and nb is not null")
    both = both.withColumn("u", F.when(F.col("side") == "a", F.col("i") * F.col("nb")).otherwise(F.col("i") * F.col("na")))
    ahead = pair.orderBy("u").rangeBetween(0, W.unboundedFollowing)
    value = lambda s: F.first(F.when(F.col("side") == s, F.col("v")), ignorenulls=True).over(ahead)
    width = (F.col("u") - F.coalesce(F.lag("u").over(pair.orderBy("u", "side")), F.lit(0))) / (F.col("na") * F.col("nb"))
    pieces = both.select("a", "b", "d", F.pow(F.abs(value("a") - value("b")), F.lit(float(p))).alias("gap"), width.alias("width")).filter("width > 0")
    one = pieces.groupBy("a", "b", "d").agg(F.sum(F.col("gap") * F.col("width")).alias("w"))
    return one.groupBy("a", "b").agg(F.pow(F.avg("w"), F.lit(1.0 / p)).alias("distance"))


def nearest_centroid(windows: DataFrame, centroids: DataFrame, p: int = 1) -> DataFrame:
    """windows (symbol, date, xs: an array) with cluster and distance: of the centroids (symbol, since, cluster, c: sorted
    values, as many as a window has) of the latest fit at or before the date, the nearest by p-Wasserstein distance, of
    ties the first. So rows that no fit has seen are told too; rows before the first fit have none."""
    fits = centroids.groupBy("symbol", "since").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("fit"))
    line = windows.select("symbol", "date", "xs", F.lit(1).alias("k")).unionByName(fits.select("symbol", F.col("since").alias("date"), F.lit(0).alias("k"), "fit"), allowMissingColumns=True)
    over = W.partitionBy("symbol").orderBy("date", "k").rowsBetween(W.unboundedPreceding, 0)
    told = line.withColumn("fit", F.last("fit", ignorenulls=True).over(over)).filter("k = 1").withColumn("s", F.array_sort("xs"))
    gap = lambda c: F.pow(F.aggregate(F.zip_with("s", c, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(0.0), lambda a, v: a + v) / F.size("s"), F.lit(1.0 / p))
    best = F.array_min(F.transform("fit", lambda f: F.struct(gap(f["c"]).alias("distance"), f["cluster"].alias("cluster"))))
    return told.select("symbol", "date", best["cluster"].alias("cluster"), best["distance"].alias("distance"))
