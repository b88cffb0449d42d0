"""Trees grown by aggregation: many models at once, over the whole table.

Rows carry `model`, the name of the model that they train or are scored by, and never move: at each level one aggregation by
(model, tree, node, feature, bin) sums gradients and weights, windows over bins find the best cut of each node, and the
cuts, a small table, are joined back. A model of any number of rows is grown like a small one. What is learnt is a table of
nodes: model, tree, node (1 the root, 2 k and 2 k + 1 the children of k), feature, cut, value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.sources.shared import SMALL_ROWS, small, written

KEY = ["model", "tree"]
NODES = "model string, tree int, node int, feature int, cut double, gain double, value double, n double"
#: Digits of a cut's score that tell it from others; beyond them the first feature and the lowest cut win.
DIGITS = 10


@dataclass(frozen=True)
class Shape:
    """What a tree may look like: levels, least rows of a leaf, cuts tried for each feature, the ridge on leaf values, and
    how many features each node draws (all by default)."""

    depth: int = 5
    leaf: int = 20
    bins: int = 32
    ridge: float = 0.0
    some: int | None = None


def prepared(rows: DataFrame, features: list[str], bins: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts). rows: with __x, the features as an array (missing ones 0), and __b, of each how many cuts lie below it.
    cuts (model, cuts): for each feature the distinct quantiles of the model's rows with `train`, in order."""
    x = rows.withColumn("__x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    each = x.filter("train").select("model", F.posexplode("__x").alias("f", "v")).groupBy("model", "f").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, F.lit(100_000)))).alias("c"))
    cuts = written(each.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda s: s["c"]).alias("cuts")), "cuts")
    cuts = small(cuts)
    below = F.zip_with("__x", "cuts", lambda v, c: F.size(F.filter(c, lambda k: k < v)))
    return x.join(cuts, "model").withColumn("__b", below).drop("cuts"), cuts


def _placed(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows with the node that the cuts so far lead to."""
    out = rows.withColumn("node", F.lit(1))
    for cuts in levels:
        out = out.join(cuts.select(*KEY, "node", "feature", "bin"), [*KEY, "node"], "left")
        right = (F.get("__b", F.col("feature")) > F.col("bin")).cast("int")
        out = out.withColumn("node", F.when(F.col("feature").isNotNull(), 2 * F.col("node") + right).otherwise(F.col("node"))).drop("feature", "bin")
    return out


def grow(rows: DataFrame, cuts: DataFrame, shape: Shape = Shape(), trees: int | None = None, limits: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes, levels): one tree for each model and tree of rows (model, tree, __b, g, h, c): g the gradient that a leaf
    follows, h its weight, c how many rows it stands for. A leaf's value is sum g / (sum h + ridge); a cut's gain is what
    the sum of (sum g)² / (sum h + ridge) rises by. levels: the cuts of each level, to place rows by. trees: how many are grown, if that is known. limits
    (model, depth, leaf, ridge): each model's own, in place of the shape's, whose depth is the most."""
    levels: list[DataFrame] = []
    ridge, leaf = (F.col("ridge"), F.col("leaf")) if limits is not None else (F.lit(shape.ridge), F.lit(shape.leaf))
    limited = lambda df: df if limits is None else df.join(small(limits), "model")
    grown = trees or rows.select(*KEY).distinct().count()  # each level has at most so many times 2 ** level cuts
    for level in range(shape.depth):
        at = _placed(rows, levels).filter(F.col("node") >= 1 << level)
        sums = at.select(*KEY, "node", "g", "h", "c", F.posexplode("__b").alias("feature", "bin")).groupBy(*KEY, "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghc"])
        by = W.partitionBy(*KEY, "node", "feature")
        below = by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.select(*KEY, "node", "feature", "bin", *[F.sum(c).over(below).alias(c) for c in "ghc"], *[F.sum(c).over(by).alias(c * 2) for c in "ghc"])
        if shape.some:
            drawn = F.dense_rank().over(W.partitionBy(*KEY, "node").orderBy(F.xxhash64(*KEY, "node", "feature")))
            sums = sums.withColumn("drawn", drawn).filter(F.col("drawn") <= shape.some)
        sums = limited(sums)
        sums = sums if limits is None else sums.filter(F.col("depth") > level)
        worth = lambda g, h: g * g / (h + ridge)
        gain = worth(F.col("g"), F.col("h")) + worth(F.col("gg") - F.col("g"), F.col("hh") - F.col("h")) - worth(F.col("gg"), F.col("hh"))
        open_ = (F.col("c") >= leaf) & (F.col("cc") - F.col("c") >= leaf)
        tried = sums.filter(open_).withColumn("gain", gain).withColumn("score", F.round(F.col("gain") / F.col("hh"), DIGITS)).filter("score > 0")
        best = tried.groupBy(*KEY, "node").agg(F.max_by(F.struct("feature", "bin", "gain", (F.col("gg") / (F.col("hh") + ridge)).alias("value"), F.col("cc").alias("n")), F.struct("score", -F.col("feature"), -F.col("bin"))).alias("s"))
        found = written(best.select(*KEY, "node", "s.*"), "cuts")
        levels.append(F.broadcast(found) if grown << level <= SMALL_ROWS else found)
    leaves = limited(_placed(rows, levels).groupBy(*KEY, "node").agg(*[F.sum(c).alias(c) for c in "ghc"])).select(*KEY, "node", (F.col("g") / (F.col("h") + ridge)).alias("value"), F.col("c").cast("double").alias("n"))
    leaves = leaves.select(*KEY, "node", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("cut"), F.lit(0.0).alias("gain"), "value", "n")
    nodes = leaves
    for found in levels:
        with_cut = found.join(cuts, "model").select(*KEY, "node", "feature", F.get(F.get("cuts", F.col("feature")), F.col("bin")).alias("cut"), "gain", "value", F.col("n").cast("double").alias("n"))
        nodes = nodes.unionByName(with_cut)
    return written(nodes, "nodes"), levels


def _one(rows: DataFrame) -> DataFrame:
    """Trees of the labels themselves."""
    return rows.filter("train").select("model", F.lit(0).alias("tree"), "__b", (F.col("w") * F.col("y")).alias("g"), F.col("w").alias("h"), F.lit(1.0).alias("c"))


def tree(rows: DataFrame, cuts: DataFrame, shape: Shape = Shape(), limits: DataFrame | None = None) -> DataFrame:
    """Nodes of one tree a model (each within its own limits, if any are given), of rows (model, train, __b, y, w): weighted squared error, which for labels 0 and 1 is the
    Gini index."""
    return grow(_one(rows), cuts, shape, limits=limits)[0]


def forest(rows: DataFrame, cuts: DataFrame, trees: int = 30, shape: Shape = Shape(6, some=2), seed: int = 42) -> DataFrame:
    """Nodes of `trees` trees a model, all grown at once: each tree counts a row 0, 1, 2, .. times as a Poisson variable of mean
    1 that the row's id and the tree decide."""
    u = (F.xxhash64(F.lit(seed), "model", "id", "tree") / F.lit(2.0**64)) + 0.5
    share, times, total = 0.36787944117144233, F.lit(0), 0.0  # exp(-1)
    for k in range(8):
        total += share
        times = times + (u >= total).cast("int")
        share /= k + 1
    each = rows.filter("train").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("c", times.cast("double")).filter("c > 0")
    return grow(each.select(*KEY, "__b", (F.col("c") * F.col("w") * F.col("y")).alias("g"), (F.col("c") * F.col("w")).alias("h"), "c"), cuts, shape)[0]


def _odds(f: Column) -> Column:
    return 1 / (1 + F.exp(-f))


def boost(rows: DataFrame, cuts: DataFrame, rounds: int = 20, rate: float = 0.1, shape: Shape = Shape(3), logistic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, rows with f): trees one after another, each of the gradient that the ones before leave, leaves by a Newton
    step. A model starts from 0 (logistic) or from its training rows' mean, which is its tree -1. f is told for all rows."""
    base = rows.filter("train").groupBy("model").agg((F.lit(0.0) if logistic else F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("base"), F.count("*").cast("double").alias("n"))
    base = written(base, "base")
    models = base.count()
    first = base.select("model", F.lit(-1).alias("tree"), F.lit(1).alias("node"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("cut"), F.lit(0.0).alias("gain"), (F.col("base") / rate).alias("value"), "n")
    state = written(rows.join(small(base.select("model", F.col("base").alias("f"))), "model"), "state")
    nodes = [first]
    for t in range(rounds):
        p = _odds(F.col("f"))
        g = F.col("w") * (F.col("y") - (p if logistic else F.col("f")))
        h = F.col("w") * F.greatest(p * (1 - p), F.lit(1e-6)) if logistic else F.col("w")
        now = state.withColumn("tree", F.lit(t))
        made, levels = grow(now.filter("train").select(*KEY, "__b", g.alias("g"), h.alias("h"), F.lit(1.0).alias("c")), cuts, shape, models)
        leaves = made.filter("feature is null").select(*KEY, "node", "value")
        moved = _placed(now, levels).join(F.broadcast(leaves) if models << shape.depth <= SMALL_ROWS else leaves, [*KEY, "node"], "left")
        state = written(moved.withColumn("f", F.col("f") + rate * F.coalesce("value", F.lit(0.0))).drop("tree", "node", "value"), "state")
        nodes.append(made)
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out, state


def ensembles(nodes: DataFrame) -> DataFrame:
    """One row a model: its trees, each a map from node to feature, cut and value."""
    each = nodes.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut", "value").alias("what")))).alias("nodes"))
    return each.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("tree", F.map_entries("nodes").alias("nodes")))).alias("trees"))


def score(rows: DataFrame, nodes: DataFrame, depth: int, how: str = "mean", rate: float = 1.0, x: str = "__x") -> DataFrame:
    """rows (model, __x) with `score`: the mean of the trees' values, or rate times their sum. Trees are folded as arrays of
    nodes, level by level; so a saved model is a table, not code. Rows of a model without nodes have none."""
    told = rows.join(small(ensembles(nodes)), "model", "left")

    def value(t: Column) -> Column:
        known = F.map_from_entries(t["nodes"])
        at = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(1), lambda k, _: _next(known, k))
        return F.element_at(known, at)["value"]

    def _next(known: Column, k: Column) -> Column:
        node = F.element_at(known, k)
        return F.when(node["feature"].isNull(), k).otherwise(2 * k + (F.get(x, node["feature"]) > node["cut"]).cast("int"))

    total = F.aggregate(F.transform("trees", value), F.lit(0.0), lambda a, v: a + v)
    return told.withColumn("score", total * rate if how == "sum" else total / F.size("trees")).drop("trees")


def importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """model, feature, gain: what cuts by each feature gained, over all trees; 0 for features that none uses."""
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.lit(n).alias("name")) for k, n in enumerate(features)]))
    models = nodes.select("model").distinct().select("model", names.alias("n")).select("model", "n.f", "n.name")
    gains = nodes.filter("feature is not null").groupBy("model", F.col("feature").alias("f")).agg(F.sum("gain").alias("gain"))
    return models.join(gains, ["model", "f"], "left").select("model", F.col("name").alias("feature"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def walk_forward_regression(rows: DataFrame, features: list[str], target: str, known: str, years: int = 4, least: int = 500, fewest: int = 50, rounds: int = 12, rate: float = 0.3, shape: Shape = Shape(3, 40, 32, 1.0)) -> DataFrame:
    """year, date, y, p: the target of each of the last years by boosted trees of the rows before it whose target was known
    when the year began (date `known`); years with fewer such rows than least, or of their own than fewest, are left out.
    All years are grown at once, as models of their own. Rows with a null target are ignored."""
    base = rows.filter(F.col(target).isNotNull()).withColumn("year", F.year("date"))
    n = base.groupBy("year").agg(F.count("*").alias("own"))
    last = n.orderBy(F.desc("year")).limit(years).select(F.col("year").alias("test"), "own")  # so many rows
    first = F.to_date(F.concat(F.col("test").cast("string"), F.lit("-01-01")))
    each = base.join(F.broadcast(last), F.col("year") <= F.col("test")).withColumn("train", (F.col("year") < F.col("test")) & (F.col(known) < first)).filter("train or year = test")
    each = each.withColumn("before", F.count_if("train").over(W.partitionBy("test"))).filter((F.col("before") >= least) & (F.col("own") >= fewest))
    each = each.select(F.col("test").cast("string").alias("model"), "date", F.col("year"), F.col("test"), "train", F.col(target).alias("y"), F.lit(1.0).alias("w"), *[F.col(c).cast("double").alias(c) for c in features])
    told, cuts = prepared(written(each, "folds"), features, shape.bins)
    done = boost(told, cuts, rounds, rate, shape, logistic=False)[1]
    return done.filter("year = test").select("year", "date", "y", F.col("f").alias("p"))


def regression_by_year(predicted: DataFrame) -> DataFrame:
    """By year, and over all as year null: n, rmse, r2 against the year's own mean."""
    out = predicted.rollup("year")
    err = F.sum(F.pow(F.col("y") - F.col("p"), 2))
    return out.agg(F.count("*").alias("n"), F.sqrt(err / F.count("*")).alias("rmse"), (1 - F.try_divide(err, F.count("*") * F.var_pop("y"))).alias("r2"))
