"""Classifiers by symbol and horizon, trained on the past and judged on what follows; walk-forward calibration.

All groups (one symbol, one horizon each) are fitted at once, over the whole table: trees by aggregation (`trees`), the
logistic regression by MLlib, on features that are crossed with the group. What is learnt is saved as tables of nodes and a
persisted MLlib pipeline. A row's place in time decides what it is used for; seeds are fixed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import lag, order, whole
from candela.operators import trees as t
from candela.sources.shared import new_folder, small, written

#: The trees of each kind of model; how many, and how much of each boosted one counts.
SINGLE, FOREST, BOOSTED = t.Shape(5, 20), t.Shape(6, 20, some=2), t.Shape(3, 20)
TREES, ROUNDS, RATE = 20, 8, 0.3
#: Penalty of the regression on standardised coefficients.
RIDGE = 1e-3


def with_targets(bars: DataFrame, features: DataFrame, horizons: tuple[int, ...] = (3, 5, 10), train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """features (symbol, date, numbers) with, for each horizon, whether the close is higher so many bars on, and the part of
    the symbol's history that the row falls into. Rows whose target's date lies in the next part are left out of training
    and validation, so nothing of a later part is learnt from. Looks ahead in the target only."""
    out = features.join(bars.select("symbol", "date", "close"), ["symbol", "date"])
    n, i = F.count("*").over(whole()), F.row_number().over(order())
    ends = [F.floor(n * train), F.floor(n * (train + validate)), n]
    out = out.withColumns({"__i": i, "__a": ends[0], "__b": ends[1], **{f"__t{h}": (lag("close", -h) > F.col("close")).cast("int") for h in horizons}})
    rows = out.select("*", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__t{h}").alias("target")) for h in horizons])).alias("x")).select("*", "x.*")
    last = F.col("__i") + F.col("horizon")
    part = F.when(last <= F.col("__a"), "train").when((F.col("__i") > F.col("__a")) & (last <= F.col("__b")), "validate").when(F.col("__i") > F.col("__b"), "test")
    keep = [c for c in features.columns if c not in ("symbol", "date")]
    return rows.select("symbol", "date", "horizon", *keep, "target", part.alias("part")).filter("part is not null and target is not null").na.drop(subset=keep)


MODELS = ("decision_tree", "gradient_boosting", "logistic_regression", "random_forest")
GROUP = ["symbol", "horizon"]


def prepared(rows: DataFrame) -> DataFrame:
    """Rows of with_targets, with what the learners need: model (the group's name), id, train, y and w, which balances the
    classes of a group's training rows. Features mustn't have these names."""
    out = rows.withColumns({"model": F.concat_ws("|", *GROUP), "id": F.unix_date("date"), "train": F.col("part") == "train", "y": F.col("target").cast("double")})
    n = F.count_if("train").over(W.partitionBy("model"))
    own = F.count_if("train").over(W.partitionBy("model", "target"))
    return out.withColumn("w", F.coalesce(F.try_divide(n, 2 * own), F.lit(1.0)))


def regression(rows: DataFrame, features: list[str], ridge: float = RIDGE) -> PipelineModel:
    """One logistic regression for all groups: each feature, and a constant beside the common one, is crossed with the group, so groups share
    nothing but the penalty. rows: those of `prepared`."""
    stages = [
        StringIndexer(inputCol="model", outputCol="group", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="group", outputCol="own", dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=features, outputCol="plain", handleInvalid="keep"),
        Interaction(inputCols=["own", "plain"], outputCol="crossed"),
        VectorAssembler(inputCols=["own", "crossed"], outputCol="all"),
        LogisticRegression(featuresCol="all", labelCol="y", weightCol="w", regParam=ridge, maxIter=100, tol=1e-9, probabilityCol="odds"),
    ]
    return Pipeline(stages=stages).fit(rows.filter("train"))


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def fit(rows: DataFrame, features: list[str], folder: str, models: tuple[str, ...] = MODELS, seed: int = 42) -> None:
    """Train `models` on the training rows of every group, and save them below folder: nodes (kind and trees' nodes), groups
    (model, mean and whether both classes were met), and the regression's pipeline."""
    made = written(prepared(_filled(rows, features)), "prepared")
    made.filter("train").groupBy("model").agg(F.avg("y").alias("mean"), (F.min("y") < F.max("y")).alias("both")).write.parquet(f"{folder}/groups")
    if "logistic_regression" in models:
        regression(made, features).write().save(f"{folder}/regression")
    if set(models) - {"logistic_regression"}:
        binned, cuts = t.prepared(made, features)
        binned = written(binned, "binned")
        grown = {"decision_tree": lambda: t.tree(binned, cuts, SINGLE), "random_forest": lambda: t.forest(binned, cuts, TREES, FOREST, seed), "gradient_boosting": lambda: t.boost(binned, cuts, ROUNDS, RATE, BOOSTED)[0]}
        for kind in grown:
            if kind in models:
                grown[kind]().write.parquet(f"{folder}/nodes/kind={kind}")


def _odds(kind: str, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.filter(F.col("kind") == kind).drop("kind")
    if kind == "gradient_boosting":
        return t.score(rows, own, BOOSTED.depth, "sum", RATE).withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    return t.score(rows, own, max(SINGLE.depth, FOREST.depth)).withColumn("p", F.col("score"))


def predict(rows: DataFrame, features: list[str], folder: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """rows (symbol, horizon, features, ...) with model, the kind, and p, its odds, once for each of models that are saved in
    folder. Missing features count as 0. A group whose training rows had one class has that class's odds; one that wasn't
    trained has 0.5."""
    spark, names = rows.sparkSession, rows.columns
    base = _filled(rows, features).withColumn("model", F.concat_ws("|", *GROUP)).withColumn("__x", F.array(*features))
    out = None
    for kind in models:
        if kind == "logistic_regression":
            told = PipelineModel.load(f"{folder}/regression").transform(base).withColumn("p", vector_to_array("odds")[1])
        else:
            told = _odds(kind, base, spark.read.parquet(f"{folder}/nodes"))
        told = told.select(*[F.col(c) for c in names], F.col("model").alias("of"), F.lit(kind).alias("model"), "p")
        out = told if out is None else out.unionByName(told)
    groups = small(spark.read.parquet(f"{folder}/groups").withColumnRenamed("model", "of"))
    p = F.when(F.col("both"), F.col("p")).otherwise(F.coalesce("mean", F.lit(0.5)))
    return out.join(groups, "of", "left").withColumn("p", p).drop("of", "mean", "both")


def fit_predict(rows: DataFrame, features: list[str], models: tuple[str, ...] = MODELS) -> DataFrame:
    """Rows of with_targets -> symbol, horizon, model, date, part, target, p: each model fitted on the training part alone
    (balanced classes), its odds for every row."""
    folder = new_folder(rows.sparkSession, "models")
    fit(rows, features, folder, models)
    return predict(rows, features, folder, models).select("symbol", "horizon", "model", "date", "part", "target", "p")


def consensus(rows: DataFrame, features: list[str], folder: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """symbol, date, horizon, each saved model's odds, their mean, and how many say a rise: what is told of rows by models
    that were trained before."""
    told = predict(rows.select("symbol", "date", "horizon", *features), features, folder, models)
    wide = told.groupBy("symbol", "date", "horizon").pivot("model", list(models)).agg(F.first("p"))
    votes = sum(((F.col(m) >= 0.5).cast("int") for m in models[1:]), (F.col(models[0]) >= 0.5).cast("int"))
    return wide.withColumns({"mean_odds": sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models), "votes": votes})


def importance(folder_nodes: DataFrame, features: list[str]) -> DataFrame:
    """kind, model, feature, gain and its share of the model's."""
    out = None
    for kind in ("decision_tree", "gradient_boosting", "random_forest"):
        one = t.importance(folder_nodes.filter(F.col("kind") == kind), features).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("share", F.try_divide("gain", F.sum("gain").over(W.partitionBy("kind", "model"))))


def by_part(predicted: DataFrame) -> DataFrame:
    """By symbol, horizon, model and part: how many, accuracy, precision, recall, F1, Brier score, and the area under the
    curve by ranks, ties sharing their mean rank."""
    keys = ["symbol", "horizon", "model", "part"]
    ties = W.partitionBy(*keys, "p")
    ranked = predicted.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy("p")) + (F.count("*").over(ties) - 1) / 2)
    y, g = F.col("target") == 1, F.col("p") >= 0.5
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(y & g).alias("tp"), F.count_if(~y & g).alias("fp"), F.count_if(y & ~g).alias("fn"), F.avg((y == g).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("target"), 2)).alias("brier"), F.sum(F.when(y, F.col("rank"))).alias("s"), F.count_if(y).alias("np"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "np")
    nn = F.col("n") - F.col("np")
    auc = F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * nn)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*keys, "n", "accuracy", zero(precision).alias("precision"), zero(recall).alias("recall"), zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), "brier", auc.alias("roc_auc"))


def backtest(predicted: DataFrame, bars: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Test rows: hold on the day after a rise was told likely. By symbol, horizon, model: days, trades, log growth of the
    strategy and of holding."""
    from candela.functions.frames import change

    by = W.partitionBy("symbol", "horizon", "model").orderBy("date")
    moves = bars.select("symbol", "date", change("close").alias("r"))
    rows = predicted.filter("part = 'test'").join(moves, ["symbol", "date"]).withColumn("position", (F.col("p") >= threshold).cast("double"))
    rows = rows.withColumn("held", F.lag("position").over(by))
    moved = F.abs(F.col("position") - F.col("held")) > 0.5
    return rows.filter("held is not null").groupBy("symbol", "horizon", "model").agg(F.count("*").alias("num_days"), F.count_if(moved).alias("num_trades"), F.sum(F.log1p(F.col("held") * F.col("r"))).alias("strategy_log_return"), F.sum(F.log1p("r")).alias("hold_log_return"))


def regime_forests(features: DataFrame, targets: DataFrame, train: float = 0.6, rows_needed: int = 50, hits_needed: int = 10, trees: int = 20, shape: t.Shape = t.Shape(5, 20, some=3)) -> DataFrame:
    """symbol, date, part, spike_prob, calm_prob: two forests a symbol, one that sees only calm training days and learns
    which spike, one that sees only wild ones and learns which calm down. A forest without enough rows or hits gives 0.

    features: symbol, date, numbers; targets: symbol, date, current_low, current_high, spike_target, calm_target."""
    names = [c for c in features.columns if c not in ("symbol", "date")]
    rows = features.join(targets.select("symbol", "date", "current_low", "current_high", "spike_target", "calm_target"), ["symbol", "date"]).na.drop()
    past = F.row_number().over(order()) <= F.floor(F.count("*").over(whole()) * train)
    rows = rows.withColumn("past", past)
    two = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(where) == 1).alias("use"), F.col(what).cast("double").alias("y")) for k, where, what in (("spike", "current_low", "spike_target"), ("calm", "current_high", "calm_target"))]))
    each = rows.select("symbol", "date", *names, "past", "spike_target", "calm_target", two.alias("t"))
    each = each.select("symbol", "date", *names, "past", "spike_target", "calm_target", F.col("t.k").alias("kind"), F.concat_ws("|", "symbol", "t.k").alias("model"), F.unix_date("date").alias("id"), (F.col("past") & F.col("t.use")).alias("train"), F.col("t.y").alias("y"))
    by = W.partitionBy("model")
    each = each.withColumns({"n": F.count_if("train").over(by), "hits": F.count_if(F.col("train") & (F.col("y") == 1)).over(by), "own": F.count_if("train").over(W.partitionBy("model", "y"))})
    each = each.withColumn("w", F.coalesce(F.try_divide("n", 2 * F.col("own")), F.lit(1.0)))
    binned, cuts = t.prepared(written(each, "rows"), names)
    binned = written(binned, "binned")
    scored = t.score(binned, t.forest(binned, cuts, trees, shape), shape.depth)
    enough = (F.col("n") >= rows_needed) & (F.col("hits") > hits_needed) & (F.col("hits") < F.col("n"))
    told = scored.withColumn("p", F.when(enough, F.col("score")).otherwise(0.0))
    said = lambda k: F.max(F.when(F.col("kind") == k, F.col("p"))).alias(f"{k}_prob")
    return told.groupBy("symbol", "date").agg(F.when(F.first("past"), "train").otherwise("test").alias("part"), said("spike"), said("calm"), F.first("spike_target").cast("int").alias("spike_target"), F.first("calm_target").cast("int").alias("calm_target"))


def search(rows: DataFrame, features: list[str], ridges: tuple[float, ...] = (0.0001, 0.001, 0.01, 0.1)) -> DataFrame:
    """By symbol and horizon: the regression's penalty with the least log loss on the validation part, of ties the smaller."""
    made = written(prepared(_filled(rows, features)).withColumn("w", F.lit(1.0)), "prepared")
    out = None
    for ridge in ridges:
        p = F.least(F.greatest(vector_to_array("odds")[1], F.lit(1e-9)), F.lit(1 - 1e-9))
        told = regression(made, features, ridge).transform(made.filter("part = 'validate'")).withColumn("p", p)
        loss = told.groupBy(*GROUP).agg(F.avg(-(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))).alias("loss")).withColumn("ridge", F.lit(ridge))
        out = loss if out is None else out.unionByName(loss)
    return out.groupBy(*GROUP).agg(F.min_by("ridge", F.struct("loss", "ridge")).alias("ridge"), F.min("loss").alias("loss"))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the different x in order, and the rising means that fit y best."""
    xs, at = np.unique(x, return_inverse=True)
    n = np.bincount(at).astype(float)
    blocks: list[list[float]] = []  # mean, weight, how many x
    for m, w in zip(np.bincount(at, weights=y) / n, n):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, k2 = blocks.pop()
            m1, w1, k1 = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, k1 + k2]
    return xs, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def walk_forward(rows: DataFrame, x: str, y: str, ahead: int = 10, least: int = 500, fewest: int = 50, years: int = 4) -> DataFrame:
    """date, x, y (0/1, known `ahead` rows later) -> the last years' odds, each year's by an isotonic fit on the rows before
    it whose outcome was known when the year began. Years with fewer such rows than least, or fewer of their own than
    fewest, are left out. The series is one index's; each year
    is a task with the rows before it."""
    base = rows.select("date", F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.year("date").alias("year")).filter("x is not null and y is not null")
    base = base.withColumn("known", F.lead("date", ahead).over(W.orderBy("date")))
    tested = base.select(F.col("year").alias("test")).distinct().orderBy(F.desc("test")).limit(years)
    first = F.to_date(F.concat(F.col("test").cast("string"), F.lit("-01-01")))
    seen = base.join(F.broadcast(tested), F.col("test") >= F.col("year")).withColumn("trains", F.col("known") < first).filter("trains or year = test")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        past, now = group[group["trains"].eq(True) & (group["year"] < group["test"])], group[group["year"] == group["test"]].sort_values("date")
        if len(past) < least or len(now) < fewest:
            return now.head(0)[["date", "year", "y"]].assign(p=0.0)
        xs, fit = isotonic(past["x"].to_numpy(), past["y"].to_numpy())
        return pd.DataFrame({"date": now["date"], "year": now["year"], "y": now["y"], "p": np.interp(now["x"], xs, fit)})

    return seen.groupBy("test").applyInPandas(one, "date date, year int, y double, p double")
