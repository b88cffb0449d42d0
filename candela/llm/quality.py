"""Quality: document evidence joined with the posteriors of its site and path, by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import keep, lookup, smallest

#: The document classifier is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
#: Log odds of a single document stay within this.
CLIP = 12.0


def features(text: Column) -> dict[str, Column]:
    """What the document classifier sees of a whole text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.col("__words")
    nw = F.greatest(F.size(words), F.lit(1)).cast("double")
    less = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    much = lambda x: F.log1p(20 * x)
    repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("double")
    return {
        "upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")) / n,
        "shouts": much(less("!?") / nw),
        "bars": much(less("|<>{}[]=\\") / nw),
        "signs": much(less("*$%&#@~^_+") / nw),
        "digits": much(less("0123456789") / nw),
        "repeats": much(repeats / nw),
        "variety": F.size(F.array_distinct(words)) / nw,
        "length": F.log1p(F.size(words).cast("double")),
        "word": F.least(n / nw, F.lit(30.0)),
    }


FEATURES = ("upper", "shouts", "bars", "signs", "digits", "repeats", "variety", "length", "word")


def _described(rows: DataFrame, text_col: str) -> DataFrame:
    """rows, with __x, the features of its text."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \n\t\r]+"), lambda w: w != "")
    out = rows.withColumn("__words", words)
    f = features(F.col(text_col))
    return out.withColumn("__x", F.array(*[f[k] for k in FEATURES])).drop("__words")


@dataclass
class Model:
    weights: list[float]  # of the raw features
    bias: float
    sites: DataFrame  # __site, __n, __host_rate, __rate: posteriors by path
    base: float  # the global rate
    rows: DataFrame | None = None  # __row, __site, __x: the corpus that fit() described, where it was asked to carry columns

    def evidence(self, x: Column) -> Column:
        z = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            z = z + x[i] * F.lit(w)
        return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's steps, on standardised features; weights for the raw ones."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x1 = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-9])
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]) + penalty, x1.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / scale
    return raw, float(w[-1] - raw @ mean)


def _site(host: str, path: str) -> tuple[Column, Column]:
    h = F.coalesce(F.col(host).cast("string"), F.lit(""))
    return h, F.concat(F.length(h).cast("string"), F.lit(":"), h, F.lit("/"), F.coalesce(F.col(path).cast("string"), F.lit("")))


def _strength(groups: DataFrame, n: str, s: str, prior: Column, base: float) -> float:
    """Of the prior of these groups, by moments: how many documents it is worth. prior: each group's prior rate."""
    p = prior
    excess = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - p, 2) - p * (1 - p))
    total, squares, spread, count = groups.agg(F.sum(n), F.sum(F.col(n).cast("double") * F.col(n)), excess, F.count("*")).first()
    if not total or count < 2 or total <= squares / total:
        return MOST_STRENGTH
    variance = spread / (total - squares / total)
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, base * (1 - base) / variance - 1))) if variance > 0 else MOST_STRENGTH


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", sample: int = SAMPLE, carry: list[str] | None = None) -> Model:
    """The classifier (from at most `sample` labelled rows) and the posteriors of all hosts and paths.

    Every document of the corpus is evidence on its path: its label if it has one, else the classifier's probability.
    Paths shrink towards their host and hosts towards the global rate, by strengths that moments of the groups give, so
    sparse sites say little. Evidence is summed by grouped aggregation; nothing of a site's documents meets in a task.
    carry: columns that are written beside the features, so that score_corpus() need not read and describe the texts again.

    Null texts, hosts and paths count as empty; rows without an id have no label; a repeated row counts each time, labels
    of one id are averaged. Without labels of both kinds documents are no evidence for each other; an empty table is fine.
    Columns may have any names.
    """
    told = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__label")).filter(F.col("__id").isNotNull() & F.col("__label").isin(0.0, 1.0))
    told = told.groupBy("__id").agg(F.avg("__label").alias("__label"), F.lit(1).cast("long").alias("__one"))
    host, site = _site(host_col, path_col)
    row = [F.struct(*[docs[f"`{c}`"] for c in carry]).alias("__row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), host.alias("__host"), site.alias("__site"), F.col(text_col).cast("string").alias("__text"), *row)
    described = keep(_described(rows, "__text").drop("__text"), "features")
    rows = described.select("__id", "__host", "__site", "__x")
    told = keep(told, "labels")
    rows = keep(lookup(rows, told, "__id", "__one", [F.xxhash64("__id", "__site", "__x")], 0).drop("__one"), "evidence")
    some = smallest(rows.filter("__label is not null"), ["__id", "__site", "__x"], sample, told.count()).select("__x", "__label").toArrow()
    x = some["__x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if some.num_rows else np.zeros((0, len(FEATURES)))
    y = (some["__label"].to_numpy() >= 0.5).astype(float)
    if len(set(y.tolist())) == 2:
        weights, bias = _logistic(x, y)
    else:  # one label only, or none: no document is evidence for another
        weights, bias = np.zeros(len(FEATURES)), CLIP if not len(y) or y[0] else -CLIP
    model = Model(weights.tolist(), float(bias), rows, 0.5)
    good = F.coalesce(F.col("__label"), 1 / (1 + F.exp(-model.evidence(F.col("__x")))))
    paths = keep(rows.groupBy("__host", "__site").agg(F.count("*").alias("__n"), F.sum(good).alias("__s")), "paths")
    hosts = keep(paths.groupBy("__host").agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"), F.count("*").alias("__paths")), "hosts")
    total, some = hosts.agg(F.sum("__hn"), F.sum("__hs")).first()
    base = min(0.999, max(0.001, some / total)) if total else 0.5
    k = _strength(hosts, "__hn", "__hs", F.lit(base), base)
    hosts = keep(hosts.select("__host", "__paths", ((F.col("__hs") + k * base) / (F.col("__hn") + k)).alias("__host_rate")), "host-rates")
    paths = keep(lookup(paths, hosts, "__host", "__paths", [F.col("__site")]), "path-rates")
    k = _strength(paths, "__n", "__s", F.col("__host_rate"), base)
    sites = keep(paths.select("__site", "__n", "__host_rate", ((F.col("__s") + k * F.col("__host_rate")) / (F.col("__n") + k)).alias("__rate")), "sites")
    model.sites, model.base = sites, base
    model.rows = described.select("__row", "__site", "__x") if carry else None
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the given columns, by default all of docs), doc_score, host_score, path_score, score, keep.

    The log odds of a document are those of the classifier, moved by how far its path's posterior lies from the global
    rate. Null texts count as empty and null hosts and paths as empty names; rows of a site that the model hasn't seen
    take the global rate. Every row gives one row, repeated rows too; an empty table none.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in (columns or docs.columns)])
    _, site = _site(host_col, path_col)
    rows = docs.select(row.alias("__row"), site.alias("__site"), F.col(text_col).cast("string").alias("__text"))
    return _scored(_described(rows, "__text").drop("__text"), model, threshold)


def score_corpus(model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """As score() of the table that fit() was given, its row being the columns that fit() was to carry."""
    return _scored(model.rows, model, threshold)


def _scored(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    rows = rows.withColumn("__z", model.evidence(F.col("__x"))).drop("__x")
    rows = lookup(rows, model.sites, "__site", "__n", [F.xxhash64("__row")])
    rate, base = F.coalesce(F.col("__rate"), F.lit(model.base)), model.base
    odds = F.col("__z") + F.log(rate / (1 - rate)) - float(np.log(base / (1 - base)))
    p = lambda z: 1 / (1 + F.exp(-z))
    out = rows.select(F.col("__row").alias("row"), p(F.col("__z")).alias("doc_score"), F.coalesce("__host_rate", F.lit(base)).alias("host_score"), rate.alias("path_score"), p(odds).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)
