"""Data preparation, clustering and hidden states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import change, div, lag, order, so_far, whole


def split(bars: DataFrame, train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """Which part of its symbol's history a row falls into, by place in time."""
    n, i = F.count("*").over(whole()), F.row_number().over(order())
    part = F.when(i <= F.floor(n * train), "train").when(i <= F.floor(n * (train + validate)), "validate").otherwise("test")
    return bars.select("symbol", "date", part.alias("part"))


def impute(rows: DataFrame, column: str = "x") -> DataFrame:
    """Missing values take the last known one, else the next, else the symbol's median, else 0."""
    ahead = order().rowsBetween(0, W.unboundedFollowing)
    return rows.select("symbol", "date", F.coalesce(F.last(column, ignorenulls=True).over(so_far()), F.first(column, ignorenulls=True).over(ahead), F.percentile(column, F.lit(0.5)).over(whole()), F.lit(0.0)).alias(column))


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """By symbol, columns less their mean over their population deviation."""
    return rows.select("symbol", "date", *[div(F.col(c) - F.avg(c).over(whole()), F.stddev_pop(c).over(whole())).alias(c) for c in columns])


def feature_columns(schema: list[tuple[str, str]]) -> list[str]:
    """Numeric columns whose names hold none of the words that mark inputs and targets; words count within names."""
    words = ("open", "high", "low", "close", "vwap", "transactions", "target", "symbol", "date")
    return [n for n, t in schema if t in ("double", "int", "bigint", "float") and not any(w in n.lower() for w in words)]


def interactions(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Product, guarded ratio (where no b of the symbol is zero) and powers of two columns."""
    safe = F.min(F.when(F.col(b) == 0, 0).otherwise(1)).over(whole()) == 1
    return rows.select("symbol", "date", (F.col(a) * F.col(b)).alias("product"), F.when(safe, F.col(a) / (F.col(b) + 1e-6)).alias("ratio"), F.pow(a, F.lit(2)).alias("square"), F.pow(a, F.lit(3)).alias("cube"))


def evaluate_changes(true: DataFrame, found: DataFrame, tolerance: int = 5) -> DataFrame:
    """true, found: symbol and place -> by symbol, hits, misses, false alarms, precision, recall, F1 and mean delay.

    Each found place goes to its nearest true one (of two as near, the earlier); of those within tolerance of one true
    place the earliest found is the hit. Nearest places come from one window over both, not a range join. A symbol without
    true places has recall 1, and precision 1 if nothing was found there. Equal places of a symbol count once."""
    both = true.select("symbol", "place").distinct().withColumn("t", F.col("place")).unionByName(found.select("symbol", "place").distinct(), allowMissingColumns=True)
    by = W.partitionBy("symbol").orderBy("place")
    near = both.withColumns({"before": F.last("t", True).over(by), "after": F.first("t", True).over(by.rangeBetween(0, W.unboundedFollowing))})
    least = F.when(F.col("after").isNull() | (F.col("place") - F.col("before") <= F.col("after") - F.col("place")), F.col("before")).otherwise(F.col("after"))
    near = near.select("symbol", "place", "t", F.when(F.col("t").isNull(), least).alias("to"))
    hit = near.filter(F.abs(F.col("to") - F.col("place")) <= tolerance).groupBy("symbol", "to").agg(F.min("place").alias("place"))
    h = hit.groupBy("symbol").agg(F.count("*").alias("hits"), F.avg(F.col("place") - F.col("to")).alias("mean_delay"))
    n = both.groupBy("symbol").agg(F.count("t").alias("n_true"), F.count_if(F.col("t").isNull()).alias("n_found"))
    out = n.join(h, "symbol", "left").na.fill(0, ["hits"]).na.fill(0.0, ["mean_delay"])
    precision = F.coalesce(div("hits", "n_found"), F.lit(1.0))
    recall = F.coalesce(div("hits", "n_true"), F.lit(1.0))
    f1 = F.when(F.col("n_true") == 0, precision).otherwise(F.coalesce(div(2 * precision * recall, precision + recall), F.lit(0.0)))
    return out.select("symbol", "n_true", "n_found", "hits", (F.col("n_true") - F.col("hits")).alias("misses"), (F.col("n_found") - F.col("hits")).alias("false_alarms"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "mean_delay")


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of rows of sorted values by Wasserstein distance, medians of their members, in order of volatility."""
    rng = np.random.RandomState(42)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.abs(x[:, None, :] - c[None]).mean(axis=2).argmin(axis=1)
        new = np.stack([np.median(x[near == j], axis=0) if (near == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c[np.argsort(c.std(axis=1), kind="stable")]


def _fits(rows: pd.DataFrame, k: int, window: int, rounds: int, days: int, every: int):
    """(first row, centroids) of each fit on a symbol's rows, in order, and the sorted windows, the i-th ending at row i + window - 1."""
    r, when = rows["returns"].to_numpy(), pd.to_datetime(rows["date"]).to_numpy()
    if len(r) < window:
        return [], np.empty((0, window))
    x = np.sort(np.lib.stride_tricks.sliding_window_view(np.sign(r) * np.log1p(np.abs(r)), window), axis=1)
    out = []
    for start in range(every, len(r), every):
        first = int(np.searchsorted(when, when[start - 1] - np.timedelta64(days, "D")))
        seen = x[first : max(first, start - window + 1)]
        if len(seen) >= k:
            out.append((start, _clusters(seen, k, rounds)))
    return out, x


def wasserstein_clusters(features: DataFrame, k: int = 3, window: int = 20, rounds: int = 20, days: int = 500, every: int = 126) -> DataFrame:
    """Each row's window of returns by its nearest cluster, 0 calm to 2 wild; -1 before the first fit.

    Clusters (Wasserstein distance of sorted values, median barycentres) are fitted anew every so many rows on the windows
    of the last so many calendar days, and stand until the next fit; so nothing of a later row tells a row's label."""

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        label = np.full(len(rows), -1)
        fits, x = _fits(rows, k, window, rounds, days, every)
        for i, (start, c) in enumerate(fits):
            now = np.arange(max(start, window - 1), fits[i + 1][0] if i + 1 < len(fits) else len(rows))
            label[now] = np.abs(x[now - window + 1][:, None, :] - c[None]).mean(axis=2).argmin(axis=1)
        return pd.DataFrame({"symbol": rows["symbol"], "date": rows["date"], "regime": label.astype("int32")})

    return features.select("symbol", "date", "returns").groupBy("symbol").applyInPandas(cluster, "symbol string, date date, regime int")


def wasserstein_centroids(features: DataFrame, k: int = 3, window: int = 20, rounds: int = 20, days: int = 500, every: int = 126) -> DataFrame:
    """symbol, since, cluster, c: the clusters of each fit as rows, so that windows that no fit has seen can be told later."""

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        out = [(rows["symbol"].iloc[0], rows["date"].iloc[start], j, c[j].tolist()) for start, c in _fits(rows, k, window, rounds, days, every)[0] for j in range(k)]
        return pd.DataFrame(out, columns=["symbol", "since", "cluster", "c"])

    return features.select("symbol", "date", "returns").groupBy("symbol").applyInPandas(fitted, "symbol string, since date, cluster int, c array<double>")


def windows(features: DataFrame, window: int = 20) -> DataFrame:
    """symbol, date, xs: each row's last `window` returns, damped by a signed logarithm; rows with fewer are left out."""
    x = F.signum("returns") * F.log1p(F.abs("returns"))
    over = order().rowsBetween(1 - window, 0)
    return features.select("symbol", "date", F.collect_list(x).over(over).alias("xs")).filter(F.size("xs") == window)


class Hidden:
    """A Gaussian hidden Markov model of one feature."""

    def __init__(self, x: np.ndarray, k: int):
        self.k = k
        self.mu, self.var = np.quantile(x, [(j + 0.5) / k for j in range(k)]), np.full(k, x.var() + 1e-6)
        self.a, self.pi = np.full((k, k), 0.05 / max(1, k - 1)) + np.eye(k) * (0.95 - 0.05 / max(1, k - 1)), np.full(k, 1 / k)

    def forward(self, x: np.ndarray, p: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Densities, odds of each state given the values up to it, and their scale; p: the odds before the first value."""
        b = np.exp(-0.5 * (x[:, None] - self.mu) ** 2 / self.var) / np.sqrt(2 * np.pi * self.var) + 1e-300
        f, s = np.empty_like(b), np.empty(len(x))
        p = self.pi if p is None else p @ self.a
        for t in range(len(x)):
            v = p * b[t]
            s[t] = v.sum()
            f[t] = v / s[t]
            p = f[t] @ self.a
        return b, f, s

    def fit(self, x: np.ndarray, rounds: int) -> Hidden:
        for _ in range(rounds):
            b, f, s = self.forward(x)
            back = np.ones_like(f)
            for t in range(len(x) - 2, -1, -1):
                back[t] = self.a @ (b[t + 1] * back[t + 1]) / s[t + 1]
            g = f * back
            g /= g.sum(axis=1, keepdims=True)
            move = self.a * (f[:-1].T @ (b[1:] * back[1:] / s[1:, None]))
            self.a = move / move.sum(axis=1, keepdims=True)
            self.pi, w = g[0], g.sum(axis=0)
            self.mu = (g * x[:, None]).sum(axis=0) / w
            self.var = (g * (x[:, None] - self.mu) ** 2).sum(axis=0) / w + 1e-6
        return self


def hidden_states(features: DataFrame, k: int = 3, rounds: int = 30, again: int = 5, window: int = 756, every: int = 63) -> DataFrame:
    """Each row's state by a forward filter, 0 calm to k - 1 wild, and how sure it is; rows before the first fit are left out.

    The model is fitted by EM on the last `window` rows, every so many rows, each time from the one before, and frozen
    between; so no state looks ahead. A series shorter than the window has no states."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x = np.clip(rows["vol_norm_return"].to_numpy(), -10, 10)
        state, sure, model = np.full(len(x), -1), np.zeros(len(x)), None
        for start in range(window, len(x), every):
            past = x[start - window : start]
            model = (model or Hidden(past, k)).fit(past, again if model else rounds)
            f = model.forward(x[start : start + every], model.forward(past)[1][-1])[1]
            state[start : start + every] = np.argsort(np.argsort(model.var))[f.argmax(axis=1)]
            sure[start : start + every] = 1 + (f * np.log(f + 1e-300)).sum(axis=1) / np.log(k)
        out = pd.DataFrame({"symbol": rows["symbol"], "date": rows["date"], "state": state.astype("int32"), "confidence": sure})
        return out[out["state"] >= 0]

    return features.select("symbol", "date", "vol_norm_return").groupBy("symbol").applyInPandas(run, "symbol string, date date, state int, confidence double")


def drawdown_odds(features: DataFrame, targets: DataFrame) -> DataFrame:
    """date, year, y, p and the level it stands for: the chance of a drawdown by isotonic regression on the index's
    percentile, each year's from the years before it alone."""
    from candela.operators.labels import steps
    from candela.operators.learners import walk_forward

    rows = features.select("date", "vix_percentile_252d").join(targets.filter("fwd_max_dd is not null").select("date", "drawdown_flag"), "date")
    out = walk_forward(rows, "vix_percentile_252d", "drawdown_flag")
    return out.withColumn("risk_level", steps(F.col("p"), [(0.15, "LOW"), (0.30, "MODERATE"), (0.50, "ELEVATED"), (0.70, "HIGH")], "EXTREME"))
