"""Tree-structured Parzen search: trials are rows, a round of trials is grown as models side by side in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import YEAR
from candela.operators import trees as t
from candela.sources.shared import written

#: Share of trials that count as good, candidates weighed for each new trial, and trials drawn at random before any is weighed.
GOOD, CANDIDATES, FIRST = 0.25, 24, 8


@dataclass(frozen=True)
class Range:
    """A parameter's bounds; whole numbers or not, and whether its logarithm is what is even."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def ends(self) -> tuple[float, float]:
        a, b = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(a), math.log(b)) if self.log else (a, b)

    def into(self, v: float) -> float:
        return math.log(v) if self.log else v

    def out(self, u: float) -> float:
        v = math.exp(u) if self.log else u
        return int(min(max(round(v), self.low), self.high)) if self.whole else float(min(max(v, self.low), self.high))


SPACE = {"depth": Range(1, 4, whole=True), "leaf": Range(10, 120, whole=True, log=True), "ridge": Range(0.1, 50.0, log=True)}


class Parzen:
    """A density over an interval: equal parts of bells at the points seen, as wide as the gaps beside them, and one even part."""

    def __init__(self, points: list[float], ends: tuple[float, float]):
        self.low, self.high = ends
        self.points = np.sort(np.array(points, float))
        gaps = np.diff(np.concatenate([[self.low], self.points, [self.high]]))
        wide = np.maximum(gaps[:-1], gaps[1:]) if len(self.points) else np.zeros(0)
        span = self.high - self.low
        self.widths = np.clip(wide, span / min(100, 1 + len(self.points)), span)

    def draw(self, rng: np.random.Generator) -> float:
        k = int(rng.integers(0, len(self.points) + 1))
        if k == len(self.points):
            return float(rng.uniform(self.low, self.high))
        for _ in range(50):
            x = float(rng.normal(self.points[k], self.widths[k]))
            if self.low <= x <= self.high:
                return x
        return float(self.points[k])

    def log_density(self, x: float) -> float:
        bells = np.exp(-0.5 * ((x - self.points) / self.widths) ** 2) / (self.widths * math.sqrt(2 * math.pi)) if len(self.points) else np.zeros(0)
        return math.log((bells.sum() + 1 / (self.high - self.low)) / (len(self.points) + 1))


def suggest(trials: list[dict], space: dict[str, Range], n: int, seed: int) -> list[dict]:
    """n new settings: of candidates drawn from the good trials' densities those likeliest under these against the others'.
    trials: settings with their `value`, the larger the better; without enough of them, settings are drawn evenly."""
    rng = np.random.default_rng(seed)
    known = sorted((x for x in trials if x["value"] is not None and math.isfinite(x["value"])), key=lambda x: -x["value"])
    if len(known) < FIRST:
        return [{k: r.out(float(rng.uniform(*r.ends()))) for k, r in space.items()} for _ in range(n)]
    cut = max(2, math.ceil(GOOD * len(known)))
    good, bad = ({k: Parzen([r.into(x[k]) for x in some], r.ends()) for k, r in space.items()} for some in (known[:cut], known[cut:]))
    out = []
    for _ in range(n):
        drawn = [{k: good[k].draw(rng) for k in space} for _ in range(CANDIDATES)]
        best = max(drawn, key=lambda u: sum(good[k].log_density(v) - bad[k].log_density(v) for k, v in u.items()))
        out.append({k: space[k].out(v) for k, v in best.items()})
    return out


def search(objective: Callable[[list[dict]], list[float]], space: dict[str, Range], rounds: int, each: int, seed: int = 42) -> list[dict]:
    """All trials, with round, trial and value. objective judges a whole round of settings at once."""
    done: list[dict] = []
    for k in range(rounds):
        new = suggest(done, space, each, seed + k)
        for i, (x, v) in enumerate(zip(new, objective(new))):
            done.append({"round": k, "trial": k * each + i, **x, "value": v})
    return done


def tree_objective(rows: DataFrame, features: list[str]) -> Callable[[list[dict]], list[float]]:
    """How a round of tree settings does: the mean over groups (symbol, horizon) of the Sharpe ratio that holding after likely
    rises earns on the validation part. rows: with_targets' with r, the next bar's return; the test part is never read."""
    seen = rows.filter("part IN ('train', 'validate')")
    group = F.concat_ws("|", "symbol", "horizon")
    base = seen.select(group.alias("model"), "date", (F.col("part") == "train").alias("train"), F.col("target").cast("double").alias("y"), F.lit(1.0).alias("w"), "r", *features)
    made, cuts = t.prepared(written(base, "tuned"), features)
    made, cuts = written(made, "binned"), written(cuts, "cuts")

    def judge(settings: list[dict]) -> list[float]:
        spark = rows.sparkSession
        names = [(str(i), int(x["depth"]), int(x["leaf"]), float(x["ridge"])) for i, x in enumerate(settings)]
        table = F.broadcast(spark.createDataFrame(names, "trial string, depth int, leaf int, ridge double"))  # a row a trial
        of = F.concat_ws("#", "model", "trial").alias("model")
        limits = written(made.select("model").distinct().join(table).select(of, "depth", "leaf", "ridge"), "limits")
        each = made.join(table.select("trial"))
        grown = t.tree(each.select(of, "train", "__b", "y", "w"), cuts.join(table.select("trial")).select(of, "cuts"), t.Shape(max(x["depth"] for x in settings)), limits)
        told = t.score(each.filter("NOT train").select(of, "trial", "date", "r", "__x"), grown, max(x["depth"] for x in settings))
        earned = F.when(F.col("score") >= 0.5, F.col("r")).otherwise(0.0)
        ratio = told.groupBy("model", "trial").agg(F.coalesce(F.try_divide(F.avg(earned), F.stddev_samp(earned)), F.lit(0.0)).alias("s"))
        values = {r["trial"]: r["v"] for r in ratio.groupBy("trial").agg(F.avg(F.col("s") * math.sqrt(YEAR)).alias("v")).collect()}  # a row a trial
        return [values.get(str(i), float("-inf")) for i in range(len(settings))]

    return judge


def tune(rows: DataFrame, features: list[str], returns: DataFrame, rounds: int = 3, each: int = 8, seed: int = 42) -> DataFrame:
    """round, trial, the settings and value of every trial, best first by place. returns: symbol, date, r, the bar's own; a
    position told at a date earns the next one's."""
    ahead = returns.select("symbol", "date", F.lead("r").over(W.partitionBy("symbol").orderBy("date")).alias("r"))
    trials = search(tree_objective(rows.join(ahead, ["symbol", "date"]).filter("r is not null"), features), SPACE, rounds, each, seed)
    held = sorted(trials, key=lambda x: (-x["value"], x["trial"]))
    return rows.sparkSession.createDataFrame([(i + 1, x["round"], x["trial"], x["depth"], x["leaf"], x["ridge"], x["value"]) for i, x in enumerate(held)], "place int, round int, trial int, depth int, leaf int, ridge double, value double")
