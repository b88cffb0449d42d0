"""Sequential models: state machines that run along each symbol's series.

Rows are dealt by symbol and sorted, and each task walks its rows in a stream with one state a symbol: memory doesn't
follow the length of a series. Parallel by symbol; one series is walked by one task, as its steps feed on each other.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import change, div, flag, lag, mean, so_far, std


def scan(rows: DataFrame, inputs: list[str], outputs: str, start: Callable[[], Callable[..., tuple]], key: str = "symbol", order: str = "date", also: tuple[str, ...] = ()) -> DataFrame:
    """key, order, the columns of `also` as they are, and outputs (a DDL list) for each row: start() makes a step for a new
    key, which takes the inputs of each row in order and gives its outputs. NULL inputs come as None."""
    columns_in = [key, order, *inputs, *(c for c in also if c not in inputs)]
    dealt = rows.select(columns_in).repartition(F.col(key)).sortWithinPartitions(key, order)
    kinds, kept = dict(dealt.dtypes), [columns_in.index(c) for c in also]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, order, *also)) + f", {outputs}"
    names = [x.strip().split(" ")[0] for x in outputs.split(",")]
    types = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = [types[x.strip().split(" ")[1]] for x in outputs.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in range(2, 2 + len(inputs)))):
                if k != now or step is None:
                    now, step = k, start()
                out.append(step(*values))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(batch.column(i) for i in kept), *(pa.array(c, t) for c, t in zip(columns, arrow))], names=[key, order, *also, *names])

    return dealt.mapInArrow(run, schema)


# --- order statistics


def order_statistics(rows: DataFrame, column: str, window: int) -> DataFrame:
    """rows with __below, how many of the last `window` rows' values are less than the row's own, __held, how many of them have
    a value, and __median, which is of these. Values of the window are kept in order: a row is one search, an insertion
    and a removal, not a pass over the frame."""

    def start():
        seen: deque = deque()
        ordered: list[float] = []

        def step(x: float | None) -> tuple:
            if len(seen) == window and (old := seen.popleft()) is not None:
                del ordered[bisect_left(ordered, old)]
            seen.append(x)
            if x is not None:
                insort(ordered, x)
            n = len(ordered)
            middle = None if not n else ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
            return None if x is None else bisect_left(ordered, x), n, middle

        return step

    also = tuple(c for c in rows.columns if c not in ("symbol", "date", column))
    return scan(rows, [column], "__below int, __held int, __median double", start, also=(*also, column))


# --- averages and filters


def ema_step(*spans: int) -> Callable[[], Callable]:
    """Exponential averages seeded by the first value."""

    def start():
        state: list[float] = []

        def step(x: float) -> tuple:
            if not state:
                state.extend([x] * len(spans))
            else:
                for i, span in enumerate(spans):
                    a = 2 / (span + 1)
                    state[i] = a * x + (1 - a) * state[i]
            return tuple(state)

        return step

    return start


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Exponential averages of the close and their convergence."""

    def start():
        averages, of = ema_step(fast, slow, 50)(), ema_step(signal)()

        def step(close: float) -> tuple:
            a, b, c = averages(close)
            (s,) = of(a - b)
            return a, b, c, a - b, s, a - b - s

        return step

    out = scan(bars, ["close"], "ema_12 double, ema_26 double, ema_50 double, macd double, macd_signal double, macd_histogram double", start)
    return out


def macd_seeded(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """The convergence whose averages start from a simple average of as many values; NULL until there are enough."""

    def seeded(span: int):
        seen: list[float] = []
        state = [None]

        def step(x):
            if x is None:
                return None
            if state[0] is None:
                seen.append(x)
                if len(seen) == span:
                    state[0] = sum(seen) / span
            else:
                a = 2 / (span + 1)
                state[0] = (x - state[0]) * a + state[0]
            return state[0]

        return step

    def start():
        f, s, g = seeded(fast), seeded(slow), seeded(signal)

        def step(close: float) -> tuple:
            a, b = f(close), s(close)
            line = None if a is None or b is None else a - b
            sig = g(line)
            return line, sig, None if sig is None else line - sig

        return step

    return scan(bars, ["close"], "macd double, signal double, histogram double", start)


def kalman_step(q: float, r: float, mean0: float | None = None) -> Callable[[], Callable]:
    """Local-level filter; the first value is corrected without a prediction. mean0: the first mean, by default that value."""

    def start():
        state = [mean0, 1.0, True]

        def step(z: float) -> tuple:
            m = z if state[0] is None else state[0]
            p = state[1] if state[2] else state[1] + q
            k = p / (p + r)
            state[:] = [m + k * (z - m), (1 - k) * p, False]
            return state[0], state[1]

        return step

    return start


def kalman(bars: DataFrame) -> DataFrame:
    """Smoothed price and returns, and features of the smoothed price."""

    def start():
        price, returns = kalman_step(0.01, 1.0)(), kalman_step(0.001, 1.0, 0.0)()
        return lambda close, r: (price(close)[0], returns(r)[0])

    moved = bars.withColumn("r", F.coalesce(change("close"), F.lit(0.0)))
    out = scan(moved.withColumn("c", F.col("close")), ["c", "r"], "kalman_price double, kalman_returns double", start, also=("close",))
    return out.select("symbol", "date", "kalman_price", "kalman_returns", (F.col("close") - F.col("kalman_price")).alias("price_kalman_residual"), div("close", "kalman_price").alias("kalman_price_ratio"), (F.col("kalman_price") - lag("kalman_price", 5)).alias("kalman_momentum"), flag(F.col("kalman_price") > mean("kalman_price", 20, 1)).alias("kalman_trend"))


# --- overlays of the volatility index


@dataclass(frozen=True)
class Tier:
    back: int
    leave: float
    enter: float
    days: int


# The parameters of the tiers.
TIERS = {"tier1": Tier(10, 0.50, 0.15, 5), "tier2": Tier(2, 0.20, 0.0, 1), "tier3": Tier(5, 0.75, -0.10, 2)}
TIER_OF = {"A": "tier1", "N": "tier2", "R": "tier3"}


def tier_table(spark) -> DataFrame:
    return spark.createDataFrame([(s, t, p.back, p.leave, p.enter, p.days) for s, t in TIER_OF.items() for p in [TIERS[t]]], "symbol string, tier string, back int, leave double, enter double, days int")


def hysteresis_start(inside: bool = True, out_for: int = 0):
    """A step; its attribute `state` holds whether it is in the market and for how many rows it has been out."""
    state = [inside, out_for]

    def step(i: int, roc: float, back: int, leave: float, enter: float, days: int) -> tuple:
        if i < back:
            return 1, 0
        if state[0]:
            if roc > leave:
                state[:] = [False, 0]
                return 0, -1
            return 1, 0
        state[1] += 1
        if state[1] >= days and roc < enter:
            state[0] = True
            return 1, 1
        return 0, 0

    step.state = state
    return step


def roc_overlay(bars: DataFrame, vix: DataFrame, params: DataFrame) -> DataFrame:
    """In or out of the market by the index's rate of change: out above `leave`, in again after `days` bars and below
    `enter`. params: symbol, tier, back, leave, enter, days. Bars without an index value are left out."""
    out = bars.join(vix, "date").join(F.broadcast(params), "symbol")
    order = W.partitionBy("symbol").orderBy("date")
    out = out.withColumn("i", F.row_number().over(order) - 1)
    before = F.coalesce(*[F.when(F.col("back") == k, F.lag("vix", k).over(order)) for k in sorted({t.back for t in TIERS.values()})])
    out = out.withColumn("vix_roc", F.coalesce(F.when(before > 0, (F.col("vix") - before) / before), F.lit(0.0)))
    return scan(out, ["i", "vix_roc", "back", "leave", "enter", "days"], "position int, move int", hysteresis_start, also=("close", "vix", "tier", "vix_roc"))


GRID = [(back, leave, enter, days) for back in (3, 5, 7, 10) for leave in (0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50) for enter in (0.15, 0.10, 0.05, 0.0, -0.05, -0.10) for days in (1, 2, 3, 5)]


def grid_search(bars: DataFrame, vix: DataFrame, grid: list[tuple[int, float, float, int]] = GRID, until: str = "9999-12-31") -> DataFrame:
    """By symbol and combination (back, leave, enter, days) of the rate-of-change overlay: excess growth, deepest falls,
    score (excess and half of what the fall improves) up to the date `until` (training) and after it (test).

    All combinations walk a symbol's rows side by side, as arrays; symbols are walked in parallel. Bars without an index
    value are left out.
    """
    g = np.array(grid, float)
    schema = "symbol string, back int, leave double, enter double, days int, part string, excess double, bh_max_dd double, strategy_max_dd double, score double, num_days int"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        close, index, train = rows["close"].to_numpy(float), rows["vix"].to_numpy(float), (rows["date"] <= pd.Timestamp(until).date()).to_numpy() if until < "9999" else np.ones(len(rows), bool)
        back, leave, enter, days = g[:, 0].astype(int), g[:, 1], g[:, 2], g[:, 3]
        inside, out_for = np.ones(len(g), bool), np.zeros(len(g))
        position = np.ones((len(rows), len(g)))
        for i in range(len(rows)):
            at = np.maximum(i - back, 0)
            roc = np.where((i >= back) & (index[at] > 0), index[i] / np.where(index[at] > 0, index[at], 1) - 1, 0.0)
            live = i >= back
            leaves = live & inside & (roc > leave)
            waits = live & ~inside
            out_for = np.where(leaves, 0, out_for + waits)
            returns = waits & (out_for >= days) & (roc < enter)
            inside = (inside & ~leaves) | returns
            position[i] = inside
        r = np.diff(close) / close[:-1]
        held = position[:-1] * r[:, None]
        out = []
        for name, rows_in in (("train", train[1:]), ("test", ~train[1:])):
            if not rows_in.any():
                continue
            a, b = np.cumprod(1 + held[rows_in], axis=0), np.cumprod(1 + r[rows_in])
            fall, base = (a / np.maximum.accumulate(a, axis=0) - 1).min(axis=0), (b / np.maximum.accumulate(b) - 1).min()
            excess = a[-1] - b[-1]
            out.append(pd.DataFrame({"symbol": rows["symbol"].iloc[0], "back": back.astype("int32"), "leave": leave, "enter": enter, "days": days.astype("int32"), "part": name, "excess": excess, "bh_max_dd": base, "strategy_max_dd": fall, "score": excess + 0.5 * (fall - base), "num_days": np.int32(rows_in.sum())}))
        return pd.concat(out) if out else pd.DataFrame({c.split(" ")[0]: [] for c in schema.split(", ")})

    return bars.join(vix, "date").select("symbol", "date", "close", "vix").groupBy("symbol").applyInPandas(walk, schema)


def best_of_grid(searched: DataFrame, k: int = 5) -> DataFrame:
    """The k best combinations of each symbol by training score (ties to the smaller parameters), with their test score."""
    key = ["symbol", "back", "leave", "enter", "days"]
    place = W.partitionBy("symbol").orderBy(F.desc(F.round("score", 9)), "back", "leave", "enter", "days")
    train = searched.filter("part = 'train'").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    test = searched.filter("part = 'test'").select(*key, F.col("score").alias("test_score"), F.col("excess").alias("test_excess"))
    return train.select(*key, "place", "score", "excess", "num_days").join(test, key, "left")


def overlay_backtest(positions: DataFrame) -> DataFrame:
    """By symbol: log return and deepest fall of holding, and of holding by yesterday's position."""
    out = positions.withColumn("r", change("close")).withColumn("s", lag("position") * F.col("r")).filter("r is not null")
    for c in ("r", "s"):
        out = out.withColumn(f"c_{c}", F.product(1 + F.col(c)).over(so_far()))
        out = out.withColumn(f"d_{c}", F.col(f"c_{c}") / F.max(f"c_{c}").over(so_far()) - 1)
    g = out.groupBy("symbol", "tier").agg(F.max_by("c_r", "date").alias("b"), F.max_by("c_s", "date").alias("a"), F.min("d_r").alias("bh_max_dd"), F.min("d_s").alias("strategy_max_dd"), F.count_if(F.col("move") == -1).alias("num_trades"), F.count("*").alias("days"))
    return g.select("symbol", "tier", F.log("b").alias("bh_log_return"), F.log("a").alias("strategy_log_return"), F.log(F.col("a") / F.col("b")).alias("excess_log_return"), "bh_max_dd", "strategy_max_dd", (F.col("strategy_max_dd") - F.col("bh_max_dd")).alias("dd_improvement"), "num_trades", flag(F.col("a") > F.col("b")).alias("win"), "days")


def _index(vix: DataFrame) -> DataFrame:
    """The index as one series, with its change over five rows against at least 1."""
    out = vix.withColumn("symbol", F.lit("vix"))
    return out.withColumn("roc", F.coalesce((F.col("vix") - lag("vix", 5)) / F.greatest(lag("vix", 5), F.lit(1.0)), F.lit(0.0)))


def spike_overlay(vix: DataFrame) -> DataFrame:
    """Half a position while the index is above 20 and up 30 percent in five rows: no state at all."""
    out = _index(vix)
    spike = (F.col("vix") > 20) & (F.col("roc") > 0.3)
    return out.select("date", "vix", F.col("roc").alias("vix_roc"), F.when(spike, 0.5).otherwise(1.0).alias("position"), F.when(spike, "SPIKE").otherwise("NORMAL").alias("reason"))


def hybrid_start():
    state = [False, 0]

    def step(vix: float, roc: float) -> tuple:
        if not state[0] and vix > 20 and roc > 0.3:
            state[:] = [True, 0]
        if not state[0]:
            return 1.0, 0
        state[1] += 1
        if state[1] >= 5 and vix < 25:
            state[:] = [False, 0]
            return 1.0, 0
        return (max(0.2, 0.5 - (vix - 30) * 0.01) if vix > 30 else 0.5), state[1]

    return step


def hybrid_overlay(vix: DataFrame) -> DataFrame:
    """Protection from a spike on, for five rows at least and until the index is below 25."""
    return scan(_index(vix), ["vix", "roc"], "position double, protected_days int", hybrid_start).drop("symbol")


def ladder(vix: float, boost: float) -> float:
    return min(1.0, (1.0 if vix < 30 else 0.8 if vix < 40 else 0.6 if vix < 50 else 0.45 if vix < 60 else 0.3) + boost)


def final_start():
    state = [False, 0, 0.0]

    def step(vix: float, roc: float, calm: float) -> tuple:
        if not state[0]:
            if roc > 0.25 and vix > 18:
                state[:] = [True, 0, vix]
                return ladder(vix, 0.0), 1
            return 1.0, 0
        state[1] += 1
        state[2] = max(state[2], vix)
        place = ladder(vix, 0.1 if calm > 0.3 else 0.0)
        if state[1] >= 2 and (state[2] - vix) / state[2] > 0.15 and place >= 0.95:
            state[:] = [False, state[1], 0.0]
            return 1.0, 0
        return place, 1

    return step


def _with_odds(vix: DataFrame) -> DataFrame:
    """The index with odds of a spike and of a calm, told from its z-score of 60 rows by a logistic curve."""
    out = _index(vix).withColumn("z", F.coalesce(div(F.col("vix") - mean("vix", 60), std("vix", 60)), F.lit(0.0)))
    return out.withColumn("spike_prob", 1 / (1 + F.exp(1 + F.col("z")))).withColumn("calm_prob", 1 / (1 + F.exp(1 - F.col("z"))))


def final_overlay(vix: DataFrame) -> DataFrame:
    """Protection from a spike until the index has dropped 15 percent from its peak, sized by its level."""
    return scan(_with_odds(vix), ["vix", "roc", "calm_prob"], "position double, protected int", final_start).drop("symbol")


def enhanced_start():
    state = [False, 0, 0, None]  # protected, days, falling, last

    def step(vix: float, roc: float, spike: float, calm: float) -> tuple:
        if state[3] is not None:
            state[2] = state[2] + 1 if vix - state[3] < 0 else 0
        state[3] = vix
        if not state[0]:
            if roc > 0.25 and vix > 18:
                state[0], state[1], state[2] = True, 0, 0
                return 0.45, 1
            return (0.8 if spike > 0.55 else 1.0), 0
        state[1] += 1
        if state[1] >= 1 and state[2] >= 2:
            if vix < 35 or calm > 0.3:
                state[0] = False
                return 1.0, 0
            return 0.7, 1
        if state[1] >= 1 and calm > 0.3 and vix < 30:
            state[0] = False
            return 1.0, 0
        return 0.45, 1

    return step


def enhanced_overlay(vix: DataFrame) -> DataFrame:
    """Protection from a spike until the index falls two rows running, or the odds of a calm are high."""
    return scan(_with_odds(vix), ["vix", "roc", "spike_prob", "calm_prob"], "position double, protected int", enhanced_start).drop("symbol")


def leading(vix: DataFrame) -> DataFrame:
    """Risk told by the index's level and rate of change (term structure and credit are neutral without their series)."""
    out = _index(vix)
    v, roc = F.col("vix"), F.col("roc")
    level = F.when(v < 15, 0.0).when(v < 35, 0.5 * (v - 15) / 20).when(v < 50, 0.5 + 0.3 * (v - 35) / 15).otherwise(0.8 + 0.2 * (1 - F.exp(-(v - 50) / 20)))
    pace = F.when(roc < 0, 0.0).when(roc < 0.2, 0.3 * roc / 0.2).when(roc < 0.4, 0.3 + 0.4 * (roc - 0.2) / 0.2).otherwise(0.7 + 0.3 * (1 - F.exp(-(roc - 0.4) / 0.3)))
    n = F.count("vix").over(so_far())
    z = F.when(n >= 20, (v - F.avg("vix").over(so_far())) / F.greatest(F.stddev_pop("vix").over(so_far()), F.lit(1e-4))).otherwise(0.0)
    regime = F.when(v < 15, "low").when(v < 20, "normal").when(v < 35, "elevated").when(v < 50, "high").otherwise("extreme")
    return out.select("symbol", "date", "vix", regime.alias("vix_regime"), roc.alias("vix_roc"), z.alias("vix_zscore"), level.alias("risk_vix_level"), pace.alias("risk_vix_roc"), (0.25 * level + 0.35 * pace).alias("leading_risk"))


def tunable_start():
    state = [False, 0]

    def step(vix: float, roc: float, risk: float) -> tuple:
        if vix > 40:
            state[:] = [True, 0]
            return 0.35, "VIX_EMERGENCY"
        if risk > 0.3:
            state[:] = [True, 0]
            return 0.6, "LEADING_OVERRIDE"
        if state[0]:
            calming = vix < 25 and roc < -0.1 and risk < 0.3
            state[1] = state[1] + 1 if calming else 0
            if state[1] >= 3:
                state[:] = [False, 0]
                return 1.0, "RECOVERED"
            return (0.6 + state[1] / 3 * 0.4, "RECOVERING") if calming else (0.6, "PROTECTED")
        return (0.9, "ELEVATED") if risk > 0.2 else (1.0, "NORMAL")

    return step


def tunable_overlay(vix: DataFrame) -> DataFrame:
    """Protection by the leading risk, with a return in steps."""
    return scan(leading(vix), ["vix", "vix_roc", "leading_risk"], "position double, reason string", tunable_start).drop("symbol")


# --- change points

MAX_RUN = 500


class RunLength:
    """Bayesian online change-point detection with a normal-inverse-gamma model; at most MAX_RUN run lengths are kept.

    first: a new run counts the value it starts with, and the shortest runs are kept. Otherwise it starts from the prior,
    and the likeliest are.
    """

    def __init__(self, hazard: float = 0.01, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0, mu: float = 0.0, first: bool = True):
        self.h, self.kappa, self.alpha, self.beta, self.mu, self.first = hazard, kappa, alpha, beta, mu, first
        self.log_r, self.n, self.s, self.q, self.length = np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1, int)

    def update(self, x: float) -> tuple[float, int, float]:
        """Chance that a run starts, likeliest run length, expected run length."""
        n, k = self.n, self.kappa + self.n
        middle = np.where(n > 0, self.s / np.maximum(n, 1), 0.0)
        mu, alpha = (self.kappa * self.mu + self.s) / k, self.alpha + n / 2
        beta = self.beta + 0.5 * np.maximum(self.q - n * middle**2, 0) + 0.5 * self.kappa * n * (middle - self.mu) ** 2 / k
        df, scale = 2 * alpha, np.maximum(beta * (k + 1) / (alpha * k), 1e-10)
        lg = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) for d in df])
        pred = lg - 0.5 * np.log(df * np.pi * scale) - (df + 1) / 2 * np.log1p((x - mu) ** 2 / (df * scale))
        self.log_r = _grown(self.log_r + pred, self.h)
        new = (1.0, x, x * x) if self.first else (0.0, 0.0, 0.0)
        self.n, self.s, self.q = (np.concatenate([[a], b + c]) for a, b, c in zip(new, (self.n, self.s, self.q), (1.0, x, x * x)))
        self.length = np.concatenate([[0], self.length + 1])
        if len(self.log_r) > MAX_RUN:
            kept = np.arange(MAX_RUN) if self.first else np.sort(np.argsort(self.log_r, kind="stable")[-MAX_RUN:])
            self.log_r, self.n, self.s, self.q, self.length = (v[kept] for v in (self.log_r, self.n, self.s, self.q, self.length))
            if not self.first:
                self.log_r = self.log_r - math.log(np.exp(self.log_r).sum())
        p = np.exp(self.log_r)
        return float(p[0]) if self.length[0] == 0 else 0.0, int(self.length[p.argmax()]), float((self.length * p).sum())


def _grown(joint: np.ndarray, hazard: float) -> np.ndarray:
    """Log odds of run lengths 0, 1, ... after a value whose log density under each run is in joint."""
    top = joint.max()
    whole = top + math.log(np.exp(joint - top).sum())
    new = np.concatenate([[whole + math.log(hazard)], joint + math.log1p(-hazard)])
    top = new.max()
    return new - top - math.log(np.exp(new - top).sum())


class RunLengths:
    """The same for several values at once: normal marginals of each run's own mean and variance; runs of fewer than two
    values have the prior variance about 0. A new run starts empty."""

    def __init__(self, hazard: float, dimension: int, beta: float = 1.0):
        self.h, self.beta = hazard, beta
        self.log_r, self.n = np.zeros(1), np.zeros(1)
        self.s, self.q = np.zeros((1, dimension)), np.zeros((1, dimension))

    def update(self, xs: tuple[float, ...]) -> tuple[float, int, float]:
        x, n = np.array(xs, float), np.maximum(self.n, 1)[:, None]
        few = self.n[:, None] < 2
        mean = np.where(few, 0.0, self.s / n)
        var = np.where(few, self.beta, np.maximum(self.q / n - mean**2, 1e-6))
        self.log_r = _grown(self.log_r - 0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var).sum(axis=1), self.h)[:MAX_RUN]
        self.n = np.concatenate([[0.0], self.n + 1])[:MAX_RUN]
        self.s, self.q = (np.concatenate([np.zeros((1, len(x))), a + b])[:MAX_RUN] for a, b in ((self.s, x), (self.q, x * x)))
        p = np.exp(self.log_r)
        return float(p[0]), int(p.argmax()), float((np.arange(len(p)) * p).sum())


def bocpd(bars: DataFrame, hazard: float = 0.01) -> DataFrame:
    """Change-point probabilities and run lengths of standardised returns; the first return is 0."""

    def start():
        model = RunLength(hazard)
        last_map = [0]

        def step(x: float) -> tuple:
            p, m, e = model.update(x)
            drop, last_map[0] = last_map[0] > 5 and m <= 2, m
            return p, m, e, int(drop)

        return step

    r = F.coalesce(change("close"), F.lit(0.0))
    out = bars.withColumn("r", F.signum(r) * F.log1p(F.abs(r)))
    return scan(out, ["r"], "cp_prob double, map_run_length int, expected_run_length double, map_drop int", start)


def min_duration(labels: DataFrame, days: int = 5) -> DataFrame:
    """symbol, date, regime -> regime with runs shorter than `days` given the label of the original run before them; a short
    first run takes that of the run after it."""
    starts = F.coalesce(F.col("regime") != lag("regime"), F.lit(True))
    out = labels.withColumn("run", F.sum(starts.cast("int")).over(so_far()))
    runs = out.groupBy("symbol", "run").agg(F.first("regime").alias("label"), F.count("*").alias("n"))
    by = W.partitionBy("symbol").orderBy("run")
    runs = runs.withColumn("smooth", F.when(F.col("n") < days, F.coalesce(F.lag("label").over(by), F.lead("label").over(by), F.col("label"))).otherwise(F.col("label")))
    return out.join(runs.select("symbol", "run", "smooth"), ["symbol", "run"]).select("symbol", "date", "regime", "run", F.col("smooth").alias("regime_smooth"))


# --- ledger


def ledger_start(cash: float = 100_000.0, share: float = 0.2, slip: float = 0.0005, fee: float = 1.0, stop: float = 0.1):
    def start():
        state = [cash, 0.0, 0.0]  # cash, shares, price paid

        def step(close: float, want: int) -> tuple:
            pnl, did = 0.0, "hold"
            if state[1] and (not want or close < state[2] * (1 - stop)):
                price = close * (1 - slip)
                pnl = state[1] * (price - state[2]) - fee
                state[:] = [state[0] + state[1] * price - fee, 0.0, 0.0]
                did = "sell"
            elif not state[1] and want:
                price = close * (1 + slip)
                spend = state[0] * share
                if spend + fee <= state[0]:
                    state[:] = [state[0] - spend - fee, spend / price, price]
                    did = "buy"
            return did, state[0], state[1], state[0] + state[1] * close, pnl

        return step

    return start


def ledger(positions: DataFrame) -> DataFrame:
    """symbol, date, close, position -> what a ledger of one symbol does each day: slippage, fee and stop included."""
    return scan(positions, ["close", "position"], "action string, cash double, shares double, equity double, pnl double", ledger_start())


def online_features(bars: DataFrame, alpha: float = 0.06) -> DataFrame:
    """What the online engine tells of each bar from those before it: returns over a running deviation, close's place in
    the range and the opening gap. (The range against its own past is in labels.tail_rates.)"""

    def start():
        state = [None, 0.0001]

        def step(o: float, h: float, low: float, c: float) -> tuple:
            if state[0] is None:
                state[0] = c
                return 0.0, math.sqrt(state[1]), 0.0, 0.0
            r = math.log(c / state[0])
            sigma = math.sqrt(max(state[1], 1e-12))
            gap = math.log(o / state[0])
            place = (2 * c - h - low) / (h - low) if h > low else 0.0
            state[:] = [c, alpha * r * r + (1 - alpha) * state[1]]
            return r / sigma, sigma, place, gap / sigma

        return step

    out = scan(bars.withColumns({"o": F.col("open"), "h": F.col("high"), "l": F.col("low"), "c": F.col("close")}), ["o", "h", "l", "c"], "ret_z double, sigma double, clv double, gap_z double", start)
    return out
