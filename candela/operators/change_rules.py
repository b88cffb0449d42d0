"""Trading rules and studies on change points: direction, volatility and both; full leading risk; hazards that follow volatility."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import change, div, lag, mean, std
from candela.operators.sequences import RunLength, leading, scan
from candela.operators.wavelets import ALPHA, BETA, KAPPA, LONG, SHORT

# Weights of the four risks, and where term structure and credit spreads warn.
WEIGHTS = {"risk_vix_level": 0.25, "risk_vix_roc": 0.35, "risk_vix_term": 0.15, "risk_credit": 0.25}
INVERTED, SPREAD_WARNS, SPREAD_DANGER, SPREAD_SPAN = 1.05, 1.5, 2.5, 20


class Runs:
    """A change-point model on values standardised by all so far, and the values since the last change that counts: the
    likeliest run fell from over LONG to SHORT or less, `spacing` values or more after the one before."""

    def __init__(self, hazard: float, spacing: int, kept: int):
        self.model, self.spacing = RunLength(hazard, KAPPA, ALPHA, BETA), spacing
        self.n, self.mean, self.m2, self.i, self.began, self.before = 0, 0.0, 0.0, -1, 0, 0
        self.since: deque = deque(maxlen=kept)
        self.held = 0

    def update(self, x: float) -> bool:
        self.i, self.n = self.i + 1, self.n + 1
        step = x - self.mean
        self.mean += step / self.n
        self.m2 += step * (x - self.mean)
        sd = math.sqrt(self.m2 / self.n)
        run = self.model.update((x - self.mean) / sd if sd > 1e-12 else 0.0)[1]
        changed = self.before > LONG and run <= SHORT and self.i - self.began >= self.spacing
        self.before = run
        if changed:
            self.began, self.held = self.i, 0
            self.since.clear()
        self.since.append(x)
        self.held += 1
        return changed

    def recent(self, k: int) -> float:
        some = list(self.since)[-k:]
        return sum(some) / len(some)


def change_points(rows: DataFrame, column: str, hazard: float = 0.01, spacing: int = 5) -> DataFrame:
    """symbol, date of the changes of a column that the model tells, spaced."""
    found = scan(rows, [column], "changed boolean", lambda: (lambda m: lambda x: (m.update(x),))(Runs(hazard, spacing, 1)))
    return found.filter("changed").select("symbol", "date")


def by_direction(returns: DataFrame, hazard: float = 0.01, lookback: int = 5, spacing: int = 5, long_only: bool = True) -> DataFrame:
    """symbol, date, r -> regime and position: the sign of the mean of the last values since the last change, once there are
    `lookback` of them; until then what stood before."""

    def start():
        runs, state = Runs(hazard, spacing, lookback), ["neutral"]

        def step(r: float) -> tuple:
            runs.update(r)
            if runs.held >= lookback:
                m = runs.recent(lookback)
                state[0] = "bullish" if m > 0 else "bearish" if m < 0 else "neutral"
            return state[0], {"bullish": 1.0, "bearish": 0.0 if long_only else -1.0, "neutral": 0.0}[state[0]]

        return step

    return scan(returns, ["r"], "regime string, position double", start, also=("r",))


def by_volatility(returns: DataFrame, hazard: float = 0.02, times: float = 1.5) -> DataFrame:
    """symbol, date, r -> regime and position: out while the mean size of the last five returns since the last change is over
    `times` that of all so far; in at first."""

    def start():
        runs, state = Runs(hazard, 5, 5), ["low_vol"]

        def step(r: float) -> tuple:
            runs.update(abs(r))
            if runs.held >= 3:
                state[0] = "high_vol" if runs.recent(5) > runs.mean * times else "low_vol"
            return state[0], 0.0 if state[0] == "high_vol" else 1.0

        return step

    return scan(returns, ["r"], "regime string, position double", start, also=("r",))


def by_both(returns: DataFrame, fast: float = 1 / 20, slow: float = 1 / 50, times: float = 1.2) -> DataFrame:
    """symbol, date, r -> bullish, wild, position: half in while volatility since its last change is over `times` its median so
    far, all in otherwise, and out while the exponential mean of returns since its last change isn't positive. Volatility is
    that of 20 returns, of those there are before."""

    def start():
        from bisect import insort

        trend, vol = Runs(fast, 3, 10), Runs(slow, 5, 10)
        state: dict = {"up": 0.0, "down": 0.0}
        past: deque = deque(maxlen=20)
        seen: list[float] = []

        def step(r: float) -> tuple:
            state["up"], state["down"] = r + state["up"] * (2 / 3), 1 + state["down"] * (2 / 3)  # span 5, weights that sum to one
            trend.update(state["up"] / state["down"])
            past.append(r)
            m = sum(past) / len(past)
            v = math.sqrt(sum((x - m) ** 2 for x in past) / (len(past) - 1)) * math.sqrt(252) if len(past) > 1 else 0.0
            vol.update(v)
            middle = 0.0 if not seen else (seen[len(seen) // 2] + seen[(len(seen) - 1) // 2]) / 2
            insort(seen, v)
            bullish = trend.held >= 2 and trend.recent(10) > 0
            wild = bool(seen[1:]) and vol.recent(10) > times * middle
            return int(bullish), int(wild), (0.5 if wild else 1.0) if bullish else 0.0

        return step

    return scan(returns, ["r"], "bullish int, wild int, position double", start, also=("r",))


def earned(told: DataFrame) -> DataFrame:
    """By symbol: days, log growth of the position of the day before and of holding, and trades."""
    by = W.partitionBy("symbol").orderBy("date")
    rows = told.withColumn("held", F.coalesce(F.lag("position").over(by), F.lit(0.0)))
    moved = F.col("held") != F.coalesce(F.lag("held").over(by), F.lit(0.0))
    return rows.withColumn("moved", moved).groupBy("symbol").agg(F.count("*").alias("days"), F.sum(F.log1p(F.col("held") * F.col("r"))).alias("strategy"), F.sum(F.log1p("r")).alias("hold"), F.count_if("moved").alias("trades"))


def four_signals(bars: DataFrame) -> DataFrame:
    """symbol, signal, date, x: returns, log prices, their mean and deviation over 20 bars."""
    out = bars.select("symbol", "date", change("close").alias("returns"), F.log("close").alias("log_price"))
    out = out.withColumns({"rolling_mean": mean("returns", 20), "rolling_vol": std("returns", 20)}).na.drop()
    kinds = ("returns", "log_price", "rolling_mean", "rolling_vol")
    return out.select("symbol", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("x")) for k in kinds])).alias("s")).select("symbol", "s.signal", "date", "s.x")


def regime_inputs(bars: DataFrame) -> DataFrame:
    """What the regime strategies are fed from closes and volumes alone; rows where all are known."""
    out = bars.select("symbol", "date", "close", F.coalesce("volume", F.lit(1e6)).alias("volume"), change("close").alias("returns"), F.log(div("close", lag("close"))).alias("log_returns"), change("close", 10).alias("momentum_10d"), change("close", 20).alias("momentum_20d"))
    out = out.withColumns({"realized_vol": std("returns", 20), "trend_strength": F.abs(mean("returns", 20)), "volume_ma": mean("volume", 20), "hl_range": F.abs("returns")})
    out = out.withColumns({"volume_momentum": (F.col("volume") - F.col("volume_ma")) / (F.col("volume_ma") + 1e-10), "vol_adj_returns": F.col("returns") / (F.col("realized_vol") + 1e-10)})
    return out.drop("volume_ma").na.drop()


def _piece(x: Column, a: float, b: float, low: float, high: float) -> Column:
    return low + (high - low) * (x - a) / (b - a)


def full_leading(vix: DataFrame, longer: DataFrame, spreads: DataFrame) -> DataFrame:
    """The four risks and their weighted mean: date, vix; date, level (the index of a longer term); date, spread (credit). Days
    without the longer index or a spread have neutral risks there; the spread's z-score is over the last 20 spreads, 0 until
    there are as many."""
    by = W.orderBy("date").rowsBetween(1 - SPREAD_SPAN, 0)  # a calendar of days
    z = spreads.withColumn("z", F.when(F.count("spread").over(by) >= SPREAD_SPAN, (F.col("spread") - F.avg("spread").over(by)) / F.greatest(F.stddev_pop("spread").over(by), F.lit(1e-8))).otherwise(0.0))
    out = leading(vix).join(longer, "date", "left").join(z.select("date", F.col("spread").alias("credit_spread"), "z"), "date", "left")
    ratio, score = F.coalesce(div("vix", "level"), F.lit(1.0)), F.coalesce("z", F.lit(0.0))
    term = F.when(ratio < 1, 0.0).when(ratio < INVERTED, _piece(ratio, 1.0, INVERTED, 0.0, 0.5)).otherwise(0.5 + 0.5 * (1 - F.exp(-(ratio - INVERTED) / 0.1)))
    credit = F.when(score < 0, 0.0).when(score < SPREAD_WARNS, _piece(score, 0.0, SPREAD_WARNS, 0.0, 0.3)).when(score < SPREAD_DANGER, _piece(score, SPREAD_WARNS, SPREAD_DANGER, 0.3, 0.7)).otherwise(0.7 + 0.3 * (1 - F.exp(-(score - SPREAD_DANGER))))
    out = out.withColumns({"term_ratio": ratio, "term_inverted": (ratio > INVERTED).cast("int"), "credit_zscore": score, "risk_vix_term": term, "risk_credit": credit})
    total = sum((F.col(c) * v for c, v in list(WEIGHTS.items())[1:]), F.col("risk_vix_level") * WEIGHTS["risk_vix_level"])
    return out.select("date", "vix", "vix_regime", "vix_roc", "vix_zscore", "term_ratio", "term_inverted", "credit_zscore", *WEIGHTS, (total / sum(WEIGHTS.values())).alias("leading_risk"))


def combined(risks: DataFrame, mode: str = "max", own: float = 0.4, lead: float = 0.6, override: float = 0.7, position: float = 0.5) -> DataFrame:
    """risks (date, bocpd_risk, leading_risk) with risk and position: the larger, the weighted mean or the noisy-or of both; a
    leading risk over `override` sets the position, else it falls from 1 to 0.25 with the risk."""
    a, b = F.col("bocpd_risk"), F.col("leading_risk")
    risk = {"max": F.greatest(a, b), "weighted": (own * a + lead * b) / (own + lead), "product": 1 - (1 - a) * (1 - b)}[mode]
    return risks.withColumn("risk", risk).withColumn("position", F.when(b > override, position).otherwise(1 - 0.75 * F.col("risk")))


def hazards(rows: DataFrame, kind: str = "sigmoid", low: float = 1 / 252, high: float = 1 / 42, base: float = 1 / 126, span: int = 21, history: int = 126) -> DataFrame:
    """rows (symbol, date, x) with hazard: between low and high by the z-score of x's deviation, held within 3, on a line, by a
    hyperbolic tangent or by a logistic curve; base until there is enough history."""
    out = rows.withColumn("vol", std("x", span))
    z = F.try_divide(F.col("vol") - mean("vol", history), std("vol", history))
    z = F.when(z.isNotNull(), F.least(F.lit(3.0), F.greatest(F.lit(-3.0), z)))
    share = {"linear": (z + 3) / 6, "tanh": (F.tanh(z) + 1) / 2, "sigmoid": 1 / (1 + F.exp(-z))}[kind]
    return out.select("symbol", "date", "x", F.coalesce(low + (high - low) * share, F.lit(base)).alias("hazard"))


