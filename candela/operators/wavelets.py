"""Orthogonal wavelet filter banks over series in long form: symbol, signal (which series of the symbol), date, x.

A level of the bank is one aggregation: each value is sent, weighted by the filters' taps, to the coefficients that it is
part of, and coefficients are sums by place. So no task holds a series, whatever its length, and partial sums are formed
before the shuffle. Whole-series operators look ahead by nature; `undecimated` and `causal` do not.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.frames import change
from candela.operators.sequences import RunLength, scan

KEY = ["symbol", "signal"]
#: Details are cut at these shares of a series' largest magnitude: moderate and light.
SHARES = {"smooth": 0.5, "aggressive": 0.1}


@cache
def taps(order: int = 6) -> tuple[float, ...]:
    """The 2 x order scaling taps of Daubechies' wavelet with `order` vanishing moments and extremal phase.

    They follow from the rule: (1 + z) ** order times the factor whose squared magnitude on the circle is the binomial
    polynomial of the half-band filter, taken with the roots inside the circle."""
    halfband = [math.comb(order - 1 + k, k) for k in range(order)][::-1]
    poly = np.array([1.0])
    for y in np.roots(halfband) if order > 1 else []:
        b = 1 - 2 * y  # y = (2 - z - 1/z) / 4
        z = b + np.sqrt(b * b - 1 + 0j)
        poly = np.convolve(poly, [1.0, -(z if abs(z) < 1 else 1 / z)])
    for _ in range(order):
        poly = np.convolve(poly, [1.0, 1.0])
    h = np.real(poly)
    return tuple((h * (math.sqrt(2) / h.sum())).tolist())


@cache
def detail_taps(order: int = 6) -> tuple[float, ...]:
    h = taps(order)
    return tuple((-1) ** m * h[len(h) - 1 - m] for m in range(len(h)))


def depth(n: int, order: int = 6) -> int:
    """Levels that a series of n values has."""
    return max(0, int(math.log2(n / (2 * order - 1)))) if n >= 2 * order - 1 else 0


def series(rows: DataFrame) -> DataFrame:
    """rows with i, the place in the series from 0, and n, its length. Missing values of x count as 0."""
    by = W.partitionBy(*KEY)
    return rows.withColumns({"x": F.coalesce("x", F.lit(0.0)), "i": F.row_number().over(by.orderBy("date")) - 1, "n": F.count("*").over(by).cast("int")})


def deepest(rows: DataFrame, order: int = 6) -> int:
    """Levels of the longest series."""
    return depth(rows.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, order)


def _size(level: int) -> Column:
    """Coefficients of a level: halves, rounded up."""
    return F.ceil(F.col("n") / (1 << level)).cast("int")


def _even(level: int) -> Column:
    return _size(level) + _size(level) % 2


def _sent(rows: DataFrame, live: Column, to: Column) -> DataFrame:
    """Rows with their parts (kind, level, k, x) where they are live, unchanged elsewhere; sums by place."""
    same = F.array(F.struct("kind", "level", "k", "x"))
    parts = rows.select(*KEY, "n", "peak", F.explode(F.when(live, to).otherwise(same)).alias("p")).select(*KEY, "n", "peak", "p.*")
    return parts.filter("k is not null").groupBy(*KEY, "n", "peak", "kind", "level", "k").agg(F.sum("x").alias("x"))


def _part(kind: str, level: int, k: Column, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), k.cast("int").alias("k"), x.alias("x"))


def analyse(rows: DataFrame, levels: int | None = None, order: int = 6) -> DataFrame:
    """symbol, signal, n, peak, kind ('a' or 'd'), level, k, x: the coefficients of each series, continued periodically.

    levels: how many at most (as many as the longest series has, by default); each series has those that its own length
    allows, `depth`. A level with an odd number of values repeats its last. peak is the series' largest magnitude. The 'a'
    rows are the approximation below its last level. Energy is kept where no level is odd."""
    h, g, half = taps(order), detail_taps(order), order
    levels = deepest(rows, order) if levels is None else levels
    out = series(rows).select(*KEY, "n", F.max(F.abs("x")).over(W.partitionBy(*KEY)).alias("peak"), F.lit("a").alias("kind"), F.lit(0).alias("level"), F.col("i").alias("k"), "x")
    for level in range(1, levels + 1):
        live = (F.col("kind") == "a") & (F.col("level") == level - 1) & (F.col("n") >= (2 * order - 1) << level)
        size, even = _size(level - 1), _even(level - 1)

        def at(place: Column) -> Column:
            odd = (place + half - 1) % 2 == 1
            tap = lambda f, t: F.when(odd, F.lit(f[2 * t + 1])).otherwise(F.lit(f[2 * t]))
            to = lambda t: F.pmod(place + half - 1 - 2 * t - F.when(odd, 1).otherwise(0), even) / 2
            return F.array(*[_part(kind, level, to(t), tap(f, t) * F.col("x")) for t in range(half) for kind, f in (("a", h), ("d", g))])  # noqa: B023

        again = F.when((F.col("k") == size - 1) & (size % 2 == 1), at(F.col("k") + 1)).otherwise(F.array().cast("array<struct<kind:string,level:int,k:int,x:double>>"))
        out = _sent(out, live, F.concat(at(F.col("k")), again))
    return out


def synthesise(parts: DataFrame, rows: DataFrame, levels: int, order: int = 6) -> DataFrame:
    """symbol, signal, date, x: the series that coefficients of up to so many levels stand for, at the dates of rows. The
    inverse of analyse."""
    h, g, half = taps(order), detail_taps(order), order
    for level in range(levels, 0, -1):
        even, size = _even(level - 1), _size(level - 1)
        tap = lambda m: F.when(F.col("kind") == "a", F.lit(h[m])).otherwise(F.lit(g[m]))
        to = lambda m: F.pmod(2 * F.col("k") - half + 1 + m, even)  # noqa: B023, E731
        inside = lambda k: F.when(k < size, k)  # noqa: B023, E731
        sent = F.array(*[_part("a", level - 1, inside(to(m)), tap(m) * F.col("x")) for m in range(2 * order)])
        parts = _sent(parts, F.col("level") == level, sent)
    return series(rows).select(*KEY, "date", F.col("i").alias("k")).join(parts.select(*KEY, "k", "x"), [*KEY, "k"], "left").select(*KEY, "date", F.coalesce("x", F.lit(0.0)).alias("x"))


def cut(parts: DataFrame, shares: dict[str, float], mode: str = "soft") -> DataFrame:
    """Each series once for each share, its name lengthened by the share's: details are moved towards 0 by that share of
    the peak (soft), or dropped where they are smaller (hard)."""
    each = parts.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("share")) for k, v in shares.items()])))
    bound, size = F.col("s.share") * F.col("peak"), F.abs("x")
    kept = F.signum("x") * F.greatest(size - bound, F.lit(0.0)) if mode == "soft" else F.when(size >= bound, F.col("x")).otherwise(0.0)
    x = F.when(F.col("kind") == "d", kept).otherwise(F.col("x"))
    return each.select("symbol", F.concat_ws("_", "signal", "s.name").alias("signal"), "n", "peak", "kind", "level", "k", x.alias("x"))


def _renamed(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows once for each name, which the series' names are lengthened by."""
    return rows.withColumn("s", F.explode(F.array(*map(F.lit, names)))).withColumn("signal", F.concat_ws("_", "signal", "s")).drop("s")


def denoise(rows: DataFrame, shares: dict[str, float] = SHARES, mode: str = "soft", order: int = 6) -> DataFrame:
    """symbol, signal_share, date, x: the series without details below a share of its peak. Looks ahead."""
    levels = deepest(rows, order)
    return synthesise(cut(analyse(rows, levels, order), shares, mode), _renamed(rows, list(shares)), levels, order)


def select_levels(rows: DataFrame, levels: int = 5, order: int = 6) -> DataFrame:
    """Each series rebuilt from its approximation and its k coarsest details (signal_keep{k}), and from one level alone
    (signal_only{level}). Looks ahead."""
    parts = analyse(rows, levels, order)
    last = F.max("level").over(W.partitionBy(*KEY))
    ways = [(f"keep{k}", (F.col("kind") == "a") | (F.col("level") > F.col("last") - k)) for k in range(1, levels + 1)]
    ways += [(f"only{k}", (F.col("kind") == "d") & (F.col("level") == k)) for k in range(1, levels + 1)]
    each = parts.withColumn("last", last).select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("kept")) for n, c in ways])).alias("w"))
    each = each.select("symbol", F.concat_ws("_", "signal", "w.name").alias("signal"), "n", "peak", "kind", "level", "k", F.when(F.col("w.kept"), F.col("x")).otherwise(0.0).alias("x"))
    return synthesise(each, _renamed(rows, [n for n, _ in ways]), levels, order)


def energies(parts: DataFrame) -> DataFrame:
    """symbol, signal, kind, level, coefficients, energy and its share of the series'."""
    out = parts.groupBy(*KEY, "kind", "level").agg(F.count("*").alias("coefficients"), F.sum(F.col("x") * F.col("x")).alias("energy"))
    return out.withColumn("share", F.try_divide("energy", F.sum("energy").over(W.partitionBy(*KEY))))


def repeated(parts: DataFrame, rows: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """symbol, signal, date and, by name, the coefficient of a kind and level that stands at each date when the level's
    are stretched over the series; 0 where the series has no such level."""
    places = series(rows).select(*KEY, "date", "i", "n")
    out = places
    for name, (kind, level) in wanted.items():
        one = parts.filter((F.col("kind") == kind) & (F.col("level") == level)).select(*KEY, F.col("k").alias(f"k_{name}"), F.col("x").alias(name))
        stretch = F.floor(F.col("n") / _size(level)) + 1
        out = out.withColumn(f"k_{name}", F.floor(F.col("i") / stretch).cast("int")).join(one, [*KEY, f"k_{name}"], "left")
    return out.select(*KEY, "date", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in wanted])


def close_and_returns(bars: DataFrame) -> DataFrame:
    """Two signals a symbol: the close, and its daily changes, the first of which is 0."""
    two = bars.withColumn("r", F.coalesce(change("close"), F.lit(0.0)))
    two = two.select("symbol", "date", F.explode(F.array(F.struct(F.lit("price").alias("signal"), F.col("close").alias("x")), F.struct(F.lit("returns").alias("signal"), F.col("r").alias("x")))).alias("s"))
    return two.select("symbol", "s.signal", "date", "s.x")


def wavelet_features(bars: DataFrame) -> DataFrame:
    """symbol, date and nine features: close and returns denoised at two shares, what denoising takes off the close and its
    share of it, the trend and two details of a bank of three levels. Looks ahead: banks are of whole series."""
    rows = close_and_returns(bars)
    clean = denoise(rows).groupBy("symbol", "date").pivot("signal", [f"{s}_{k}" for s in ("price", "returns") for k in SHARES]).agg(F.first("x"))
    price = rows.filter("signal = 'price'")
    bands = repeated(analyse(price, 3), price, {"wavelet_trend": ("a", 3), "wavelet_detail_1": ("d", 3), "wavelet_detail_2": ("d", 2)}).drop("signal")
    out = bars.select("symbol", "date", "close").join(clean, ["symbol", "date"]).join(bands, ["symbol", "date"])
    residual = F.col("close") - F.col("price_smooth")
    named = [F.col(f"{s}_{k}").alias(f"wavelet_{s}_{k}") for s in ("price", "returns") for k in SHARES]
    return out.select("symbol", "date", *named, residual.alias("price_wavelet_residual"), "wavelet_trend", "wavelet_detail_1", "wavelet_detail_2", (F.abs(residual) / (F.col("close") + 1e-8)).alias("wavelet_noise_ratio"))


def undecimated(rows: DataFrame, levels: int = 4, order: int = 4) -> DataFrame:
    """symbol, signal, date, detail_1.. and trend: the bank without halving, each level filtering the one above at steps of
    2 ** (level - 1) rows, looking back only. Null until all taps have a value."""
    over = W.partitionBy(*KEY).orderBy("date")
    out = rows.select(*KEY, "date", F.col("x").alias("v0"))
    for level in range(1, levels + 1):
        step, low = 1 << (level - 1), f"v{level - 1}"
        made = {}
        for name, f in ((f"v{level}", taps(order)), (f"detail_{level}", detail_taps(order))):
            terms = [F.lag(low, m * step).over(over) * (c / math.sqrt(2)) if m else F.col(low) * (c / math.sqrt(2)) for m, c in enumerate(f)]
            made[name] = sum(terms[1:], terms[0])
        out = out.withColumns(made)
    return out.select(*KEY, "date", *[f"detail_{k}" for k in range(1, levels + 1)], F.col(f"v{levels}").alias("trend"))


def _mirrored(n: int, i: np.ndarray) -> np.ndarray:
    """Places of a series of n values continued by reflection that repeats its ends."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def _halved(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Rows of x filtered by f and halved, continued by reflection."""
    o, j = np.arange((x.shape[-1] + len(f) - 1) // 2), np.arange(len(f))
    return x[..., _mirrored(x.shape[-1], 2 * o[:, None] + 1 - j[None, :])] @ f


def _doubled(c: np.ndarray, f: np.ndarray) -> np.ndarray:
    n = 2 * c.shape[-1] - len(f) + 2
    m = np.arange(n)[:, None] + len(f) - 2 - 2 * np.arange(c.shape[-1])[None, :]
    return c @ np.where((m >= 0) & (m < len(f)), f[np.clip(m, 0, len(f) - 1)], 0.0).T


@cache
def last_weights(window: int = 63, levels: int = 4, keep: int = 2, order: int = 6) -> tuple[float, ...]:
    """What each value of a window weighs in the last value of the window's filtered form, in which all details but the
    `keep` coarsest are dropped: the bank is linear, so its last value is one weighted sum."""
    h, g = np.array(taps(order)), np.array(detail_taps(order))
    x, details, used = np.eye(window), [], min(levels, depth(window, order))
    for _ in range(used):
        details.append(_halved(x, g[::-1]))
        x = _halved(x, h[::-1])
    for level in range(used - 1, -1, -1):
        d = details[level] if level >= used - keep else np.zeros_like(details[level])
        x = _doubled(x[..., : d.shape[-1]], h) + _doubled(d, g)
    return tuple(x[:, window - 1].tolist())


def causal(rows: DataFrame, window: int = 63, levels: int = 4, keep: int = 2, order: int = 6) -> DataFrame:
    """rows (symbol, signal, date, x) with `clean`: the last value of the standardised last `window` values, filtered; x itself
    until there are more rows than that, 0 where the window is constant. Looks back only, so later rows change nothing."""
    over = W.partitionBy(*KEY).orderBy("date")
    frame = over.rowsBetween(1 - window, 0)
    w = last_weights(window, levels, keep, order)
    held = rows.withColumns({"xs": F.collect_list("x").over(frame), "at": F.row_number().over(over), "mean": F.avg("x").over(frame), "sd": F.stddev_pop("x").over(frame)})
    told = F.aggregate(F.zip_with("xs", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    clean = F.when(F.col("at") <= window, F.col("x")).when(F.col("sd") < 1e-10, 0.0).otherwise((told - F.col("mean") * sum(w)) / F.col("sd"))
    return held.select(*KEY, "date", "x", clean.alias("clean"))


# The run-length model's prior and chance of a change, and what counts as a drop of the likeliest run.
KAPPA, ALPHA, BETA, HAZARD = 0.1, 2.0, 1.0, 0.04
LONG, SHORT = 3, 2


def _runs(hazard: float, expanding: bool):
    """Steps of the run-length model on values standardised by all so far (expanding) or as they are."""

    def start():
        model, seen, before = RunLength(hazard, KAPPA, ALPHA, BETA, first=False), [0, 0.0, 0.0], [0]

        def step(x: float) -> tuple:
            if expanding:
                seen[0], seen[1], seen[2] = seen[0] + 1, seen[1] + x, seen[2] + x * x
                mean = seen[1] / seen[0]
                sd = math.sqrt(max(seen[2] / seen[0] - mean * mean, 1e-10)) if seen[0] > 1 else 1.0
                x = (x - mean) / sd if sd > 1e-10 else 0.0
            run = model.update(x)[1]
            drop, before[0] = int(before[0] > LONG and run <= SHORT), run
            return run, drop

        return step

    return start


def signal(rows: DataFrame, window: int = 63, levels: int = 4, keep: int = 2, lookback: int = 20) -> DataFrame:
    """symbol, date, x, clean, run, drop, position: filtered returns, the likeliest run length of a change-point model over
    them, and the position that the mean of the last lookback + 1 of them takes, half of it where the run just broke off.
    position is what is known at the date's close; it earns the next row's return."""
    clean = causal(rows.withColumn("signal", F.lit("")), window, levels, keep).select("symbol", "date", "x", "clean")
    found = scan(clean, ["clean"], "run int, drop int", _runs(HAZARD, True), also=("x", "clean"))
    over = W.partitionBy("symbol").orderBy("date")
    recent = F.avg("clean").over(over.rowsBetween(-lookback, 0))
    position = F.when(F.row_number().over(over) <= lookback, 0.0).when(F.col("drop") == 1, 0.5).otherwise((recent > 0).cast("double"))
    return found.select("symbol", "date", "x", "clean", "run", "drop", position.alias("position"))


def signal_backtest(told: DataFrame, cost: float = 0.001) -> DataFrame:
    """By symbol: growth of the position of the day before, less costs of changes, beside holding; trades and drops."""
    over = W.partitionBy("symbol").orderBy("date")
    rows = told.withColumn("held", F.coalesce(F.lag("position").over(over), F.lit(0.0)))
    moved = F.abs(F.col("held") - F.coalesce(F.lag("held").over(over), F.lit(0.0)))
    rows = rows.withColumn("moved", moved).withColumn("net", F.col("held") * F.col("x") - F.col("moved") * cost)
    return rows.groupBy("symbol").agg(F.count("*").alias("days"), F.sum(F.log1p("net")).alias("strategy"), F.sum(F.log1p("x")).alias("hold"), F.count_if(F.col("moved") > 0.1).alias("trades"), F.sum("drop").alias("drops"), F.stddev_pop("net").alias("net_sd"))


def changes_by_signal(rows: DataFrame, years: DataFrame, hazard: float = 1 / 30, spacing: int = 5) -> DataFrame:
    """symbol, signal, changes, per_year, deviation: of each series, standardised as a whole, the drops of the likeliest run
    that are `spacing` rows or more from the last counted one. years: symbol, years. Series without deviation are left out."""
    by = W.partitionBy(*KEY)
    z = rows.withColumns({"sd": F.stddev_pop("x").over(by), "mean": F.avg("x").over(by)}).filter("sd > 1e-10").withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))

    def start():
        step, last = _runs(hazard, False)(), [0, -spacing]

        def spaced(x: float) -> tuple:
            drop = step(x)[1] and last[0] - last[1] >= spacing
            last[1] = last[0] if drop else last[1]
            last[0] += 1
            return (int(drop),)

        return spaced

    z = z.withColumn("series", F.to_json(F.struct(*KEY)))
    found = scan(z, ["z"], "counted int", start, key="series", also=(*KEY, "x"))
    out = found.groupBy(*KEY).agg(F.sum("counted").alias("changes"), F.stddev_pop("x").alias("deviation"))
    return out.join(years, "symbol").select(*KEY, "changes", (F.col("changes") / F.col("years")).alias("per_year"), "deviation")


def sweep(returns: DataFrame, orders: tuple[int, ...] = (4, 6), shares: tuple[float, ...] = (0.01, 0.02, 0.03, 0.05, 0.08)) -> DataFrame:
    """Wavelets and shares beside each other: symbol, signal, changes, per_year and noise_reduction, the raw returns among
    them. returns: symbol, date, x. Looks ahead, as a study does."""
    raw = returns.withColumn("signal", F.lit("raw")).select(*KEY, "date", "x")
    out = raw
    for order in orders:
        named = raw.withColumn("signal", F.lit(f"db{order}"))
        out = out.unionByName(denoise(named, {str(s): s for s in shares}, order=order))
    return _judged(returns, out)


def blends(returns: DataFrame, weights: tuple[float, ...] = (0.3, 0.5, 0.7), share: float = 0.05, order: int = 4) -> DataFrame:
    """The same of returns blended with their denoised form."""
    raw = returns.withColumn("signal", F.lit("raw")).select(*KEY, "date", "x")
    clean = denoise(raw, {"clean": share}, order=order).select("symbol", "date", F.col("x").alias("c"))
    mixed = raw.join(clean, ["symbol", "date"]).select("symbol", "date", "x", F.explode(F.array(*[F.struct(F.lit(f"blend_{w}").alias("signal"), (w * F.col("x") + (1 - w) * F.col("c")).alias("y")) for w in weights])).alias("s"))
    return _judged(returns, raw.unionByName(mixed.select("symbol", "s.signal", "date", F.col("s.y").alias("x"))))


def _judged(returns: DataFrame, signals: DataFrame) -> DataFrame:
    years = returns.groupBy("symbol").agg((F.count("*") / 252).alias("years"), F.stddev_pop("x").alias("raw"))
    found = changes_by_signal(signals, years.select("symbol", "years")).join(years.select("symbol", "raw"), "symbol")
    return found.select(*KEY, "changes", "per_year", (1 - F.col("deviation") / F.col("raw")).alias("noise_reduction"))
