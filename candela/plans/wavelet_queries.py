"""Wavelet queries, and their oracles: the filter bank as joins with the taps."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.frames import change, rounded
from candela.operators import wavelets as w
from candela.plans.feature_queries import _of
from candela.plans.label_queries import TAMED, _tamed
from candela.plans.sql import change as delta
from candela.plans.sql import query, r
from candela.sources import bars as s

#: Levels that oracles go through; series that are too short for one pass it by.
DEEPEST = 8


def _returns(spark, sf_dir):
    return _tamed(spark, sf_dir).select("symbol", "date", F.coalesce(change("close"), F.lit(0.0)).alias("x"))


def _closes(spark, sf_dir):
    return s.bars(spark, sf_dir).select("symbol", F.lit("price").alias("signal"), "date", F.col("close").alias("x"))


def _of_returns(spark, sf_dir):
    return _returns(spark, sf_dir).withColumn("signal", F.lit("returns"))


def _hard(rows):
    return w.denoise(rows, w.SHARES, "hard").groupBy("symbol", "date").pivot("signal", [f"price_{k}" for k in w.SHARES]).agg(F.first("x"))


QUERIES = {
    "wavelet_features": _of(w.wavelet_features, s.bars),
    "wavelet_denoise": _of(_hard, _closes),
    "wavelet_energies": _of(lambda x: w.energies(w.analyse(x)).withColumn("energy", F.log10("energy")), _closes),
    "wavelet_levels": lambda sp, sf: rounded(w.select_levels(_of_returns(sp, sf)), 9),
    "wavelet_undecimated": _of(w.undecimated, _closes),
    "wavelet_causal": _of(lambda x: w.causal(x, keep=1), _of_returns),
    "wavelet_signal": _of(lambda x: w.signal(x, keep=1), _returns),
    "wavelet_backtest": _of(lambda x: w.signal_backtest(w.signal(x, keep=1)), _returns),
    "wavelet_sweep": _of(w.sweep, _returns),
    "wavelet_blends": _of(w.blends, _returns),
}


def _size(level: int) -> str:
    return f"CAST(ceil(n / {1 << level}.0) AS BIGINT)"


def _taps(order: int) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({m}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for m, (a, b) in enumerate(zip(w.taps(order), w.detail_taps(order)))) + ") t(m, h, g)"


def bank(source: str, levels: int, order: int = 6, name: str = "w") -> dict[str, str]:
    """Steps {name}0..{name}{levels} from source (symbol, signal, date, x): coefficients (symbol, signal, n, peak, kind, level, k, x)."""
    steps = {
        f"{name}t": _taps(order),
        f"{name}s": f"SELECT symbol, signal, date, x, row_number() OVER v - 1 AS i, count(*) OVER u AS n, max(abs(x)) OVER u AS peak FROM {source} WINDOW v AS (PARTITION BY symbol, signal ORDER BY date), u AS (PARTITION BY symbol, signal)",
        f"{name}0": f"SELECT symbol, signal, n, peak, 'a' AS kind, 0 AS level, i AS k, x FROM {name}s",
    }
    for level in range(1, levels + 1):
        before, live = f"{name}{level - 1}", f"kind = 'a' AND level = {level - 1} AND n >= {(2 * order - 1) << level}"
        size = _size(level - 1)
        steps[f"{name}e{level}"] = f"SELECT *, k AS p FROM {before} WHERE {live} UNION ALL SELECT *, k + 1 AS p FROM {before} WHERE {live} AND k = {size} - 1 AND {size} % 2 = 1"
        even = f"({size} + {size} % 2)"
        to = f"(((p + {order - 1} - m) % {even} + {even}) % {even}) // 2"
        sent = f"SELECT symbol, signal, n, peak, {to} AS k, sum(h * x) AS a, sum(g * x) AS d FROM {name}e{level} JOIN {name}t ON (p + {order - 1} - m) % 2 = 0 GROUP BY ALL"
        steps[f"{name}g{level}"] = sent
        steps[f"{name}{level}"] = f"SELECT * FROM {before} WHERE NOT ({live}) UNION ALL SELECT symbol, signal, n, peak, 'a', {level}, k, a FROM {name}g{level} UNION ALL SELECT symbol, signal, n, peak, 'd', {level}, k, d FROM {name}g{level}"
    return steps


def unbank(source: str, levels: int, order: int = 6, taps: str = "wt", name: str = "y") -> dict[str, str]:
    """Steps {name}{levels - 1}..{name}0 back from coefficients; {name}0 has the series by place k."""
    steps, before = {}, source
    for level in range(levels, 0, -1):
        size = _size(level - 1)
        even = f"({size} + {size} % 2)"
        to = f"((2 * k - {order} + 1 + m) % {even} + {even}) % {even}"
        sent = f"SELECT symbol, signal, n, peak, {to} AS k, sum(CASE WHEN kind = 'a' THEN h ELSE g END * x) AS x FROM {before} JOIN {taps} ON level = {level} GROUP BY ALL"
        steps[f"{name}{level - 1}"] = f"SELECT * FROM {before} WHERE level <> {level} UNION ALL SELECT symbol, signal, n, peak, 'a', {level - 1}, k, x FROM ({sent}) WHERE k < {size}"
        before = f"{name}{level - 1}"
    return steps


CLOSES = "SELECT symbol, 'price' AS signal, date, close AS x FROM bars"
RETURNS = f"SELECT symbol, 'returns' AS signal, date, coalesce({delta('close')}, 0) AS x FROM (SELECT symbol, date, close ** {TAMED} AS close FROM bars)"
BOTH = f"{CLOSES} UNION ALL SELECT symbol, 'returns', date, coalesce({delta('close')}, 0) FROM bars"


def _cut(source: str, mode: str) -> str:
    kept = "sign(x) * greatest(abs(x) - share * peak, 0)" if mode == "soft" else "CASE WHEN abs(x) >= share * peak THEN x ELSE 0 END"
    return f"SELECT symbol, signal || '_' || name AS signal, n, peak, kind, level, k, CASE WHEN kind = 'd' THEN {kept} ELSE x END AS x FROM {source}, (VALUES " + ", ".join(f"('{k}', {v})" for k, v in w.SHARES.items()) + ") c(name, share)"


def _wide(names: list[str], source: str, rows: str, alias: str = "{}") -> str:
    cols = ", ".join(f"max(y.x) FILTER (y.signal = '{n}') AS {alias.format(n)}" for n in names)
    return f"SELECT s.symbol, s.date, {cols} FROM {rows} s JOIN {source} y ON y.symbol = s.symbol AND y.k = s.i AND starts_with(y.signal, s.signal) GROUP BY 1, 2"


def _stretched(kind: str, level: int) -> str:
    return f"LEFT JOIN b3 {kind}{level} ON {kind}{level}.symbol = s.symbol AND {kind}{level}.kind = '{kind}' AND {kind}{level}.level = {level} AND {kind}{level}.k = s.i // (s.n // {_size(level).replace('n /', 's.n /')} + 1)"


def _ways(levels: int) -> str:
    """Coefficients once for each choice of levels."""
    ways = [(f"keep{k}", f"kind = 'a' OR level > last - {k}") for k in range(1, levels + 1)] + [(f"only{k}", f"kind = 'd' AND level = {k}") for k in range(1, levels + 1)]
    one = "SELECT symbol, signal || '_{0}' AS signal, n, peak, kind, level, k, CASE WHEN {1} THEN x ELSE 0 END AS x FROM (SELECT *, max(level) OVER (PARTITION BY symbol, signal) AS last FROM w{2})"
    return " UNION ALL ".join(one.format(n, c, levels) for n, c in ways)


def _lags(levels: int, order: int) -> dict[str, str]:
    steps, cols = {"l0": f"SELECT symbol, signal, date, x AS v0 FROM ({CLOSES})"}, ""
    for level in range(1, levels + 1):
        terms = lambda f: " + ".join(f"lag(v{level - 1}, {m << (level - 1)}) OVER o * CAST({c / 2**0.5!r} AS DOUBLE)" for m, c in enumerate(f))  # noqa: B023, E731
        cols += f", detail_{level}"
        steps[f"l{level}"] = f"SELECT *, {terms(w.taps(order))} AS v{level}, {terms(w.detail_taps(order))} AS detail_{level} FROM l{level - 1} WINDOW o AS (PARTITION BY symbol, signal ORDER BY date)"
    return steps


ORACLE = {
    "wavelet_energies": query(
        f"SELECT symbol, signal, kind, level, coefficients, {r('log10(energy)', 'energy')}, {r('energy / sum(energy) OVER (PARTITION BY symbol, signal)', 'share')} FROM (SELECT symbol, signal, kind, CAST(level AS INTEGER) AS level, count(*) AS coefficients, sum(x * x) AS energy FROM w{DEEPEST} GROUP BY ALL)",
        "bars", steps={"src": CLOSES, **bank("src", DEEPEST)},
    ),
    "wavelet_denoise": query(
        f"SELECT symbol, date, {r('price_smooth', 'price_smooth')}, {r('price_aggressive', 'price_aggressive')} FROM ({_wide(['price_smooth', 'price_aggressive'], 'y0', 'ws')})",
        "bars", steps={"src": CLOSES, **bank("src", DEEPEST), "c": _cut(f"w{DEEPEST}", "hard"), **unbank("c", DEEPEST)},
    ),
    "wavelet_features": query(
        "SELECT symbol, date, " + ", ".join(r(c, n) for n, c in {
            "wavelet_price_smooth": "price_smooth", "wavelet_price_aggressive": "price_aggressive", "wavelet_returns_smooth": "returns_smooth", "wavelet_returns_aggressive": "returns_aggressive", "price_wavelet_residual": "close - price_smooth",
            "wavelet_trend": "t", "wavelet_detail_1": "d3", "wavelet_detail_2": "d2", "wavelet_noise_ratio": "abs(close - price_smooth) / (close + 1e-8)"}.items()) + " FROM wide JOIN bands USING (symbol, date) JOIN bars USING (symbol, date)",
        "bars",
        steps={
            "src": BOTH, **bank("src", DEEPEST), "c": _cut(f"w{DEEPEST}", "soft"), **unbank("c", DEEPEST), "wide": _wide([f"{a}_{k}" for a in ("price", "returns") for k in w.SHARES], "y0", "ws"),
            "prices": CLOSES, **bank("prices", 3, name="b"),
            "bands": f"SELECT s.symbol, s.date, coalesce(a3.x, 0) AS t, coalesce(d3.x, 0) AS d3, coalesce(d2.x, 0) AS d2 FROM bs s {_stretched('a', 3)} {_stretched('d', 3)} {_stretched('d', 2)}",
        },
    ),
    "wavelet_levels": query(f"SELECT y.symbol, y.signal, s.date, {r('y.x', 'x', 9)} FROM ws s JOIN y0 y ON y.symbol = s.symbol AND y.k = s.i", "bars", steps={"src": RETURNS, **bank("src", 5), "c": _ways(5), **unbank("c", 5)}),
    "wavelet_causal": query(
        f"SELECT symbol, signal, date, {r('x', 'x')}, {r(f'CASE WHEN i < 63 THEN x WHEN sd < 1e-10 THEN 0 ELSE (list_sum(list_transform(list_zip(xs, ' + str(list(w.last_weights(keep=1))) + f'), lambda p: p[1] * p[2])) - m * {sum(w.last_weights(keep=1))!r}) / sd END', 'clean')} FROM (SELECT symbol, signal, date, x, i, avg(x) OVER f AS m, stddev_pop(x) OVER f AS sd, CASE WHEN i >= 63 THEN list(x) OVER f END AS xs FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM src) WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))",
        "bars", steps={"src": RETURNS},
    ),
    "wavelet_undecimated": query("SELECT symbol, signal, date, " + ", ".join(r(f"detail_{k}", f"detail_{k}") for k in range(1, 5)) + f", {r('v4', 'trend')} FROM l4", "bars", steps=_lags(4, 4)),
}
