"""Pieces of the oracle queries: the sources as common table expressions, and frames."""

from __future__ import annotations

PRICE = "l_extendedprice / l_quantity"
KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def ohlc(keys: str, source: str, by: str) -> str:
    return f"""SELECT {keys}, arg_min({PRICE}, {KEY}) AS open, max({PRICE}) AS high, min({PRICE}) AS low, arg_max({PRICE}, {KEY}) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap, count(*) AS transactions FROM {source} WHERE l_quantity > 0 GROUP BY {by}"""


SOURCES = {
    "bars": ohlc("l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date", "lineitem", "1, 2"),
    "brands": ohlc("p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date", "lineitem JOIN part ON p_partkey = l_partkey", "1, 2"),
    "market": "SELECT 'market' AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY 2",
    "vix": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS vix FROM orders GROUP BY 1",
    "panel": "SELECT o_orderpriority AS name, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS close FROM orders GROUP BY 1, 2",
}


def query(select: str, *sources: str, steps: dict[str, str] | None = None, recursive: bool = False) -> str:
    """WITH the named sources and the steps, in order, then select."""
    parts = [f"{n} AS ({SOURCES[n]})" for n in sources] + [f"{n} AS ({q})" for n, q in (steps or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}" if parts else select


def frame(k: int, by: str = "symbol", order: str = "date") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORDER = "OVER (PARTITION BY symbol ORDER BY date)"


def roll(call: str, x: str, k: int, least: int | None = None, both: str | None = None) -> str:
    """call over the last k rows where enough of them have x (and both)."""
    n = f"count(CASE WHEN {both} IS NOT NULL THEN {x} END)" if both else f"count({x})"
    return f"(CASE WHEN {n} {frame(k)} >= {k if least is None else least} THEN {call} {frame(k)} END)"


def mean(x: str, k: int, least: int | None = None) -> str:
    return f"(CASE WHEN min({x}) {frame(k)} = max({x}) {frame(k)} THEN {roll(f'max({x})', x, k, least)} ELSE {roll(f'avg({x})', x, k, least)} END)"


def std(x: str, k: int, least: int | None = None) -> str:
    value = roll(f"stddev_samp({x})", x, k, least)
    return f"(CASE WHEN min({x}) {frame(k)} = max({x}) {frame(k)} AND {value} IS NOT NULL THEN 0.0 ELSE {value} END)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {ORDER}" if k >= 0 else f"lead({x}, {-k}) {ORDER}"


def change(x: str, k: int = 1) -> str:
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS INTEGER)"


def corr(x: str, y: str, k: int, least: int | None = None) -> str:
    """Rolling correlation of x and y, which are columns null in the same rows or not; null where one is constant."""
    f = frame(k)
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"(CASE WHEN count({a}) {f} >= {k if least is None else least} AND max({a}) {f} > min({a}) {f} AND max({b}) {f} > min({b}) {f} THEN corr({a}, {b}) {f} END)"


#: Added before a result is rounded, so that decimal ties, which engines break by their last bit, lie off the edge.
NUDGE = 3.3e-10


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x}) + {NUDGE}, {digits}) AS {name}"
