"""Window building blocks over (symbol, date) series. A missing value is NULL, never NaN; division by zero gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def order():
    return Window.partitionBy("symbol").orderBy("date")


def so_far():
    return order().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy("symbol")


def last(k: int):
    """The frame of the current row and the k - 1 before it."""
    return order().rowsBetween(-(k - 1), 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(order()) if k >= 0 else F.lead(col(x), -k).over(order())


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def change(x: str | Column, k: int = 1) -> Column:
    """Relative change against k rows ago."""
    return div(x, lag(x, k)) - 1


def roll(fn: Callable[..., Column], x: str | Column, k: int, least: int | None = None, *more: str | Column) -> Column:
    """fn over the last k rows, NULL where fewer than `least` (k by default) of them have a value."""
    over = last(k)
    present = col(x) if not more else F.when(col(x).isNotNull() & col(more[0]).isNotNull(), F.lit(1))
    return F.when(F.count(present).over(over) >= (k if least is None else least), fn(col(x), *map(col, more)).over(over))


def mean(x: str | Column, k: int, least: int | None = None) -> Column:
    """Rolling mean; a frame of equal values has exactly that mean, however sums round."""
    low, high = F.min(col(x)).over(last(k)), F.max(col(x)).over(last(k))
    return F.when(low == high, roll(F.max, x, k, least)).otherwise(roll(F.avg, x, k, least))


def std(x: str | Column, k: int, least: int | None = None) -> Column:
    """Rolling sample deviation; a frame of equal values has none, however sums round."""
    low, high = F.min(col(x)).over(last(k)), F.max(col(x)).over(last(k))
    value = roll(F.stddev_samp, x, k, least)
    return F.when((low == high) & value.isNotNull(), F.lit(0.0)).otherwise(value)


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def corr(x: str, y: str, k: int, least: int | None = None) -> Column:
    """Rolling correlation, NULL where either side is constant. A constant frame is told by its extremes, as the sums of
    squares of one may differ from zero by rounding."""
    over, both = last(k), F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    moves = (F.max(a).over(over) > F.min(a).over(over)) & (F.max(b).over(over) > F.min(b).over(over))
    cov, va, vb = (F.covar_pop(a, b).over(over), F.var_pop(a).over(over), F.var_pop(b).over(over))
    return F.when((F.count(a).over(over) >= (k if least is None else least)) & moves, F.try_divide(cov, F.sqrt(va * vb)))


def island(changes: Column) -> Column:
    """The number of the run that a row belongs to, from a column that is true where a run starts."""
    return F.sum(changes.cast("int")).over(so_far())


def as_of(rows: DataFrame, *series: DataFrame, by: str = "date") -> DataFrame:
    """rows with the latest values of each series (by, values..., one row a date) at or before their own date.

    The dates of rows and series are put in one order, in which each takes the last values seen, and rows are joined with
    their dates. So the series never meet the rows' other keys, and what one task orders is a calendar, not a table.
    """
    days = rows.select(by).distinct().withColumn("__row", F.lit(1))
    marks = [F.struct(*[c for c in x.columns if c != by]) for x in series]
    line = days
    for i, (x, mark) in enumerate(zip(series, marks)):
        line = line.unionByName(x.select(by, F.lit(0).alias("__row"), mark.alias(f"__m{i}")), allowMissingColumns=True)
    over = Window.partitionBy(F.lit(0)).orderBy(by, "__row").rowsBetween(Window.unboundedPreceding, 0)
    told = line.select(by, "__row", *[F.last(f"__m{i}", ignorenulls=True).over(over).alias(f"__m{i}") for i in range(len(series))]).filter("__row = 1")
    told = told.select(by, *[F.col(f"__m{i}")[c].alias(c) for i, x in enumerate(series) for c in x.columns if c != by])
    return rows.join(told, by, "left").select(*rows.columns, *[c for c in told.columns if c != by])


#: Added before a result is rounded, so that decimal ties, which engines break by their last bit, lie off the edge.
NUDGE = 3.3e-10


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with its doubles rounded; what a comparison of results needs."""
    return df.select(*[F.round(F.col(c) + F.lit(NUDGE), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])
