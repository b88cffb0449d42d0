"""A data source of provider answers: JSON documents below `path`/symbol=S/year=Y, as landed by whatever fetched them.

spark.read.format("provider_bars").option("path", ...).option("start", "1995-01-01").option("second", ...).load()

A document is {"status": ..., "results": [{t, o, h, l, c, v, vw, n}, ...]}, t in milliseconds; others than OK and DELAYED
fail the read. Each symbol and year is a partition; filters on symbol and date leave partitions out before any is read.
Where a symbol's first bar comes more than LACKS days after `start`, and the second source's comes earlier, the symbol is
read from there.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, vwap double, transactions long, provider string"
STATUSES = ("OK", "DELAYED")
#: Days that may lack at the start before the second source is asked, and before a series counts as incomplete.
LACKS, SLACK = 60, 30
NAMES = ["symbol", "date", "open", "high", "low", "close", "volume", "vwap", "transactions", "provider"]
TYPES = [pa.string(), pa.date32(), *[pa.float64()] * 6, pa.int64(), pa.string()]


@dataclass
class Part(InputPartition):
    symbol: str
    year: int
    heads: dict  # source -> the symbol's first year there


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def years(path: str) -> dict[str, list[int]]:
    """Years by symbol, from the names of folders."""
    from pyarrow import fs

    system, top = _folder(path)
    out: dict[str, list[int]] = {}
    for f in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
        parts = dict(p.split("=", 1) for p in f.path.split("/") if "=" in p)
        if f.type == fs.FileType.Directory and {"symbol", "year"} <= parts.keys():
            out.setdefault(parts["symbol"], []).append(int(parts["year"]))
    return {s: sorted(y) for s, y in out.items()}


def read_year(path: str, symbol: str, year: int) -> list[tuple]:
    """The bars of a symbol's year, in order of dates."""
    from pyarrow import fs

    system, top = _folder(path)
    out = []
    for f in system.get_file_info(fs.FileSelector(f"{top}/symbol={symbol}/year={year}", allow_not_found=True)):
        if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")):
            continue
        with system.open_input_stream(f.path) as held:
            for line in held.read().decode().splitlines():
                said = json.loads(line)
                if said.get("status") not in STATUSES:
                    raise ValueError(f"{symbol} {year}: the provider said {said.get('status')}")
                for b in said.get("results") or []:
                    day = dt.datetime.fromtimestamp(b["t"] / 1000, dt.UTC).date()
                    out.append((symbol, day, b["o"], b["h"], b["l"], b["c"], b["v"], b.get("vw"), b.get("n")))
    return sorted(out, key=lambda r: r[1])


class BarsReader(DataSourceReader):
    def __init__(self, options):
        self.sources = {name: options[name] for name in ("path", "second") if name in options}
        self.start = dt.date.fromisoformat(options["start"]) if "start" in options else None
        self.least, self.most, self.symbols = self.start, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of dates and symbols leave partitions out; Spark still applies all filters to the rows."""
        for f in filters:
            if f.attribute == ("date",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.least = max(filter(None, [self.least, f.value]))
            if f.attribute == ("date",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.most = min(filter(None, [self.most, f.value]))
            if f.attribute == ("symbol",) and isinstance(f, EqualTo):
                self.symbols = {f.value} & (self.symbols or {f.value})
            yield f

    def partitions(self) -> list[Part]:
        held = {name: years(path) for name, path in self.sources.items()}
        out = []
        for symbol in sorted({s for h in held.values() for s in h}):
            heads = {name: h[symbol][0] for name, h in held.items() if symbol in h}
            for year in sorted({y for h in held.values() for y in h.get(symbol, ())}):
                inside = (self.least is None or year >= self.least.year) and (self.most is None or year <= self.most.year)
                if inside and (self.symbols is None or symbol in self.symbols):
                    out.append(Part(symbol, year, heads))
        return out or [Part("", 0, {})]

    def _source(self, part: Part) -> str:
        """Which source a symbol is read from: told by both sources' first bars alone, so that all its years agree."""
        if len(part.heads) < 2 or self.start is None:
            return next(iter(part.heads))
        first = {name: next((r[1] for r in read_year(self.sources[name], part.symbol, year)), dt.date.max) for name, year in part.heads.items()}
        return "second" if (first["path"] - self.start).days > LACKS and first["second"] < first["path"] else "path"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.heads:
            return
        name = self._source(part)
        rows = [(*r, name) for r in read_year(self.sources[name], part.symbol, part.year) if self.start is None or r[1] >= self.start]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


class ProviderBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarsReader:
        return BarsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderBars)


def land(bars: DataFrame, folder: str, status: str = "OK") -> None:
    """bars as such documents, one for each symbol and year: a year of daily bars at most."""
    one = F.struct((F.unix_date("date").cast("long") * 86_400_000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), F.col("transactions").alias("n"))
    docs = bars.groupBy("symbol", F.year("date").alias("year")).agg(F.to_json(F.struct(F.lit(status).alias("status"), F.array_sort(F.collect_list(one)).alias("results"))).alias("value"))
    docs.write.partitionBy("symbol", "year").text(folder)


def completeness(bars: DataFrame, start: str) -> DataFrame:
    """symbol, first, last, bars, complete: whether a symbol's bars begin within SLACK days of the start asked for."""
    out = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("bars"))
    return out.withColumn("complete", F.datediff("first", F.lit(start).cast("date")) < SLACK)
