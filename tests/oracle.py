"""Compares a query with its oracle, as sets of rows with columns by name."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    """A value that compares and prints alike, whichever engine it comes from."""
    if x is None or x is pd.NaT:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return x


def rows(table) -> list[str]:
    columns = {c: [plain(v) for v in table.column(c).to_pylist()] for c in sorted(table.column_names)}
    return sorted(repr(r) for r in zip(*columns.values()))


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or nothing."""
    ours, theirs = df.toArrow(), con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(set(ours.column_names) ^ set(theirs.column_names))}"
    kinds = [f"{c}: {ours.schema.field(c).type} {theirs.schema.field(c).type}" for c in sorted(ours.column_names) if str(ours.schema.field(c).type).split("[")[0].replace("large_", "") != str(theirs.schema.field(c).type).split("[")[0].replace("large_", "")]
    a, b = rows(ours), rows(theirs)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"{len(a)} and {len(b)} rows, {len(only_a)} differ: {sorted(ours.column_names)}\n  {only_a[:2]}\n  {only_b[:2]}"
    return "types " + ", ".join(kinds) if kinds else ""
