"""Merkle manifest of a dataset: blocks of the trees are hashed by DuckDB inside tasks, Spark numbers the leaves, joins the
blocks' roots and proofs."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import is_small, keep, small_batches

#: Nodes that make up a parent.
FAN = 16
#: Levels of a bucket, which holds FAN ** LEVELS nodes at most, aligned in its tree.
LEVELS = 2
BUCKET = FAN**LEVELS
#: Rows that DuckDB takes at a time, to the next end of a bucket.
BLOCK = 8_192


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _numbered(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """rows (g, ...) with i, their place in g by order from 0, and n, the rows of g: places inside sorted partitions plus the
    sums of the partitions before. order must tell all rows apart. Groups of any size are cut into several partitions."""
    by = ["g", *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    placed = keep(dealt.sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("m", 33)
    starts = placed.groupBy("g", part.alias("p")).agg(F.min("m").alias("least"), F.count("*").alias("k"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("k").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keep(starts.select("g", "p", (before - F.col("least")).alias("shift"), F.sum("k").over(group).alias("n")), "starts")
    some = F.broadcast(starts) if is_small(starts, F.col("g")) else starts
    return placed.withColumn("p", part).join(some, ["g", "p"]).withColumn("i", F.col("m") + F.col("shift")).drop("p", "m", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a bucket (g, b) ends, of BLOCK rows or more where there are as many."""
    held: list[pa.Table] = []
    rows = 0

    def same(t: pa.Table, x: int, y: int) -> bool:
        return t["b"][x].as_py() == t["b"][y].as_py() and t["g"][x].as_py() == t["g"][y].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < BLOCK:
            continue
        table = pa.concat_tables(held)
        cut = table.num_rows - 1  # the last bucket may go on
        while cut > 0 and same(table, cut - 1, table.num_rows - 1):
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        rows = table.num_rows - cut
    if rows:
        yield pa.concat_tables(held)


class Engine:
    """DuckDB, with whole buckets of nodes at a time: g, b, i, n, h, n being the nodes of the tree's level."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})

    def load(self, nodes: pa.Table) -> None:
        """Tables run1..: each run of FAN consecutive nodes, its digests in order as one text, `whole`, and their digest. A
        bucket has as many levels as its tree has above these nodes, LEVELS at most; beyond them a node stays what it is."""
        depth = "".join(f"WHEN n <= {FAN**k} THEN {k} " for k in range(LEVELS))
        self.con.register("nodes", nodes)
        self.con.execute(f"CREATE OR REPLACE TABLE run0 AS SELECT g, b, n, (i % {BUCKET})::INTEGER AS p, h, CASE {depth} ELSE {LEVELS} END AS depth FROM nodes")
        self.con.unregister("nodes")
        for k in range(1, LEVELS + 1):
            level = f"SELECT g, b, n, depth, p // {FAN} AS p, min(h) AS one, CASE WHEN max(depth) >= {k} THEN string_agg(h, '' ORDER BY p) END AS whole FROM run{k - 1} GROUP BY g, b, n, depth, p // {FAN}"
            self.con.execute(f"CREATE OR REPLACE TABLE run{k} AS SELECT * EXCLUDE one, coalesce(sha256(whole), one) AS h FROM ({level})")

    def roots(self) -> pa.Table:
        return self.con.sql(f"SELECT g, b, n, h FROM run{LEVELS}").to_arrow_table()

    def _paths(self, nodes: pa.Table, outer: pa.Table) -> None:
        """paths: nodes with left1.., right1..: the digests beside the node's own ancestor at each level (null where there is
        no such level), and the bucket's lefts, rights and top."""
        self.con.register("nodes", nodes)
        self.con.register("outer_paths", outer)
        sides, joins = "", ""
        for k in range(1, LEVELS + 1):
            own = f"(i % {BUCKET} // {FAN ** (k - 1)} % {FAN})"
            sides += f", left(r{k}.whole, 64 * {own}) AS left{k}, substr(r{k}.whole, 64 * {own} + 65) AS right{k}"
            joins += f" JOIN run{k} r{k} ON r{k}.g = nodes.g AND r{k}.b = nodes.b AND r{k}.p = i % {BUCKET} // {FAN**k}"
        self.con.execute(f"CREATE OR REPLACE TABLE paths AS SELECT nodes.*{sides}, lefts, rights, top FROM nodes{joins} JOIN outer_paths o ON o.g = nodes.g AND o.b = nodes.b")
        self.con.unregister("nodes")
        self.con.unregister("outer_paths")

    def lists(self, nodes: pa.Table, outer: pa.Table) -> pa.Table:
        """Per node (g, i) its path as two lists, from below to above, and top."""
        self._paths(nodes, outer)
        own = [", ".join(f"{side}{k}" for k in range(1, LEVELS + 1)) for side in ("left", "right")]
        return self.con.sql(f"SELECT g, i, list_filter([{own[0]}], lambda x: x IS NOT NULL) || lefts AS lefts, list_filter([{own[1]}], lambda x: x IS NOT NULL) || rights AS rights, top FROM paths").to_arrow_table()

    def folded(self, nodes: pa.Table, outer: pa.Table) -> pa.Table:
        """Per leaf (id, h, own) its bucket's top, the digest of its proof, and what its digest `own` leads to along it."""
        self._paths(nodes, outer)
        above = self.con.sql("SELECT coalesce(max(len(lefts)), 0) FROM paths").fetchall()[0][0]
        steps = [(f"left{k}", f"right{k}") for k in range(1, LEVELS + 1)] + [(f"lefts[{k}]", f"rights[{k}]") for k in range(1, above + 1)]
        proof = " || ".join(f"coalesce({a}, '') || coalesce({b}, '')" for a, b in steps)
        rows = f"SELECT *, own AS up, sha256({proof}) AS proof FROM paths"
        for a, b in steps:
            rows = f"SELECT * REPLACE (coalesce(sha256({a} || up || {b}), up) AS up) FROM ({rows})"
        return self.con.sql(f"SELECT id, h, top, proof, up FROM ({rows})").to_arrow_table()


PATH, ROOT, FOLD = "g string, i long, lefts array<string>, rights array<string>, top string", "g string, b long, n long, h string", "id long, h string, top string, proof string, up string"
_LIST = pa.list_(pa.string())
ARROW = {"lefts": _LIST, "rights": _LIST} | dict.fromkeys(["i", "b", "n", "id"], pa.int64())


def _pieces(table: pa.Table) -> list[pa.RecordBatch]:
    types = [ARROW.get(n, pa.string()) for n in table.column_names]
    return table.cast(pa.schema(list(zip(table.column_names, types)))).combine_chunks().to_batches(max_chunksize=BLOCK)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    engine = None
    for block in _blocks(batches):
        engine = engine or Engine()
        engine.load(block)
        yield from _pieces(engine.roots())


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    engine = None
    for block in _blocks(batches):
        engine = engine or Engine()
        nodes = block.filter(pc.is_valid(block["i"]))
        outer = block.filter(pc.is_null(block["i"])).select(["g", "b", "lefts", "rights", "top"])
        engine.load(nodes.select(["g", "b", "i", "n", "h"]))
        leaves = "own" in nodes.column_names
        yield from _pieces(engine.folded(nodes.select(["g", "b", "i", "h", "id", "own"]), outer) if leaves else engine.lists(nodes.select(["g", "b", "i"]), outer))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Whole buckets in order in the partitions, many of them in each."""
    small_batches(rows.sparkSession)
    return rows.repartition("g", "b").sortWithinPartitions("g", "b", "i")


def _climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, tops): the kept nodes (g, b, i, n, h) of every LEVELS-th level, the leaves first, and each tree's root
    (g, h)."""
    rounds, tops, nodes = [leaves], None, leaves
    while True:
        roots = _bucketed(nodes.select("g", "b", "i", "n", "h")).mapInArrow(_roots, ROOT)
        roots = keep(roots.select("g", F.floor(F.col("b") / BUCKET).alias("b"), F.col("b").alias("i"), F.ceil(F.col("n") / BUCKET).alias("n"), "h"), "roots")
        done = roots.filter("n = 1").select("g", "h")
        tops = done if tops is None else tops.unionByName(done)
        rounds.append(roots)
        nodes = roots.filter("n > 1")
        if nodes.isEmpty():
            return rounds, tops


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths (PATH) of the nodes of the first round, or where they have `own` what that folds to (FOLD). above has what is
    above each tree: g, lefts, rights, top."""
    paths = None
    for k in range(len(rounds) - 2, -1, -1):
        outer = rounds[k + 1].filter("n = 1").select("g", F.col("i").alias("b")).join(above, "g")
        outer = outer if paths is None else outer.unionByName(paths.withColumnRenamed("i", "b"))
        nodes = rounds[k].filter("n > 1") if k else rounds[k]
        rows = _bucketed(nodes.unionByName(outer, allowMissingColumns=True))
        if "own" in nodes.columns:
            return rows.mapInArrow(_ways, FOLD)
        paths = keep(rows.mapInArrow(_ways, PATH), "paths")
    return paths


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def manifest(docs: DataFrame, columns: list[str], later: dict[str, Column] | None = None, where: Column | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """Per row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf is the digest of the row's columns, in order, each with its length. A group's leaves, by ascending id, make
    a tree whose root is subroot; these, by ascending group, the tree of root. later gives columns as they are found
    when the manifest is checked, in rows where `where` holds: folded_root follows from them along the stored proof, and
    verified tells whether it is root.

    A null group is a tree of its own, the first; null ids come first in theirs, and rows that share an id follow in order
    of their leaves, then as they come. Null and empty values differ, texts count whole. A single row is leaf, subroot and
    root at once, with an empty proof. Repeated rows are leaves each. Empty docs give no rows. Other columns are ignored.

    Leaves are numbered by a sort over all partitions, so one group may hold any share of them. A task hashes buckets of
    FAN ** LEVELS leaves; their roots are the nodes of the next round, and a bucket's path to the root comes back as one
    row. The number of rounds grows with the logarithm of the leaves.
    """
    col = {c: docs[f"`{c}`"] for c in columns}
    own = F.when(F.lit(False) if where is None else where, leaf(*(col | (later or {})).values()))
    group = docs[f"`{group_col}`"].cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), docs[f"`{id_col}`"].cast("long").alias("id"), leaf(*col.values()).alias("h"), own.alias("own"), F.monotonically_increasing_id().alias("u"))
    rows = _numbered(keep(rows, "leaves"), ["id", "h", "u"])
    rows = keep(rows.select("g", F.floor(F.col("i") / BUCKET).alias("b"), "i", "n", "h", "id", F.coalesce("own", "h").alias("own")), "numbered")
    rounds, subroots = _climb(rows)
    trees = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), ["of"])
    trees = keep(trees.withColumn("b", F.floor(F.col("i") / BUCKET)), "trees")
    higher, tops = _climb(trees.select("g", "b", "i", "n", "h"))
    top = tops.first()
    none = F.array().cast("array<string>")
    ways = _descend(higher, tops.select("g", none.alias("lefts"), none.alias("rights"), F.col("h").alias("top")))
    above = keep(ways.drop("top").join(trees.select("i", "of", "h"), "i").select(F.col("of").alias("g"), "lefts", "rights", F.col("h").alias("top")), "above")
    root = F.lit(top["h"] if top else None).cast("string")
    out = _descend(rounds, above)
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("up").alias("folded_root"), (F.col("up") == root).alias("verified"))
