"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import arrow_map, free_name, keep, lookup, release, slices, small_batches
from candela.llm.graph import components

SHINGLE = 3
BITS = 2
SEED = 42
#: Reference fingerprints of the distance tables.
PIVOTS = 24
#: Two fingerprints that differ in at most BITS bits agree on all but BITS of these blocks, so they meet under one of
#: the masks; what agrees under a mask leaves 22 bits at most, hence no more than 2**22 fingerprints in a group.
BLOCKS = 6
#: A group of more fingerprints is parted by further masks within its task.
SMALL = 512
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """A hash for each run of so many words; a text of fewer words is one run, and wordless texts have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z, splits at \\x20 and \\x09-\\x0d
    if not words:
        return []
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = [0, *(x + 1 for x in ends)]
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text, as an unsigned number; null and wordless texts give 0."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    h, ones = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """One mask for each choice of blocks on which close fingerprints may be required to agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def _pairs(fps: np.ndarray, refs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of fps within so many bits.

    The table holds every fingerprint's Hamming distance to every pivot. By the triangle inequality two fingerprints whose
    distances to some pivot differ by more than bits are no pair; those whose largest difference is small are verified.
    """
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(int)
    ends = np.searchsorted(first, first + bits, side="right")
    n = ends - np.arange(len(fps)) - 1
    a = np.repeat(np.arange(len(fps)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
    a, b = order[a], order[b]
    for k in range(1, table.shape[1]):
        near = np.abs(table[a, k] - table[b, k]) <= bits
        a, b = a[near], b[near]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
    return a[near], b[near]


def close_pairs(fps: np.ndarray, refs: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct fps within so many bits, each at least once.

    Small groups go to the distance tables. A large one is first parted again: of bits + 2 blocks of the bits in which its
    members differ at all, a pair agrees on two, so it meets in a group of those that agree there, which leaves half of
    the bits. So a group's cost follows its size and not the square of it, however many fingerprints share a mask.
    """
    if len(fps) < 2:
        return
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [k for k in range(64) if free >> k & 1]
    if len(fps) <= SMALL or len(places) < 2 * (bits + 2):
        for i in range(0, len(fps), SMALL):  # blocks against blocks; one of each for a small group
            for j in range(i, len(fps), SMALL):
                part = np.concatenate([fps[i : i + SMALL], fps[j : j + SMALL]]) if j > i else fps[i : i + SMALL]
                a, b = _pairs(part, refs, bits)
                yield part[a], part[b]
        return
    blocks = [sum(1 << k for k in places[i :: bits + 2]) for i in range(bits + 2)]
    for two in combinations(blocks, 2):
        key = fps & np.uint64(sum(two))
        order = np.argsort(key, kind="stable")
        cuts = np.nonzero(np.diff(key[order]))[0] + 1
        for group in np.split(fps[order], cuts):
            yield from close_pairs(group, refs, bits)


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for batch in batches:
            for row in batch.column(0):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for pair in close_pairs(np.unique(row.values.to_numpy(zero_copy_only=False).view(np.uint64)), refs, bits):
                    held.append(pair)
                    if sum(len(a) for a, _ in held[-1:]) > SMALL or len(held) >= 1000:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return run


def _batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in held] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame, column: str = "fp", bits: int = BITS) -> DataFrame:
    """Of distinct 64-bit fingerprints: links a, b whose components are those of all pairs within so many bits."""
    keyed = fps.select(F.col(column).alias("fp"), F.posexplode(F.array(*[F.col(column).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks(bits)])).alias("mask", "key"))
    groups = keyed.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select("fps").mapInArrow(_links(bits), "a long, b long").distinct()


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a signed long) for every row."""

    def step(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "fp": fps.view(np.int64)}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), step, "id long, fp long", {"id": pa.int64(), "fp": pa.int64()})


def classes(rows: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """rows (id, fp; a kept table), links of distinct fps -> fp, n (its rows), root (the least fingerprint of its component), component_id (the
    component's least id)."""
    distinct = keep(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(linked(distinct))
    joined = keep(roots.select(F.col("node").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct()).join(distinct, "fp"), "linked")
    found = keep(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "classes")
    named = lookup(joined.select("fp", "root", "n"), found, "root", "members", [F.col("fp")])
    alone = distinct.join(joined.select("fp"), "fp", "left_anti").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return keep(alone.unionByName(named.select("fp", "n", "root", "component_id")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row of docs: id, fingerprint (16 lower-case hex digits), component_id (the smallest id reachable over links of
    at most bits differing bits).

    Null and wordless texts have fingerprint zero, linked like any other. A row whose id is null keeps it and belongs to
    its fingerprint's component; the component's id is null only if all ids in it are. Repeated rows give repeated rows.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = keep(fingerprinted(docs, id_col, text_col, shingle), "fingerprints")
    out = lookup(rows, classes(rows, lambda x: links(x, bits=bits)).drop("root"), "fp", "n", [F.col("id"), F.col("fp")])
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs, with all their columns, but for all rows of each component save the one of least id.

    Of rows that share that id (repeated rows, or rows of a component without ids) the one with the least text stays.
    Fingerprints are taken twice, for the components and beside the rows, which costs less than a copy of all texts.
    """
    rows = keep(fingerprinted(docs, id_col, text_col, shingle), "fingerprints")
    found = classes(rows, lambda x: links(x, bits=bits))
    return keep_least(docs, rows, found, lambda x: int(np.uint64(fingerprint(x, shingle)).view(np.int64)), id_col, text_col)


def keep_least(docs: DataFrame, rows: DataFrame, found: DataFrame, mark: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """docs but for all rows of each of the found classes save the first; mark: a text's fp, as in rows (id, fp)."""
    least = F.col("id").eqNullSafe(F.col("component_id"))
    tied = lookup(rows, found, "fp", "n", [F.col("id"), F.col("fp")]).filter(least).groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    fp, place = free_name(docs, "__fp"), docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([mark(x) for x in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, fp])
        release()

    told = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = told.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(fp).alias("fp"), row.alias("row"))
    first = lookup(told, found, "fp", "n", [F.col("id"), F.col("fp")], wide=True).filter(least)
    if tied:  # a second shuffle, of those that stay, only where ids repeat
        by = Window.partitionBy("root").orderBy(F.col("row")[text_col], F.xxhash64("row"))
        first = first.withColumn("k", F.row_number().over(by)).filter("k = 1")
    return first.select("row.*")
