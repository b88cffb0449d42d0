"""Near copies by word shingles: SimHash fingerprints, pivot distance tables and popcounts within bands of minima; exact Jaccard
similarity links what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm import simhash
from candela.llm.common import arrow_map, is_small, keep, lookup
from candela.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: Two texts of similarity s share no band with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, less above.
BANDS, ROWS = 32, 5
#: Members of each band that all others are compared with first.
HUBS = 2
#: Bands of at most so many members are compared in pairs by a join, larger ones in blocks of at most about so many members
#: and hashes.
FEW, BLOCK, BLOCK_HASHES = 16, 2_048, 2 << 20
#: Words of 64 bits of a fingerprint. Two sets of similarity 0.8 differ in more than RADIUS bits with probability 1e-9 at
#: most (4 of 5 shingles in common; below 1e-12 for 12 or more), unlike ones differ in 128 +- 8.
FP_WORDS, RADIUS = 4, 88
#: Members of a block to which all others' distances are tabled.
PIVOTS = 8
#: Rows whose bits are counted at a time, so that a byte holds the count.
_COUNTED = 255
_MIX = (np.random.default_rng(simhash.SEED + 1).integers(0, 1 << 64, FP_WORDS, np.uint64, endpoint=False) | np.uint64(1)).astype(np.uint64)
_SALT, _ODD = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
_ODD |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's different word shingles, in order; the words are those of simhash.fingerprint, and a text of
    fewer is one shingle. Wordless texts have none."""
    return np.unique(np.array(simhash.shingle_hashes(text, shingle), np.uint64))


def signature(hashes: np.ndarray) -> int:
    """The set's own 64-bit hash, signed; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes())).astype(np.int64)) if len(hashes) else 0


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of the set in FP_WORDS words: a bit is 1 if it is set in over half of the hashes, each stretched to so many bits."""
    ones = np.zeros(64 * FP_WORDS, np.int64)
    for i in range(0, len(hashes), 16 * _COUNTED):
        h = hashes[i : i + 16 * _COUNTED, None] * _MIX
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits((h ^ (h >> np.uint64(29))).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), _COUNTED):
            ones += bits[k : k + _COUNTED].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The distance table: bits in which each of fps differs from each of refs."""
    return np.bitwise_count(fps[:, None, :] ^ refs[None]).sum(axis=2, dtype=np.int16)


def _words_of(sk: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sk.to_pylist()), "<u8").reshape(len(sk), FP_WORDS)


def bands(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """(a key for each band of minima, the fingerprint); none for the empty set."""
    if not len(hashes):
        return [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[None, i : i + 4096] ^ _SALT) * _ODD).min(axis=1), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=i) for i, x in enumerate(rows)], np.uint64).view(np.int64).tolist(), fingerprint(hashes).tobytes()


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """sig, hashes of the wanted signatures (wanted: sig, one row each). Of equal texts one is kept before the shuffle."""

    def step(batch: pa.RecordBatch) -> dict:
        sets = [shingles(x, shingle) for x in batch.column(0).to_pylist()]
        return {"sig": [signature(x) for x in sets], "hashes": [x.view(np.int64) for x in sets]}

    told = arrow_map(docs.select(F.col(text_col).cast("string").alias("text")), step, "sig long, hashes array<long>", {"sig": pa.int64(), "hashes": pa.list_(pa.int64())})
    some = told.join(F.broadcast(wanted) if is_small(wanted) else wanted.hint("merge"), "sig")
    return keep(some.groupBy("sig").agg(F.first("hashes").alias("hashes")), "sets")


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs a, b with the column of table (sig, column) of either."""
    for side in ("a", "b"):
        n = pairs.groupBy(F.col(side).alias("sig")).agg(F.count("*").alias("n"))
        held = keep(table.join(n, "sig").select(F.col("sig").alias(f"s{side}"), "n", F.col(column).alias(f"h{side}")), "held")
        pairs = lookup(pairs, held, side, "n", [F.col("a"), F.col("b")], right_key=f"s{side}", wide=True)
    return pairs


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _similar(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs a, b whose sets have at least this Jaccard similarity; their fingerprints are compared first."""

    def agree(batch: pa.RecordBatch) -> dict:
        kept = pa.array(np.bitwise_count(_words_of(batch.column(2)) ^ _words_of(batch.column(3))).sum(axis=1) <= RADIUS)
        return {"a": batch.column(0).filter(kept), "b": batch.column(1).filter(kept)}

    def step(batch: pa.RecordBatch) -> dict:
        a, b = [], []
        for i, j, x, y in zip(*[batch.column(k) for k in range(4)]):
            if _alike(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), similarity):
                a.append(i.as_py())
                b.append(j.as_py())
        return {"a": a, "b": b}

    ids = {"a": pa.int64(), "b": pa.int64()}
    near = arrow_map(_beside(keep(pairs, "pairs"), sketches, "sk").select("a", "b", "ha", "hb"), agree, "a long, b long", ids)
    return keep(arrow_map(_beside(keep(near, "agreeing"), sets, "hashes").select("a", "b", "ha", "hb"), step, "a long, b long", ids), "similar")


def _compared(similarity: float):
    """Of two blocks of a band, the similar pairs of different components that share no earlier band.

    Two fingerprints whose distances to some pivot differ by more than RADIUS are no pair, by the triangle inequality; of
    the others the bits are counted, then the sets compared. Pivots are members, as distances to random ones hardly differ.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sides = []
        for t in (left.combine_chunks(), right.combine_chunks()):
            numbers = [t[c].to_numpy() for c in ("sig", "size", "root")]
            sides.append([*numbers, _words_of(t["sk"]), t["keys"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), t["hashes"].combine_chunks()])
        (s, z, r, k, own, h), (s2, z2, r2, k2, own2, h2) = sides
        band = key[0].as_py()
        refs = k2[:: -(-len(k2) // PIVOTS)]
        table, table2 = _distances(k, refs), _distances(k2, refs)
        out = []
        for i in range(0, len(s), 32):
            part = slice(i, i + 32)
            near = (r[part, None] != r2) & (np.minimum(z[part, None], z2) >= similarity * np.maximum(z[part, None], z2))
            for p in range(len(refs)):
                near &= np.abs(table[part, p, None] - table2[None, :, p]) <= RADIUS
            x, y = np.nonzero(near)
            x = x + i
            close = np.bitwise_count(k[x] ^ k2[y]).sum(axis=1) <= RADIUS
            x, y = x[close], y[close]
            shared = own[x] == own2[y]
            here = own[x, shared.argmax(axis=1)] == band
            for a, b in zip(x[here], y[here]):
                if _alike(h[a].values.to_numpy(), h2[b].values.to_numpy(), similarity):
                    out.append((min(s[a], s2[b]), max(s[a], s2[b])))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], schema=schema)

    return run


def _near(other: str, similarity: float):
    return (F.col("root") != F.col(f"{other}.root")) & (F.least("size", f"{other}.size") >= F.lit(similarity) * F.greatest("size", f"{other}.size"))


def _to_hubs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of each member of a band (key, sig, size, root) with HUBS of its members."""
    hub = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "sig").alias("o"), F.col("sig").alias("sig"), F.col("size").alias("size"), F.col("root").alias("root")))
    by = keep(members.groupBy("key").agg(F.count("*").alias("n"), F.array(*[hub(i) for i in range(HUBS)]).alias("hubs")), "hubs")
    met = lookup(members, by, "key", "n", [F.col("sig")]).withColumn("o", F.explode(F.array_distinct("hubs")))
    return met.filter(_near("o", similarity)).select(F.least("sig", "o.sig").alias("a"), F.greatest("sig", "o.sig").alias("b")).distinct()


def links(docs: DataFrame, distinct: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of distinct sets (fp, size, keys, sk): links a, b whose components are those of all pairs at least so similar that
    share a band.

    Every member of a band is compared with HUBS of its members first, which joins nearly all that belong together. Then
    pairs of a band in different components are: those of small bands by a join; of a large one, its members outside its
    largest component meet all, in blocks that carry the sets, so that what is shuffled doesn't grow with pairs.
    """
    entries = distinct.select(F.col("fp").alias("sig"), "size", F.explode("keys").alias("key"))
    many = keep(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    members = keep(lookup(entries, many.withColumn("again", F.lit(True)), "key", "n", [F.col("sig")]).filter("again").drop("again"), "members")
    sigs = members.groupBy("sig").agg(F.count("*").alias("n"))
    sketches = distinct.select(F.col("fp").alias("sig"), "sk", "keys")
    sets = _sets(docs, sigs.select("sig"), text_col, shingle)
    found = _similar(_to_hubs(members.withColumn("root", F.col("sig")), similarity), sets, sketches, similarity)

    told = components(found).select(F.col("node").alias("sig"), F.col("root").alias("r"))
    roots = keep(sigs.join(told, "sig"), "roots")
    apart = keep(lookup(members, roots, "sig", "n", [F.col("key")]).withColumn("root", F.coalesce("r", "sig")).drop("r"), "apart")
    by = apart.groupBy("key", "root").agg(F.count("*").alias("k"), F.sum("size").alias("size")).groupBy("key").agg(F.sum("k").alias("n"), F.sum("size").alias("hashes"), F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"))
    by = keep(by.filter("roots > 1"), "by")
    held = lambda some: lookup(apart, some.select("key", "n", "main", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("hashes") / BLOCK_HASHES)).alias("blocks")), "key", "n", [F.col("sig")]).filter("main is not null")
    few = held(by.filter(F.col("n") <= FEW)).select("key", "sig", "size", "root")
    other = few.select("key", F.struct("sig", "size", "root").alias("o"))
    pairs = few.join(other.hint("merge"), "key").filter((F.col("sig") < F.col("o.sig")) & _near("o", similarity)).select(F.col("sig").alias("a"), F.col("o.sig").alias("b")).distinct()
    found = found.unionAll(_similar(pairs, sets, sketches, similarity))

    large = keep(held(by.filter(F.col("n") > FEW)), "large")
    each = large.groupBy("sig").agg(F.count("*").alias("n"))
    whole = keep(sets.join(each, "sig").join(sketches, "sig").select("sig", "n", "hashes", "sk", "keys"), "whole")
    full = lookup(large, whole, "sig", "n", [F.col("key")], wide=True)
    own, all_ = F.pmod(F.xxhash64("sig"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["sig", "size", "root", "sk", "keys", "hashes"]
    minor = full.filter("root != main").select("key", own.alias("i"), all_.alias("j"), *columns).toDF("key", "i", "j", *columns)  # columns of its own
    meet = full.select("key", all_.alias("i"), own.alias("j"), *columns)
    compare = _compared(similarity)
    met = minor.groupBy("key", "i", "j").cogroup(meet.groupBy("key", "i", "j")).applyInArrow(lambda key, a, b: compare(key, a, b), "a long, b long")
    return keep(found.unionAll(met), "links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with all their columns, but for all rows of each component save the one of least id.

    Texts are linked if the Jaccard similarity of their word shingles is at least similarity; texts of equal shingles are
    one, and so are all without words. Ties as in simhash.one_of_each.
    """

    def step(batch: pa.RecordBatch) -> dict:
        sets = [shingles(x, shingle) for x in batch.column(1).to_pylist()]
        told = [bands(x) for x in sets]
        return {"id": batch.column(0), "fp": [signature(x) for x in sets], "size": [len(x) for x in sets], "keys": [k for k, _ in told], "sk": [b for _, b in told]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = arrow_map(rows, step, "id long, fp long, size long, keys array<long>, sk binary", {"id": pa.int64(), "fp": pa.int64(), "size": pa.int64(), "keys": pa.list_(pa.int64()), "sk": pa.binary()})
    rows = keep(rows, "sketches")
    distinct = keep(rows.groupBy("fp").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sk").alias("sk")), "sets")
    found = simhash.classes(rows.select("id", "fp"), lambda _: links(docs, distinct, text_col, shingle, similarity))
    return simhash.keep_least(docs, rows.select("id", "fp"), found, lambda x: signature(shingles(x, shingle)), id_col, text_col)
