"""Byte-level BPE: ranked merges folded by higher-order functions, and decoding by concatenation."""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import arrow_map, keep, slices, small_batches

#: Parts the entries of a literal table; no piece holds it, as pieces are written with a character for each byte.
APART, NONE = "Ā", "ā"
#: Words folded once for the whole corpus by expressions, and broadcast: so many at most.
FREQUENT = 50_000
#: Words a worker remembers; beyond that it starts anew.
CACHE, CACHE_CHARS, LONG_WORD = 500_000, 16_000_000, 256
#: Bytes up to which words are folded by expressions, and beyond which a heap pays.
LONG = 200
NEVER = 1 << 60


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank, from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        told = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in told] != list(range(len(told))):
        raise ValueError("ranks have gaps")
    return [p for _, p in told]


def _places(x: str, size: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(x.encode(), 42)
    return h & (size - 1), (h >> 32) & (size - 1)


class Table:
    """A literal map from strings, in which each stands at one of two places that its hash names."""

    def __init__(self, entries: dict[str, str]):
        size = 1 << max(4, (2 * len(entries)).bit_length())
        while (table := self._fill(entries, size)) is None:
            size *= 2
        self.size = size
        self.keys = F.split(F.lit(APART.join(NONE if x is None else x for x in table)), APART)  # folded into a literal when the plan is made
        self.values = F.split(F.lit(APART.join("0" if x is None else entries[x] for x in table)), APART)

    @staticmethod
    def _fill(entries: dict[str, str], size: int) -> list[str | None] | None:
        table: list[str | None] = [None] * size
        for x in entries:
            at = _places(x, size)[0]
            for _ in range(500):
                x, table[at] = table[at], x
                if x is None:
                    break
                a, b = _places(x, size)
                at = b if at == a else a
            else:
                return None
        return table

    def get(self, x: Column, kind: str | None = None) -> Column:
        """The value of x, or null. Keys and values stand in the plan once."""
        values = self.values.cast(f"array<{kind}>") if kind else self.values
        mask = F.lit(self.size - 1).cast("long")
        places = F.array(F.xxhash64(x).bitwiseAND(mask).cast("int"), F.shiftrightunsigned(F.xxhash64(x), 32).bitwiseAND(mask).cast("int"))
        return F.get(values, F.get(F.filter(places, lambda p: F.get(self.keys, p) == x), F.lit(0)))


def _let(x: Column, f) -> Column:
    return F.transform(F.array(x), f)[0]


class Ranks:
    def __init__(self, pieces: list[bytes]):
        self.table = Table({p.decode("latin-1"): str(i) for i, p in enumerate(pieces)})

    def rank(self, x: Column) -> Column:
        return self.table.get(x, "int")

    def fold(self, word: Column) -> Column:
        """The pieces of a word (a character for each byte), by merging the pair of least rank until none has any."""
        start = F.filter(F.split(word, ""), lambda c: c != "")

        def step(parts: Column, _: Column) -> Column:
            n = F.size(parts)
            ranks = F.transform(F.slice(parts, 1, n - 1), lambda a, i: self.rank(F.concat(a, F.get(parts, i + 1))))

            def merge(r: Column) -> Column:
                i = F.array_position(r, F.array_min(r)).cast("int")
                return F.when(F.array_min(r).isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), i - 1), F.array(F.concat(F.get(parts, i - 1), F.get(parts, i))), F.slice(parts, i + 2, n)))

            return F.when(n < 2, parts).otherwise(_let(ranks, merge))

        return F.aggregate(F.slice(start, 2, F.size(start)), start, step)


def fold_words(words: DataFrame, ranks: Ranks, word_col: str = "word") -> DataFrame:
    """words with `ids` (array<int>): the folded pieces' ranks, in expressions alone. One row for each distinct word."""
    narrow = F.decode(F.encode(F.col(word_col), "UTF-8"), "ISO-8859-1")
    pieces = words.withColumn("__narrow", narrow).withColumn("__pieces", F.coalesce(F.when(ranks.rank(F.col("__narrow")).isNotNull(), F.array("__narrow")), ranks.fold(F.col("__narrow"))))
    return pieces.withColumn("ids", F.transform("__pieces", ranks.rank)).drop("__narrow", "__pieces")


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", words: int = FREQUENT) -> DataFrame:
    """The corpus's most frequent words of at most LONG bytes: all that occur so often that there are `words` of them at
    most. A histogram of the counts gives that limit, so nothing is sorted and no task meets all words."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(pattern), F.lit(0))).alias("word"))
    counts = keep(found.filter(F.octet_length("word") <= LONG).groupBy("word").agg(F.count("*").alias("n")), "counts")
    by_count = counts.groupBy("n").agg(F.count("*").alias("k")).toArrow()  # a row for each different count
    least, left = 1 << 62, words
    for n, k in sorted(zip(by_count["n"].to_pylist(), by_count["k"].to_pylist()), reverse=True):
        if k > left:
            break
        least, left = n, left - k
    return counts.filter(F.col("n") >= least)


class _Memo(dict):
    """ids of words as 32-bit numbers; words not met before are folded."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, bytes]):
        super().__init__(known)
        self.ranks, self.known, self.size = ranks, known, 0

    def __missing__(self, word: str) -> bytes:
        out = b"".join([self.ranks[p].to_bytes(4, "little") for p in merge(word.encode(), self.ranks)])
        if len(word) <= LONG_WORD:
            self[word] = out
            self.size += len(word)
            if len(self) > CACHE or self.size > CACHE_CHARS:
                self.clear()
                self.update(self.known)
                self.size = 0
        return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word: the pair of least rank is merged, the first of equals, until no pair has a rank."""
    if word in ranks:
        return [word]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > LONG:
        return _merge_long(parts, ranks)
    pairs = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
    return parts


def _merge_long(parts: list[bytes | None], ranks: dict[bytes, int]) -> list[bytes]:
    """The same over a linked list and a heap, for words so long that moving their parts would take quadratic time."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1], NEVER)) < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b], NEVER)) < NEVER:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p is not None]


#: The worker's words: what it has worked out outlasts a task.
_memos: dict[str, _Memo] = {}


def _known(docs: DataFrame, pieces: list[bytes], pattern: str, text_col: str, frequent: int) -> dict[str, bytes]:
    """ids of the commonest words, folded by expressions: `frequent` words at most. The words are a kept table first, so
    that the plan that holds the rank map is a scan and a projection."""
    words = keep(frequent_words(docs, pattern, text_col, frequent).select("word").repartition(8), "words")
    common = fold_words(words, Ranks(pieces)).select("word", "ids").toArrow()
    return {w: b"".join([i.to_bytes(4, "little") for i in ids]) for w, ids in zip(common["word"].to_pylist(), common["ids"].to_pylist())}


def _encoder(shared, pattern: str):
    """What a task encodes texts with: texts -> ids as 32-bit little-endian numbers."""
    key, pieces, known = shared.value
    if key not in _memos:
        _memos.clear()
        _memos[key] = _Memo({p: i for i, p in enumerate(pieces)}, known)
    memo, words = _memos[key], regex.compile(pattern)

    def run(texts: list[str | None]) -> list[bytes]:
        find = memo.__getitem__
        return [b"".join(map(find, words.findall(x or ""))) for x in texts]

    return run


def _shared(docs: DataFrame, ranks_path: str, pattern: str, text_col: str, frequent: int):
    pieces = read_ranks(ranks_path)
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pieces, _known(docs, pieces, pattern, text_col, frequent)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, ids (binary: 32-bit little-endian numbers) for every row: the whole text, each match of pattern by itself.

    The `frequent` commonest words are folded by expressions over a literal rank map, once for the whole corpus, and sent
    to the workers; a worker folds what else it meets, remembers it and joins the words' ids. Null and empty texts have no
    ids; repeated rows give repeated rows; a null id stays null; other columns are ignored; an empty table gives no rows.
    Very long texts are taken whole, one at a time in a worker.
    """
    shared = _shared(docs, ranks_path, pattern, text_col, frequent)

    def step(batch: pa.RecordBatch, encoder) -> dict:
        return {"id": batch.column(0), "ids": encoder(batch.column(1).to_pylist())}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, step, "id long, ids binary", {"id": pa.int64(), "ids": pa.binary()}, lambda: _encoder(shared, pattern)).withColumnRenamed("id", id_col)


def _join(ids: bytes, piece) -> bytes:
    return b"".join(map(piece, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """encoded, with the pieces of its ids joined, as binary; null where ids is. An id that the ranks don't hold fails the
    job: such bytes are no encoding by these ranks."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        for batch in slices(batches):
            texts = [None if x is None else _join(x, piece) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, to])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, `{to}` binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256: of the ids that encode() gives and of what decode() makes of them,
    taken in one go, so that neither leaves its worker. Null and empty texts have no ids, and the digests of nothing;
    very long texts are taken whole; repeated rows give repeated rows; a null id stays null; other columns, of any names,
    are ignored; an empty table gives no rows."""
    shared = _shared(docs, ranks_path, pattern, text_col, frequent)

    def step(batch: pa.RecordBatch, encoder) -> dict:
        ids, piece = encoder(batch.column(1).to_pylist()), shared.value[1].__getitem__
        return {"id": batch.column(0), "n": [len(x) // 4 for x in ids], "a": [hashlib.sha256(x).hexdigest() for x in ids], "b": [hashlib.sha256(_join(x, piece)).hexdigest() for x in ids]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    done = arrow_map(rows, step, "id long, n long, a string, b string", {"id": pa.int64(), "n": pa.int64(), "a": pa.string(), "b": pa.string()}, lambda: _encoder(shared, pattern))
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias("ids_sha256"), F.col("b").alias("decoded_sha256"))
