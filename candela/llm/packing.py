"""Packing of token streams: concatenate and cut."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import keep, release, slices

LENGTH = 2048
END_ID = 1
#: Words whose ids a worker remembers, and their characters in all; beyond that it starts anew. Longer words than
#: LONG_WORD aren't remembered.
CACHE, CACHE_CHARS, LONG_WORD = 600_000, 16_000_000, 256


class _Words(dict):
    """What _Ids has worked out so far."""

    def __init__(self, find):
        super().__init__({"": b""})
        self.find, self.size = find, 0

    def __missing__(self, word: str) -> bytes:
        out = self.find(word)
        if len(word) <= LONG_WORD:
            self[word] = out
            self.size += len(word)
            if len(self) > 2 * CACHE or self.size > CACHE_CHARS:
                self.clear()
                self.size = 0
        return out


#: Words that the rules below treat as the tokenizer does: letters and printable ASCII.
PLAIN = regex.compile(r"[\p{L}!-~]*")


class _Ids:
    """ids of a text as 16-bit numbers, by way of the ids of its words between plain white space.

    The tokenizer drops white space and no token spans it, so words may be encoded one by one. Only the four commonest
    kinds are split on here; the others stay in a word and the tokenizer deals with them. Where the tokenizer's file asks
    for the usual steps (NFC, lower case, split by a pattern, bytes), words of letters and printable ASCII take them here,
    and only parts not met before go through the merges; all other words go through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.whole.encode_special_tokens = True
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.whole.model
        told = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.usual = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"]) if self.usual else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.bytes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.clear()

    def clear(self) -> None:
        self.seen, self.parts = _Words(self.word), _Words(self.part)

    def part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.bytes)
        return b"".join([x.id.to_bytes(2, "little") for x in self.model.tokenize(part)])

    def word(self, word: str) -> bytes:
        if not self.usual or not PLAIN.fullmatch(word) or not unicodedata.is_normalized("NFC", word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        word = word.replace("\u03a3", "\u03c3").lower()  # capital sigma: letter by letter, as the tokenizer
        if word.isascii() and word.isalpha():
            return self.parts[word]
        return b"".join([self.parts[x] for x in self.pattern.findall(word)])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.seen) > CACHE:
            self.clear()
        find = self.seen.__getitem__
        return [b"".join(map(find, (x or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for x in texts]


#: The worker's tokenizers: what they remember outlasts a task.
_tokenizers: dict[str, _Ids] = {}


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _tokenizers[path] = _tokenizers.get(path) or _Ids(path)
        at = 0  # tokens of this partition so far
        end = np.array([end_id], "<u2").tobytes()
        for batch in slices(batches):
            docs, parts, starts, tokens = batch.column(0), batch.column(1), [], []
            data = [x + end for x in ids(batch.column(2).to_pylist())]
            for x in data:
                starts.append(at)
                tokens.append(len(x) // 2)
                at += len(x) // 2
            yield pa.RecordBatch.from_arrays([docs, parts, pa.array(starts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(data, pa.binary())], names=["id", "part", "at", "tokens", "ids"])
        release()

    return run


def _cut(length: int):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for i, at, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.frombuffer(data, "<u2").astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    rows.append((i, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(names))], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All documents' ids, each followed by end_id, form one stream that is cut every length ids; only the last sequence is
    shorter. First pass: each task tokenises its partition and numbers its tokens from 0; the kept table then fixes which
    document stands where. Second pass: the prefix sums of the partitions' totals (one row a partition) turn these numbers
    into places in the stream, at which documents are cut. Null and empty texts are end_id alone. Repeated rows are packed
    as often as they occur, a null id stays null, other columns are ignored, an empty table gives no pieces. Very long
    texts are tokenised whole and cut over as many sequences as they fill.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.spark_partition_id().cast("long").alias("part"), F.col(text_col).cast("string").alias("text"))
    stream = keep(rows.mapInArrow(_tokenise(tokenizer_path, end_id), "id long, part long, at long, tokens long, ids binary"), "tokens")
    totals = stream.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # a row for each input partition
    placed = stream.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("at")).alias("at"), "ids")
    cut = placed.mapInArrow(_cut(length), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return cut.withColumnRenamed("id", id_col)
