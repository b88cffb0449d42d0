"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame operations alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import small_batches

#: Terms in at least and at most these shares of the documents make up the lexicon: idf from 3 to 6.9. A document has so
#: many different terms on average, T; so at most T / LEAST_SHARE terms are in the lexicon, however many documents.
LEAST_SHARE, MOST_SHARE = 0.001, 0.05
LEAST_DOCS = 2
#: Subsets of the lexicon: at level k it falls into LEVELS[k] parts, and the first PARTS of them are hashed.
LEVELS = (4, 16, 64, 256, 1024, 4096)
PARTS = 8
#: A document with fewer lexicon terms keeps all its terms.
FEW = 4
#: Levels count for likeness whose parts hold at most so many of a document's terms on average.
SPARSE = 2.0
#: Bytes of text of a bucket of neighbours, sorted in one task (it may spill); the bounds of so many buckets at most are a
#: literal of the plan, beyond which buckets grow: 100,000 of 1 GB for 100 TB.
BUCKET_BYTES, MOST_BOUNDS = 4 << 20, 100_000
#: Ids looked at to place a bound.
PER_BOUND = 20
SEED = 97


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def _slots(hashes: list[int]) -> list[int | None]:
    """A table in which each hash stands at one of the two places that its lower and its upper half name."""
    size = 1 << max(4, (2 * len(hashes)).bit_length())
    while True:
        table: list[int | None] = [None] * size
        for x in hashes:
            at = x & (size - 1)
            for _ in range(200):
                x, table[at] = table[at], x
                if x is None:
                    break
                a, b = x & (size - 1), (x >> 32) & (size - 1)
                at = b if at == a else a
            else:
                break
        else:
            return table
        size *= 2


class Lexicon:
    """The hashes of the terms within the band, as a literal table that an expression looks up."""

    def __init__(self, hashes: list[int]):
        table = _slots(sorted({h & ((1 << 64) - 1) for h in hashes}))
        self.size = len(table)
        text = ",".join(str(0 if x is None else x - (1 << 64) if x >> 63 else x) for x in table)
        self.table = F.split(F.lit(text), ",").cast("array<bigint>")  # folded into a literal when the plan is made
        self.empty = not hashes

    def holds(self, h: Column) -> Column:
        if self.empty:
            return F.lit(False)
        low = h.bitwiseAND(F.lit(self.size - 1).cast("long")).cast("int")
        high = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(self.size - 1).cast("long")).cast("int")
        return (h != 0) & ((F.get(self.table, low) == h) | (F.get(self.table, high) == h))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Lexicon:
    """Of all documents' terms, those whose inverse document frequency lies within the band."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = counts.filter((F.col("n") >= max(LEAST_DOCS, int(np.ceil(least * total)))) & (F.col("n") <= max(LEAST_DOCS, most * total)))
    found = band.select(F.xxhash64("term").alias("h")).toArrow()["h"].to_pylist()
    return Lexicon(found)


def _hashes(lex: Lexicon, text: Column) -> Column:
    """Hashes of the terms that count, in order of the terms."""
    return F.transform(terms(text), lambda w: F.xxhash64(w))


def _level(hashes: Column, k: int, m: int) -> Column:
    some = min(PARTS, m)
    placed = F.transform(hashes, lambda h: F.struct(F.pmod(F.xxhash64(h, F.lit(SEED + k)), F.lit(m).cast("long")).alias("p"), h.alias("h")))
    near = F.filter(placed, lambda x: x["p"] < some) if m > some else placed

    def part(near: Column, s: int) -> Column:
        own = F.filter(near, lambda x: x["p"] == s)
        return F.when(F.size(own) > 0, F.xxhash64(F.transform(own, lambda x: x["h"])))

    return F.transform(F.array(near), lambda x: F.array(*[part(x, s) for s in range(some)]))[0]


def parts(hashes: Column) -> Column:
    """array of the subsets' hashes, null for subsets without terms; hashes: of the sorted terms that count."""
    out = []
    for k, m in enumerate(LEVELS):
        out.append(_level(hashes, k, m))
    return F.concat(*out)


def _print(df: DataFrame, text: str, prefix: str, lex: Lexicon) -> DataFrame:
    """df with {prefix}n, the number of terms that count, and {prefix}parts."""
    h = f"{prefix}hashes"
    out = df.withColumn(h, _hashes(lex, F.col(text)))
    held = F.filter(h, lex.holds)
    out = out.withColumn(f"{prefix}held", held)
    out = out.withColumn(f"{prefix}kept", F.when(F.size(f"{prefix}held") >= FEW, F.col(f"{prefix}held")).otherwise(F.col(h)))
    return out.withColumn(f"{prefix}n", F.size(f"{prefix}kept")).withColumn(f"{prefix}parts", parts(F.col(f"{prefix}kept"))).drop(h, f"{prefix}held", f"{prefix}kept")


def shown(n: Column, p: Column) -> Column:
    """The fingerprint as text: the number of terms and the subsets' hashes."""
    return F.concat(n.cast("string"), F.lit(":"), F.array_join(F.transform(p, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-"))), "."))


def likeness(an: Column, a: Column, bn: Column, b: Column) -> Column:
    """Share of equal subsets among those that hold a term of either, over the levels that are sparse for both; the last
    level if none is. 1 if neither has any term."""
    level = [k for k, m in enumerate(LEVELS) for _ in range(min(PARTS, m))]
    most = F.greatest(an, bn).cast("double")
    open_ = F.array(*[(F.lit(float(LEVELS[k])) * SPARSE >= most) | F.lit(k == len(LEVELS) - 1) for k in level])
    pairs = F.arrays_zip(open_.alias("o"), a.alias("a"), b.alias("b"))
    used = F.filter(pairs, lambda x: x.getField("o") & (x.getField("a").isNotNull() | x.getField("b").isNotNull()))
    same = F.filter(used, lambda x: x.getField("a") == x.getField("b"))
    none = F.when(most == 0, 1.0).otherwise(F.when(F.size(F.filter(pairs, lambda x: ~x.getField("a").eqNullSafe(x.getField("b")))) == 0, 1.0).otherwise(0.0))
    return F.when(F.size(used) > 0, F.size(same) / F.size(used)).otherwise(none)


def fingerprints(docs: DataFrame, lex: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with `terms` and `fingerprint`: of each whole text, null being empty."""
    out = _print(docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "__t", "__p_", lex)
    return out.withColumn("fingerprint", shown(F.col("__p_n"), F.col("__p_parts"))).withColumnRenamed("__p_n", "terms").drop("__t", "__p_parts")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below key, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into a literal when the plan is made
    span = F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.shiftright(x["a"] + x["b"], 1)
        right = (x["a"] < x["b"]) & (F.get(table, mid) < key)
        return F.struct(F.when(right, mid + 1).otherwise(x["a"]).alias("a"), F.when(right | (x["a"] >= x["b"]), x["b"]).otherwise(mid).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), span, halve)["a"]


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows (id, ...) with `next`, a struct of the row that follows in descending order of id; the first after the last.

    Quantiles of a sample of the ids cut the order into buckets of about BUCKET_BYTES of text, which are sorted apart; the
    sample moves bounds, not results. The first rows of a bucket are also sent to the end of the one before, so every row
    finds the next in its own bucket. Rows without an id come last, in order of their texts' hashes, cut likewise.
    """
    columns = rows.columns
    size, ids, none = rows.agg(F.sum(F.when(F.col("id").isNotNull(), F.octet_length("text"))), F.count("id"), F.sum(F.when(F.col("id").isNull(), F.octet_length("text")))).first()
    n = int(min(MOST_BOUNDS, max(1, (size or 0) // BUCKET_BYTES)))
    bounds: list[int] = []
    if n > 1:
        share = min(1.0, PER_BOUND * n / ids)
        some = rows.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))).select("id").toArrow()["id"].to_numpy()
        bounds = sorted(set(np.quantile(some, np.arange(1, n) / n, method="nearest").tolist())) if len(some) else []
    m = int(min(MOST_BOUNDS, max(1, (none or 0) // BUCKET_BYTES)))
    h = F.xxhash64("text")
    key = F.coalesce("id", F.bitwise_not(h))  # in descending order
    blank = F.least(F.lit(m - 1), F.floor((h / F.lit(2.0**64) + 0.5) * m)).cast("int")
    placed = rows.withColumns({"__key": key, "__b": F.when(F.col("id").isNull(), -1 - blank).otherwise(_place(F.col("id"), bounds)).cast("int")})
    heads = placed.groupBy("__b").agg(F.max("__key").alias("__first"))  # a row for each bucket, so their number is bounded
    way = Window.partitionBy(F.lit(0)).orderBy(F.desc("__b"))
    last = F.min("__b").over(Window.partitionBy(F.lit(0)))  # the first bucket's rows follow the last bucket's
    heads = heads.select("__b", "__first", F.coalesce(F.lag("__b").over(way), last).alias("__to"))
    dealt = placed.join(F.broadcast(heads), "__b", "left")
    here, there = F.struct(F.col("__b").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("__to").alias("b"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("__x", F.explode(F.when(F.col("__key") == F.col("__first"), F.array(here, there)).otherwise(F.array(here))))
    by = Window.partitionBy("__at").orderBy("guest", F.desc("__key"), "text")
    dealt = dealt.select(*columns, "__key", F.col("__x.b").alias("__at"), F.col("__x.guest").alias("guest"))
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(by)).filter(~F.col("guest")).drop("__at", "guest", "__key")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document's, descending id, instead of its own last third. Null texts
    are empty; of rows that share an id the one with the lesser text comes first; rows without an id come last, by their
    texts' hashes. A document
    without terms has an empty fingerprint, whose likeness is 1 to another such and 0 to others. An empty table gives no
    rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    lex = lexicon(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _neighbours(_print(rows, "text", "a_", lex))  # the next document's print comes along with its text
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    rows = rows.withColumn("chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring(F.col("next.text"), F.lit(1), m)))
    rows = rows.withColumn("sha", F.sha2(F.col("edited"), 256)).withColumn("c_n", F.col("next.a_n")).withColumn("c_parts", F.col("next.a_parts")).drop("next")
    rows = _print(rows, "edited", "b_", lex)
    c = F.col
    return rows.select(c("id").alias(id_col), c("chars").alias("n_chars"), c("sha").alias("edited_sha256"), shown(c("a_n"), c("a_parts")).alias("fingerprint"), shown(c("b_n"), c("b_parts")).alias("edited_fingerprint"), likeness(c("a_n"), c("a_parts"), c("b_n"), c("b_parts")).alias("near_edited"), likeness(c("a_n"), c("a_parts"), c("c_n"), c("c_parts")).alias("near_next"))
