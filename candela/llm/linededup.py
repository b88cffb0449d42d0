"""Line dedup by the shortest passages that begin or end at each line, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import free_name, keep, lookup

#: Least words of a chunk of several lines, and of a single line.
CHUNK_WORDS, LINE_WORDS = 20, 50
#: Rows that share id and text are joined with what to remove by a broadcast, where that is no more lines than this.
FEW_LINES = 2_000


def _key(id_col: str, text_col: str) -> Column:
    """A row's identity: its id and the hash of its text. Rows that share both are one row, several times."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64(F.col(text_col))), F.lit(":"), F.length(text_col))


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " ", "")) + F.when(F.length(F.trim(line)) > 0, 1).otherwise(0)


def _passage(around: Column, chunk_words: int) -> Column:
    """The first lines of around that are two or more and have chunk_words or more; null if there are too few."""
    none = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("words"))
    longer = lambda a, x: F.when((a.k >= 2) & (a.words >= chunk_words), a).otherwise(F.struct((a.k + 1).alias("k"), (a.words + x.words).alias("words")))
    found = F.aggregate(around, none, longer)
    return F.when((found.k >= 2) & (found.words >= chunk_words), F.slice(around, F.lit(1), found.k))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """key, rows, first, last: for each row (of which there may be several alike) that holds them, the line ranges that repeat an earlier place of the corpus.

    A passage that repeats consists of lines that repeat, so lines found once cut the text, and what is left are runs of
    repeated lines. At each line of a run that isn't empty, the shortest chunk that begins there and the shortest that ends
    there are taken, and each line of line_words or more alone. Every repeated passage is the union of such chunks inside
    it, whatever stands beside it: a line from which a chunk would leave the passage is in the chunk that ends the passage.
    All lines of the chunks are compared by their bytes before they count as equal. Of equal chunks the first in the order
    of id and line stays, a null id coming first, and so do those that overlap it, or each other from it on: a line that
    follows itself is no repeated passage.
    """
    named = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = named.withColumn("key", _key("id", "text"))
    lines = named.select("key", "id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = keep(lines.select("key", "id", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), _words(F.col("line")).alias("words")), "lines")
    seen = keep(lines.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    marked = lookup(lines, seen.withColumn("again", F.lit(True)), "h", "n", [F.col("key"), F.col("pos")]).filter("again")
    # the copies of a repeated row become one, before the shuffle where they can; then a document's lines meet in one task
    marked = marked.groupBy("key", "pos", "id", "h", "g", "words").agg(F.count("*").alias("rows"))
    by = Window.partitionBy("key").orderBy("pos")
    apart = F.coalesce(F.col("pos") != F.lag("pos").over(by) + 1, F.lit(True))
    marked = marked.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("long")).over(by))
    # lines of a word or more, so that a chunk has at most `most` of them; the empty ones between follow from the places
    most = max(2, chunk_words)
    run = Window.partitionBy("key", "run").orderBy("pos")
    line = F.struct("pos", "h", "g", "words")
    marked = marked.filter("words > 0").withColumn("after", F.collect_list(line).over(run.rowsBetween(0, most - 1)))
    marked = marked.withColumn("until", F.reverse(F.collect_list(line).over(run.rowsBetween(1 - most, 0))))
    alone = F.when(F.col("words") >= line_words, F.array(line))
    chunks = marked.withColumn("ways", F.array(_passage(F.col("after"), chunk_words), F.reverse(_passage(F.col("until"), chunk_words)), alone))
    chunks = chunks.select("key", "id", "rows", F.explode(F.array_distinct(F.filter("ways", lambda x: x.isNotNull()))).alias("way"))
    chunks = chunks.select("key", "id", "rows", F.get("way", F.lit(0)).pos.alias("first"), F.element_at("way", -1).pos.alias("last"), "way")
    hs = F.transform("way", lambda x: F.struct((x.pos - F.col("first")).alias("at"), x.h.alias("h"), x.g.alias("g")))
    chunks = chunks.select("key", "id", "rows", "first", "last", F.concat(F.hex(F.xxhash64(hs)), F.hex(F.xxhash64(F.lit(1), hs))).alias("chunk")).distinct()
    equals = Window.partitionBy("key", "chunk").orderBy("first")
    chunks = chunks.withColumn("beyond", F.coalesce(F.col("first") > F.lag("last").over(equals), F.lit(False)))
    chunks = keep(chunks.withColumn("beyond", F.max("beyond").over(equals)), "chunks")
    place = F.struct("id", "key", "first")
    many = keep(chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min(place).alias("origin")).filter("n > 1"), "candidates")
    found = keep(lookup(chunks, many, "chunk", "n", [F.col("key"), F.col("first")]).filter("origin is not null"), "found")
    # the bytes: lines of found chunks that share both hashes; where such lines differ after all, their chunks stay
    spans = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("at"))
    texts = named.join(spans.hint("merge"), "key").select(F.split("text", "\n", -1).alias("lines"), F.explode("at").alias("at"))
    texts = texts.select(F.get("lines", F.col("at")).alias("line")).groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g")).agg(F.min("line").alias("a"), F.max("line").alias("b"))
    unlike = keep(texts.filter("a != b").select("h", "g"), "unlike")
    sure = found
    if unlike.limit(1).count():
        bad = lines.join(unlike, ["h", "g"]).select("key", "pos")
        sure = found.join(bad, (found["key"] == bad["key"]) & F.col("pos").between(F.col("first"), F.col("last")), "left_anti")
    return keep(sure.filter((F.col("origin.key") != F.col("key")) | F.col("beyond")).select("key", "rows", "first", "last"), "repeats")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """docs with its columns, where text_col lacks the lines of chunks that occur earlier in the corpus, and as the last
    column `__removed` (with more underscores if docs has one of that name), how many lines were removed.

    A chunk is a run of lines of at least chunk_words words, or one line of at least line_words; every such run that
    stands in an earlier place goes, whatever lines are beside it. A line stays at its
    first place, since no chunk that holds it is found earlier. Null texts stay null and empty ones empty; a text all of
    whose lines are removed becomes empty. Rows with equal id and text are treated as one and stay alike. All rows
    stay, and columns may have any names. An empty table gives no rows.
    """
    repeats = repeated_chunks(docs, id_col, text_col, chunk_words, line_words)
    gone = repeats.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("gone"), F.max("rows").alias("n"))
    gone = gone.withColumn("n", F.when(F.size("gone") <= FEW_LINES, F.col("n")).otherwise(1))
    row, text = F.struct(*[docs[f"`{c}`"] for c in docs.columns]), docs[f"`{text_col}`"].cast("string")
    rows = docs.select(row.alias("__row"), docs[f"`{id_col}`"].cast("long").alias("__id"), text.alias("__text"))
    rows = rows.withColumn("__key", _key("__id", "__text"))
    rows = lookup(rows, keep(gone.withColumnRenamed("key", "__gk"), "removed"), "__key", "n", [F.xxhash64("__row")], right_key="__gk", wide=True)
    rows = rows.withColumn("__lines", F.when(F.col("gone").isNotNull(), F.split("__text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "gone")  # in order
    told = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    out = rows.withColumn("__new", told)
    columns = [F.col("__new").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).alias(free_name(docs, "__removed")))
