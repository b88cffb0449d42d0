"""Benchmark decontamination by a positional inverted index of the training tokens, in DataFrame operations alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import HEAVY_SHARE, free_name, is_small, keep, lookup

#: What parts words, in either case.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Places over which postings of a heavy term are dealt.
SALTS = 64


def words(text: Column) -> Column:
    """The words as they are written."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), GAPS), "")


def lower(word: Column) -> Column:
    """word with A-Z, and no other letters, in lower case."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: uid (a number of its own for each row of docs), term, pos; and per row of docs a head, whose term
    is null, with doc_id and n_words.

    Each task writes the postings of its documents as a segment in order of the terms' hashes, heads first, so nothing is
    shuffled, a term's postings lie together and heads are read without the rest. A null text has no words; equal rows have a
    head and postings each.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs[f"`{id_col}`"].cast("long").alias("doc_id"), words(docs[f"`{text_col}`"]).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long"))
    each = rows.select("uid", "doc_id", "n", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("at", "word"))
    head = F.col("word").isNull()
    each = each.select("uid", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n")).alias("n_words"), lower(F.col("word")).alias("term"), (F.col("at") - 1).alias("pos"))
    place = F.when(F.col("term").isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64("term"))
    return keep(each.sortWithinPartitions(place), "postings")


def _tokens(index: DataFrame) -> DataFrame:
    return index.filter("term is not null").select("uid", "term", "pos")


def test_terms(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ids, terms), both kept: item, gid for each item with words, gid naming its sequence of words; and gid, size, q, term,
    n for each word of each different sequence, n being how often the corpus holds it."""
    rows = items.select(F.coalesce(items[f"`{id_col}`"].cast("string"), F.lit("")).alias("item"), F.transform(words(items[f"`{text_col}`"]), lower).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("gid", F.sha2(F.array_join("w", " "), 256))
    ids = keep(rows.select("item", "gid").distinct(), "items")
    each = keep(rows.select("gid", F.size("w").alias("size"), F.posexplode("w").alias("q", "term")).distinct(), "item_words")
    wanted = each.select("term").distinct()
    tokens = _tokens(index).select("term")
    counts = tokens.join(F.broadcast(wanted), "term", "left_semi") if is_small(wanted, F.col("term")) else tokens
    counts = counts.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term")
    known = each.join(counts, "term", "left")
    return ids, keep(known.select("gid", "size", "q", "term", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "test_terms")


def _windows(terms: DataFrame) -> DataFrame:
    """gid, start, rarest and second (n, term, q; the same in a window of one word), held (its words): the windows that can
    occur, as the corpus holds each of their words."""
    by = Window.partitionBy("gid").orderBy("q").rowsBetween(0, WINDOW - 1)
    word = F.struct("n", "term", "q")
    all_ = terms.withColumn("held", F.collect_list(word).over(by)).withColumn("by", F.array_sort("held"))
    told = all_.select("gid", F.col("q").alias("start"), "size", F.col("by")[0].alias("rarest"), F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0))).alias("second"), F.col("held.term").alias("held"))
    return told.filter((F.col("start") <= F.greatest(F.col("size") - WINDOW, F.lit(0))) & (F.col("rarest.n") > 0)).drop("size")


def _at_postings(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (term, n, ...; several of a term), each with every posting (uid, pos) of its term."""
    if is_small(anchors, F.col("term")):
        return tokens.join(F.broadcast(anchors), "term")
    total = tokens.count()
    heavy = anchors.filter(F.col("n") >= max(2, total * HEAVY_SHARE)).select("term").distinct().withColumn("heavy", F.lit(True))  # 1 / HEAVY_SHARE at most
    deal = F.when(F.col("heavy"), F.pmod(F.xxhash64("uid", "pos"), F.lit(SALTS))).otherwise(0)
    dealt = tokens.join(F.broadcast(heavy), "term", "left").withColumn("salt", deal.cast("int")).drop("heavy")
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = anchors.join(F.broadcast(heavy), "term", "left").withColumn("salt", F.explode(salts)).drop("heavy")
    return dealt.join(spread.hint("merge"), ["term", "salt"]).drop("salt")


def _postings_of(index: DataFrame, needs: DataFrame) -> DataFrame:
    """The postings of the documents that needs names, if these are few; all of them otherwise."""
    uids = needs.select("uid").distinct()
    return _tokens(index).join(F.broadcast(uids), "uid", "left_semi") if is_small(uids) else _tokens(index)


def phrases(index: DataFrame, terms: DataFrame) -> DataFrame:
    """uid, gid, first, last: the places of documents where windows of an item stand, joined where they overlap.

    A document place less an item place is an offset, the same along a phrase. The postings of each window's rarest word
    give candidate offsets, those of its second rarest leave the ones where they are met at the same offset; at these the
    postings of all other words of the item are met, and runs of WINDOW words or more (or whole shorter items) are phrases.
    Words are compared as they are, not by hashes.
    """
    windows = keep(_windows(terms), "windows")
    anchors = windows.select("gid", "rarest.*").distinct()
    pairs = windows.select("gid", F.col("rarest.q").alias("q"), F.col("second.q").alias("q2"), F.col("second.term").alias("term2")).distinct()
    probed = windows.select(F.explode(F.array("rarest.term", "second.term")).alias("term")).distinct()
    small = is_small(probed, F.col("term"))
    tokens = keep(_tokens(index).join(F.broadcast(probed), "term", "left_semi"), "probes") if small else _tokens(index)
    found = _at_postings(tokens, anchors).select("uid", "gid", "q", (F.col("pos") - F.col("q")).alias("offset"))
    asked = found.join(F.broadcast(pairs) if is_small(pairs, F.concat("gid", "term2")) else pairs, ["gid", "q"]).filter(F.col("offset") + F.col("q2") >= 0)
    asked = asked.select("uid", "gid", "offset", F.col("term2").alias("term"), (F.col("offset") + F.col("q2")).alias("pos"))
    found = keep(asked.join(tokens, ["uid", "pos", "term"]).select("uid", "gid", "offset").distinct(), "offsets")
    needs = found.join(terms, "gid").select("uid", "gid", "offset", "size", "q", "term", (F.col("offset") + F.col("q")).alias("pos")).filter("pos >= 0")
    met = needs.join(_postings_of(index, found), ["uid", "pos", "term"])
    by = Window.partitionBy("uid", "gid", "offset").orderBy("q")
    runs = met.withColumn("run", F.col("q") - F.row_number().over(by)).groupBy("uid", "gid", "offset", "size", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.col("size"), F.lit(WINDOW))).select("uid", "gid", "first", "last")


def near(index: DataFrame, terms: DataFrame, within: int = 2 * WINDOW) -> DataFrame:
    """uid, gid, start, pos, span: proximity matches. Each different word of the window that begins at `start` of the item
    stands, in any order, at most `within` words from the window's rarest word, at pos; span: words from the first to the
    last of those nearest to it (of two as near, the earlier counts)."""
    windows = _windows(terms).select("gid", "start", "rarest.term", "rarest.n", F.array_distinct("held").alias("held"))
    at = keep(_at_postings(_tokens(index), keep(windows, "windows")), "places")
    block = F.floor(F.col("pos") / within).cast("int")
    others = F.filter("held", lambda w: w != F.col("term"))
    needs = at.select("uid", "gid", "start", F.col("pos").alias("at"), block.alias("b"), F.size(others).alias("m"), F.explode_outer(others).alias("term"))
    alone = needs.filter("m = 0").select("uid", "gid", "start", F.col("at").alias("pos"), F.lit(1).alias("span"))
    needs = needs.filter("m > 0").withColumn("b", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)))
    met = needs.join(_postings_of(index, at).withColumn("b", block), ["uid", "term", "b"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
    nearest = met.groupBy("uid", "gid", "start", "at", "m", "term").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("at")).alias("d"), "pos")).alias("x"))
    whole = nearest.groupBy("uid", "gid", "start", "at", "m").agg(F.count("*").alias("k"), F.least(F.min("x.pos"), F.col("at")).alias("a"), F.greatest(F.max("x.pos"), F.col("at")).alias("z"))
    return whole.filter("k = m").select("uid", "gid", "start", F.col("at").alias("pos"), (F.col("z") - F.col("a") + 1).alias("span")).unionByName(alone)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without words never occur. Rows of items that share an id are one
    item; a null item id counts as an empty one. Repeated rows of docs are told of each. Empty docs give no rows, empty
    items no hits. Other columns of either table, of any names, are ignored; where id_col clashes with a column of the
    result, that one gets an underscore.
    """
    index = build_index(docs, id_col, text_col)
    ids, terms = test_terms(index, items, item_col, item_text)
    spans = phrases(index, terms)
    before = Window.partitionBy("uid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1)))
    hits = spans.withColumn("fresh", F.greatest(fresh, F.lit(0)).cast("long")).groupBy("uid").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("gid")).alias("gids"))
    hits = keep(hits.withColumn("set", F.sha2(F.array_join("gids", ","), 256)), "hits")
    # documents that hold the same sequences have the same items: told once
    sets = hits.groupBy("set").agg(F.count("*").alias("n"), F.first("gids").alias("gids")).withColumn("gid", F.explode("gids")).join(ids, "gid")
    sets = sets.groupBy("set", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = keep(sets.select("set", "n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "sets")
    hits = lookup(hits.select("uid", "n_hit", "set"), sets, "set", "n", [F.col("uid")]).drop("set")
    heads = index.filter("term is null").select("uid", "doc_id", "n_words").join(hits, "uid", "left")
    n, k = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("n_items", F.lit(0).cast("long"))
    told = [F.col("n_words"), n.alias("n_hit"), k.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated")]
    out = heads.select(F.col("doc_id").alias("__id"), *told)
    for c in out.columns[1:]:
        if c.lower() == id_col.lower():
            out = out.withColumnRenamed(c, free_name(out, c))
    return out.withColumnRenamed("__id", id_col)
