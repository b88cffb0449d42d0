"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import bpe, decontaminate, html, imatch, merkle, oracles, quality, toxicity, whitening
from candela.llm.ann import nearest
from candela.llm.common import read
from candela.llm.linededup import dedup_lines
from candela.llm.packing import pack
from candela.llm.simhash import near_duplicates
from candela.llm.warc import read_archives, write_archives


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: title paragraphs and body blocks that the field labels as article."""
    return html.main_texts(read(spark, sf_dir, "pages"), html.trained())


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every other vector, for each 20th."""
    return nearest(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its own score, its host and path posteriors, and whether it is kept."""
    docs = read(spark, sf_dir, "documents")
    scored = quality.score_corpus(quality.fit(docs, read(spark, sf_dir, "labels"), carry=["doc_id", "source", "lang"]))
    return scored.select("row.*", "doc_score", "host_score", "path_score", "score", "keep")


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of passages that an earlier place of the corpus holds."""
    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.withColumnRenamed("__removed", "lines_removed")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and the components they form at two bits or fewer."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike these and the next document's are."""
    return imatch.edited(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back by byte ranges."""
    return read_archives(write_archives(read(spark, sf_dir, "pages")), payloads=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole texts by a machine that learnt from the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all texts encoded to byte-level tokens, and decoded again."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' projections on up to 32 whitened components."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten words in a row of benchmark items, and of how many."""
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' manifest by source, checked against texts of which a fifth have lost their capitals."""
    docs = read(spark, sf_dir, "documents")
    spoilt = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": merkle.lower_ascii(F.col("text"))}, spoilt)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_ann, op3_quality, op4_linededup, op5_simhash, op6_imatch, op7_warc, op8_toxicity, op9_packing, op10_bpe, op11_whitening, op12_decontaminate, op13_merkle)}


ORACLE = {"op7_warc": oracles.WARC, "op12_decontaminate": oracles.DECONTAMINATE, "op13_merkle": oracles.MERKLE}


def oracle_sql() -> dict[str, str]:
    return ORACLE
