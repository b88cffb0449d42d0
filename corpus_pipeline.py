"""The corpus pipeline: quality classifier, toxicity, line dedup, near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import linededup, neardup, packing, quality, toxicity
from candela.llm.common import keep, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score from text, host and path is 0.5 or more stay. Nulls and empty texts are scored as empty."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("keep").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that the machine takes for an insult stay; null and empty texts do."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the lines of chunks that occur earlier; n_chars follows the text. Null texts stay null."""
    done = linededup.dedup_lines(docs)
    n = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return done.select(*[n.alias(c) if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 0.8 or more of their five-word shingles in common stays, that of least id."""
    return neardup.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("lines", line_stage), ("near", near_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each on all that the one before kept: pieces as operator 9 gives them. Nulls, empty and
    very long texts, repeated rows and extra columns are as each stage says; an empty table gives no pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
