"""A training corpus from ``documents``: quality rules, line dedup, near-duplicate removal,
mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, ngram_jaccard, quality_rules, sequence_packing, source_mixing
from quern.llm.words import WORD_SQL
from quern.session import discard, stash


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, unchanged."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that had nothing else go."""
    cleaned = line_dedup.dedup_lines(docs)
    left = (F.col("line_dedup.n_removed") == 0) | F.col("text").rlike(WORD_SQL)
    return _counted(cleaned.filter(left).select(*[f"`{c}`" for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect, unchanged."""
    return ngram_jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source may be cut short."""
    return _counted(source_mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return sequence_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("source_mixing", mix), ("sequence_packing", pack)]

#: Ids of a tokenizer and hashes of shingles have no SQL form; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
