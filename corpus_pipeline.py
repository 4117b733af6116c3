"""A training-data pipeline over ``documents``: each stage's result is written
as Parquet and read back as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logwright.llm import bpe, line_dedup, mixing, quality, similar
from logwright.llm.queries import ranks_path
from logwright.session import shared_dir, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band
    reject go; a verdict belongs to language and text, whatever the doc_id."""
    ship(spark)
    return quality.drop_low_quality(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in the
    one with the largest doc_id; every document stays."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the
    smallest doc_id, null last: five-word shingles, a Jaccard similarity of 0.8
    or more, candidates from the covering tables of seven fingerprints. Of rows
    that repeat a doc_id and text one stays; texts without words are alike."""
    ship(spark)
    return similar.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, those of small sources again, up to twice as
    often as those of any other, towards target weights."""
    ship(spark)
    return mixing.mixed(docs, entropy_share=0.98, max_repeats=2.0)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets of each text, beside the other columns; a null
    text has none."""
    ship(spark)
    return bpe.encode(docs, ranks_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: SQL can express neither the perplexity bands nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results lie in the folder
    that all executors share. Rows with a null or repeated doc_id go through
    every stage as rows of their own; an empty table gives no rows."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
