"""The corpus pipeline: five operators of ``clickmetrics.llm`` over ``documents``, one after another.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  All but
the last return the columns of ``documents``; between stages the rows are written and read again.

Edge cases are those of the operators: null texts and ids, repeated rows, empty tables and extra
columns pass through without failing.  ``n_chars`` follows the text where lines are cut from it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import bpe, linededup, paretomix, quality, sigtree
from clickmetrics.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share are cut from the texts."""
    cut = linededup.drop_lines(spark, docs)
    if "n_chars" in cut.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id."""
    return sigtree.one_per_group(spark, docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that every source has its target share of words."""
    return paretomix.mix_documents(spark, docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the decoded bytes."""
    return bpe.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources", source_mix), ("byte-level BPE", byte_bpe)]

# Byte-pair encoding can't be stated in SQL; tests/llm checks each stage against its operator, and the
# operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
