"""From raw documents to packed sequences, in five stages.

Each stage works on all rows the one before kept; between stages rows are
written as Parquet and read again.  All but the last keep the columns of
``documents``, whatever more there are and whatever they are called.

Null and empty texts have too few words and go in the first stage, as does a
table without rows: every stage of an empty table is empty.  Very long texts are
read whole by every stage.  Of rows that repeat whole, or in id and text, one
stays, the same in every run; rows without an id take part and come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import packing, pii, quality, simhash, suffix, tokens
from quarry.llm.common import kept, release, scratch, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long byte strings that occurred earlier."""
    return suffix.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, lexical neighbours together."""
    return packing.pack(docs, *tokens.default_paths())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: The stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: a row per piece of a packed sequence.

    Tables a stage stages for itself are deleted when its rows are written, and
    these when the next stage's are; what the last one reads stays, as its
    result is lazy.  An empty table gives no pieces.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = kept(staged(stage(spark, docs, sf_dir), name))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
