"""Cleaning and packing of a document corpus: five stages, each an operator of spindrift.llm.

A stage takes (spark, docs, sf_dir), works on all that the former kept and returns a DataFrame;
all but the last return the columns of documents. Between two stages the rows are written as
Parquet in the shared checkpoint folder and read again, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, exact_dedup, packing, quality, simhash
from spindrift.llm.queries import GOOD_AT, tokenizer
from spindrift.runtime import remove, rewritten_at, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accept(docs, model, GOOD_AT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts, that with the largest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each linked group of SimHash fingerprints, that with the smallest id."""
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = rewritten_at(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)  # what this stage has read
        before = path
    return docs


#: The quality rules and the packing can't be expressed in SQL.
ORACLE_SQL = None
