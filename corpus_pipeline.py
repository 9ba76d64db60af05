"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns a DataFrame, which is written as Parquet and read
again for the next one. All but the last return the columns of documents, whatever further columns there are
and whatever their names. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumeline.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from plumeline.llm.common import shared_path
from plumeline.llm.tokenization import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds a language; null, empty and letterless texts go, a null doc_id or lang stays."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts; a null id only where all are, one row of those that repeat an id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 80 % of the five-word shingles; rows without an id or without words stay."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of 1024 tokens; rows that repeat are packed once each."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), special_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Several stages have no SQL. Tests compare exact copies with a plain loop and near copies with all pairs; the others have tests of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
