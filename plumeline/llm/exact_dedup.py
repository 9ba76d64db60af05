"""Exact duplicates: group by a 128-bit content hash and compare the bytes inside each group.

Only DataFrame functions run here. Two texts are equal when they agree after each run of white space
is replaced by one space; a null text counts as empty. Grouping is by the hash and the normalised text
itself, so two texts that merely share a hash form two groups. Aggregation is partial before the
shuffle: a group of copies, however large, sends one row from each input partition.

Defined results: a null doc_id never wins over another id; a group whose ids are all null has a null
keep_id and its rows count as kept; rows that repeat both doc_id and text share one decision in
`duplicate_table`, while `drop_exact_duplicates` returns a single row of them; an empty table gives an
empty result; further columns are ignored by the first and carried through unchanged by the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_or_empty


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def content_hash(body: Column) -> Column:
    """128 bits of the normalised text, as 16 bytes."""
    return F.unhex(F.md5(body.cast("binary")))


def duplicate_table(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    hashed: maps the normalised text to its group hash (tests pass a weak one to force collisions).
    """
    bodies = docs.select(F.col("doc_id"), normalised().alias("body")).withColumn("hash", hashed(F.col("body")))
    groups = (
        bodies.groupBy("hash", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # the digest tells the texts of one hash apart without sending them a second time
        .select("hash", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = bodies.select("doc_id", "hash", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    return rows.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts, with all its columns; of rows that repeat an id, the one with the least hash of all columns."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    held = docs.select(
        normalised().alias("body"),
        # rows that repeat an id are told apart by all their columns, so that the same one stays in each run
        F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.xxhash64(*[f"`{c}`" for c in names]).alias("all")).alias("rank"),
        whole.alias("row"),
    ).withColumn("hash", hashed(F.col("body")))
    best = held.groupBy("hash", "body").agg(F.min_by("row", "rank").alias("row"))
    return best.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
