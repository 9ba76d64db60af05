"""Token counts as rollups that signed deltas keep up to date.

Counting happens once for each document. What changes is a delta: an insert adds a document and its
tokens, a delete takes them away, and a revised count takes the old one away and adds the new. Deltas
are summed by source, language and tokenizer version before they are stored, one folder for each batch;
totals are the sum over the committed batches, so they never need a recount.

A commit is idempotent: a batch id that is already committed is left as it is, and a folder that a lost
driver left without its success mark is written anew. `compact` folds the committed batches into one
snapshot that remembers their ids.

Defined results: a null text counts as empty; null sources and languages are groups of their own; rows
that repeat a document count each time; an empty table commits an empty batch; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty
from .tokenization import encoder

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "doc_id long, source string, lang string, tokens long"


def _counter(path: str, special_ids: bool) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = encoder(path, special_ids).encode([t or "" for t in batch.column(3).to_pylist()])
            columns = [*batch.columns[:3], pa.array(counts)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def count_tokens(docs: DataFrame, tokenizer_file: str, version: str, special_ids: bool = False) -> DataFrame:
    """doc_id, source, lang, tokenizer and tokens of each document; special_ids as in Encoder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    return in_batches(rows, _counter(tokenizer_file, special_ids), _SCHEMA).withColumn("tokenizer", F.lit(version))


def _signed(counted: DataFrame, sign: int) -> DataFrame:
    return counted.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).cast("long").alias("tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    return _signed(counted, 1)


def deletes(counted: DataFrame) -> DataFrame:
    return _signed(counted, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of documents whose counts (or groups) change; before and after are counted documents."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Totals below a path in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _done(self, path: str) -> bool:
        fs, at = self._fs(f"{path}/_SUCCESS")
        return fs.exists(at)

    def _folders(self, kind: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{kind}")
        if not fs.exists(at):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory())
        return [n for n in names if self._done(f"{self.path}/{kind}/{n}")]

    def _folded(self) -> tuple[str | None, set[str]]:
        """The newest snapshot, and the batches that it holds."""
        snapshots = self._folders("snapshots")
        if not snapshots:
            return None, set()
        newest = f"{self.path}/snapshots/{snapshots[-1]}"
        names = self.spark.read.parquet(newest).select(F.explode("batches")).distinct().collect()
        return newest, {r[0] for r in names}

    def committed(self) -> set[str]:
        return set(self._folders("batches")) | self._folded()[1]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add the deltas once; False if this batch was committed before."""
        if batch_id in self.committed():
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """docs and tokens for each source, language and tokenizer version that has any."""
        newest, folded = self._folded()
        parts = [f"{self.path}/batches/{b}" for b in self._folders("batches") if b not in folded]
        columns = [*KEYS, "docs", "tokens"]
        rows = self.spark.read.parquet(*parts).select(columns) if parts else None
        if newest:
            kept = self.spark.read.parquet(newest).where("docs is not null").select(columns)
            rows = kept if rows is None else rows.unionByName(kept)
        if rows is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; older folders may then be removed."""
        names = sorted(self.committed())
        if not names:
            return
        ids = F.array(*[F.lit(n) for n in names])
        marker = self.spark.range(1).select(*[F.lit(None).cast("string").alias(k) for k in KEYS], F.lit(None).cast("long").alias("docs"), F.lit(None).cast("long").alias("tokens"), ids.alias("batches"))
        rows = self.totals().withColumn("batches", F.array().cast("array<string>")).unionByName(marker)
        rows.write.mode("errorifexists").parquet(f"{self.path}/snapshots/{len(self._folders('snapshots')):08d}")
