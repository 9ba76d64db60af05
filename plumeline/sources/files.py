"""Files: dated scans, readers and writers by suffix, exact raw lines, Parquet footers, write policies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATED = re.compile(r"(\d{4}-\d{2}-\d{2})\.parquet$")


def hadoop_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def days(start: str, end: str) -> list[str]:
    """ISO dates from start to end, both included."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if b < a:
        raise ValueError(f"{end} is before {start}")
    return [(a + timedelta(n)).isoformat() for n in range((b - a).days + 1)]


def input_days(start: str, end: str, basis: str = "utc", offset_hours: int = 8) -> list[str]:
    """UTC dates of files to open: one day more on each side for a UTC basis, the day before for a local one."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if basis == "utc":
        return days((a - timedelta(1)).isoformat(), (b + timedelta(1)).isoformat())
    if basis == "local":
        return days((a - timedelta(1)).isoformat(), b.isoformat())
    raise ValueError(f"date basis must be utc or local, not {basis}")


def dated_scan(spark: SparkSession, folder: str, start: str, end: str, columns: list[str] | None = None) -> tuple[DataFrame | None, list[str], list[str]]:
    """Rows of the dated files in the range (with file_date), missing dates, and dates outside the range."""
    there = {m[1]: n for n in hadoop_names(spark, folder) if (m := DATED.search(n))}
    wanted = days(start, end)
    paths = [f"{folder}/{there[d]}" for d in wanted if d in there]
    rows = spark.read.parquet(*paths) if paths else None
    if rows is not None:
        rows = rows.select(*(columns or rows.columns), F.regexp_extract(F.col("_metadata.file_name"), DATED.pattern, 1).alias("file_date"))
    return rows, [d for d in wanted if d not in there], sorted(set(there) - set(wanted))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV (with header) or Parquet, by suffix."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        return (reader.schema(schema) if schema else reader).csv(path)
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported suffix: {path}")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    elif path.endswith((".parquet", ".pq")):
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported suffix: {path}")


def write_by_day(df: DataFrame, path: str, day: str = "local_date") -> None:
    """One partition for each local day; only the days in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def outputs_missing(spark: SparkSession, paths: list[str], overwrite: bool = False) -> bool:
    """Whether to compute: True if none is there (or overwrite), False if all are; a mixed set is an error."""
    there = [p for p in paths if exists(spark, p)]
    if overwrite or not there:
        return True
    if len(there) == len(paths):
        return False
    raise FileExistsError(f"some outputs exist and some do not: {there}")


def cached_distinct(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    if outputs_missing(spark, [path], overwrite):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest_per_key(stored: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """A manifest with added rows in place of stored ones of the same key."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(added.withColumn("_age", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_age"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_age")


def exact_lines(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """source_file, line_no, line and line_status for each wanted (source_file, line_no), lines counted from 1."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")
    files = texts.select("source_file").distinct()
    lines = texts.join(wanted.select("source_file").distinct(), "source_file", "left_semi").select("source_file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    lines = lines.select("source_file", (F.col("at") + 1).alias("line_no"), "line")
    found = wanted.join(files.withColumn("_file", F.lit(True)), "source_file", "left").join(lines, ["source_file", "line_no"], "left")
    stamp = F.trim(F.split(F.col("line"), ";", 2)[0])
    status = (
        F.when(F.col("_file").isNull(), "missing_file")
        .when(F.col("line").isNull(), "missing_line")
        .when(~F.col("line").contains(";"), "no_separator")
        .when(stamp == "", "blank_time")
        .when(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).isNull(), "unparseable_time")
        .otherwise("valid_time")
    )
    return found.select("source_file", "line_no", "line", status.alias("line_status"))


def footer_statistics(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """path, row_group, column_name, n_rows, null_count, min_text and max_text from Parquet footers.

    The bytes come through Spark's own reader, so any store works; a file is read by one task.
    """
    schema = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("column_name", pa.string()), ("n_rows", pa.int64()), ("null_count", pa.int64()), ("min_text", pa.string()), ("max_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                meta = pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        if column.path_in_schema in columns:
                            s = column.statistics
                            known = s is not None and s.has_min_max
                            rows.append((path, g, column.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, str(s.min) if known else None, str(s.max) if known else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 7, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, row_group int, column_name string, n_rows long, null_count long, min_text string, max_text string")


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
