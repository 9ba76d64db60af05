"""Logical inputs derived from the test tables, by integer arithmetic, so that SQL gives the same rows.

Nothing in the test tables has coordinates, regions, rasters or blank times; each view says how it makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import day_text, floor_minutes, shifted_hours, time_text

#: The test raster: a regular axis in each direction.
LAT_START, LON_START, STEP, N_LAT, N_LON = 18.0, 78.0, 0.5, 57, 99
#: Period bounds (local dates, both included).
PERIODS = [("pre", "2024-01-01", "2024-01-10"), ("festival", "2024-01-11", "2024-01-17"), ("post", "2024-01-18", "2024-01-30")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point counts: event_id, source_date, source_file, line_no, time ('' where blank), utc_true, cnt, lat_raw, lon_raw, region."""
    e = table(spark, sf_dir, "events")
    at = floor_minutes(F.col("ts"), 5)
    return e.select(
        "event_id",
        day_text(F.col("ts").cast("timestamp")).alias("source_date"),
        F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string")).alias("source_file"),
        F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 97 == 0, "").otherwise(time_text(at)).alias("time"),
        at.alias("utc_true"),
        F.floor("value").cast("long").alias("cnt"),
        (2000 + (F.col("user_id") * 7919) % 2500).cast("int").alias("lat_raw"),
        (8000 + (F.col("user_id") * 10007) % 4500).cast("int").alias("lon_raw"),
        (F.col("user_id") % 25).cast("int").alias("region"),
    )


def blank_time_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each blank time: its key, whether it is recoverable, and the recovered time."""
    o = observations(spark, sf_dir).where("event_id % 97 = 0")
    good = F.col("event_id") % 194 == 0
    return o.select("source_date", "source_file", "line_no", good.alias("is_recoverable"), F.when(good, F.col("utc_true")).alias("recovered_utc_time"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their UTC and local times; unrecoverable ones are left out."""
    from ..operators.times import repair

    o = observations(spark, sf_dir).drop("utc_true")
    return repair(o, blank_time_audit(spark, sf_dir))


def official_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, region_name and official_population."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("region"), F.col("n_name").alias("region_name"), (F.lit(1_000_000) * (F.col("n_nationkey") + 1)).cast("long").alias("official_population"))


def raster(spark: SparkSession) -> DataFrame:
    """utc_date, lat_i, lon_i and pm25 (null where there is no data) for each day of January 2024."""
    day = spark.range(1, 32).select(F.col("id").cast("int").alias("day"))
    cells = spark.range(N_LAT * N_LON).select(F.floor(F.col("id") / N_LON).cast("int").alias("lat_i"), (F.col("id") % N_LON).cast("int").alias("lon_i"))
    value = 20 + ((F.col("lat_i") * 31 + F.col("lon_i") * 17 + F.col("day") * 7) % 100) / 2.0
    # 31 days of a raster of fixed size
    return cells.crossJoin(F.broadcast(day)).select(
        F.concat(F.lit("2024-01-"), F.lpad(F.col("day").cast("string"), 2, "0")).alias("utc_date"), "lat_i", "lon_i",
        F.when((F.col("lat_i") + F.col("lon_i")) % 11 != 0, value).alias("pm25"),
    )


def local_columns(utc: str = "utc_time") -> list:
    local = shifted_hours(F.col(utc))
    return [
        F.col(utc), day_text(F.col(utc)).alias("utc_date"), F.hour(utc).cast("int").alias("utc_hour"),
        local.alias("local_time"), day_text(local).alias("local_date"), F.hour(local).cast("int").alias("local_hour"),
    ]
