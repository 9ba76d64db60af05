"""Hourly sums and means over a stream of snapshots, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import shifted_hours


def hourly_sums(points: DataFrame, late: str = "30 minutes", time: str = "utc_time", value: str = "cnt") -> DataFrame:
    """Sum and samples for each local hour and region; an hour is emitted once the watermark has passed it."""
    local = points.withColumn("local_time", shifted_hours(F.col(time))).withWatermark("local_time", late)
    return local.groupBy(F.window("local_time", "1 hour").alias("w"), "region").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("samples")).select(F.col("w.start").alias("hour_start"), "region", "total", "samples")


def upsert_hours(points: DataFrame, path: str, checkpoint: str, recompute, hour: str = "hour_start") -> StreamingQuery:
    """Recompute the hours that each batch touches and replace their partitions.

    The forward duration of a snapshot needs the next one, so touched hours are computed again from all of their
    snapshots: recompute(spark, hours) returns them with the hour column.
    """

    def apply(batch: DataFrame, _: int) -> None:
        hours = batch.select(F.date_trunc("hour", shifted_hours(F.col("utc_time"))).alias(hour)).distinct()
        out = recompute(batch.sparkSession, hours)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(hour).parquet(path)

    return points.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
