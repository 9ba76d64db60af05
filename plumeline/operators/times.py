"""Times: repair of blank ones, calendars, gaps, hour weights and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_text, shifted_hours

KEY = ["source_date", "source_file", "line_no"]
DAY_FORMAT = "yyyy-MM-dd HH:mm:ss"


def is_blank(c: str = "time") -> Column:
    return F.trim(c) == ""


def parsed(c: str = "time") -> Column:
    return F.try_to_timestamp(F.col(c), F.lit(DAY_FORMAT))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that no two rows share the keys."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"rows share {', '.join(keys)}")
    return df


def with_audit(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Each row's parsed time, or its audited one; time_status is parsed, recovered, unrecoverable or unaudited."""
    found = audit.select(*KEY, "is_recoverable", "recovered_utc_time")
    both = rows.withColumn("_parsed", parsed()).join(found, KEY, "left")
    status = (
        F.when(F.col("_parsed").isNotNull(), "parsed")
        .when(F.col("is_recoverable").isNull(), "unaudited")
        .when(F.col("is_recoverable"), "recovered")
        .otherwise("unrecoverable")
    )
    return both.withColumn("time_status", status).withColumn("utc_time", F.coalesce("_parsed", "recovered_utc_time")).drop("_parsed", "is_recoverable", "recovered_utc_time")


def add_local(rows: DataFrame, hours: int = 8) -> DataFrame:
    local = shifted_hours(F.col("utc_time"), hours)
    return rows.withColumns(
        {"utc_date": day_text(F.col("utc_time")), "utc_hour": F.hour("utc_time"), "local_time": local, "local_date": day_text(local), "local_hour": F.hour(local)}
    )


def repair(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows with a valid or recovered time, with UTC and local columns."""
    return add_local(with_audit(rows, audit).where("time_status in ('parsed', 'recovered')"))


def blank_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where(is_blank()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("blank_records"), F.sum("cnt").alias("app_count_sum"),
        F.min("lat_raw").alias("lat_min"), F.max("lat_raw").alias("lat_max"), F.min("lon_raw").alias("lon_min"), F.max("lon_raw").alias("lon_max"),
    )


def in_range(c: str, start: str, end: str) -> Column:
    """Half-open: start <= c < end."""
    return (F.col(c) >= F.lit(start).cast("timestamp")) & (F.col(c) < F.lit(end).cast("timestamp"))


def expected_times(spark, start: str, end: str, minutes: int = 5) -> DataFrame:
    """All times from start to before end at a fixed cadence, made in parallel."""
    first = F.lit(start).cast("timestamp")
    n = spark.sql(f"select (unix_timestamp(timestamp'{end}') - unix_timestamp(timestamp'{start}')) div {60 * minutes} as n").first()[0]
    return spark.range(n).select(F.timestamp_seconds(F.unix_timestamp(first) + F.col("id") * (60 * minutes)).alias("expected_time"))


def missing_times(expected: DataFrame, observed: DataFrame, column: str = "local_time") -> DataFrame:
    return expected.join(observed.select(F.col(column).alias("expected_time")).distinct(), "expected_time", "left_anti")


def gap_islands(missing: DataFrame, day: Column, minutes: int = 5) -> DataFrame:
    """day and missing_intervals: runs of missing times as HH:mm-HH:mm, joined by ' | '."""
    rows = missing.select(day.alias("day"), F.col("expected_time").alias("t"))
    order = Window.partitionBy("day").orderBy("t")
    new = (F.unix_timestamp("t") - F.unix_timestamp(F.lag("t").over(order)) != 60 * minutes).cast("int")
    runs = rows.withColumn("_run", F.sum(F.coalesce(new, F.lit(1))).over(order)).groupBy("day", "_run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    text = F.concat(F.date_format("a", "HH:mm"), F.lit("-"), F.date_format("b", "HH:mm"))
    return runs.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(text)), " | ").alias("missing_intervals"))


def cadence_minutes(times: DataFrame, column: str, default: int = 60) -> DataFrame:
    """The most frequent positive gap between successive distinct times; the smallest of equals.

    The gap is taken within each day and across its end, so no task orders all times: days are windows,
    and each day's first time is compared with the last of the day before it.
    """
    t = times.select(F.col(column).alias("t")).distinct().withColumn("d", F.to_date("t"))
    inside = t.withColumn("gap", (F.unix_timestamp("t") - F.unix_timestamp(F.lag("t").over(Window.partitionBy("d").orderBy("t")))) / 60)
    ends = t.groupBy("d").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    across = ends.withColumn("gap", (F.unix_timestamp("a") - F.unix_timestamp(F.lag("b").over(Window.orderBy("d")))) / 60)
    gaps = inside.select("gap").unionByName(across.select("gap")).where("gap > 0")
    best = gaps.groupBy("gap").count().orderBy(F.desc("count"), "gap").limit(1)
    return best.agg(F.coalesce(F.max("gap"), F.lit(float(default))).alias("cadence_minutes"))


def hour_weights(times: DataFrame, column: str = "local_time", cap_minutes: int = 10) -> DataFrame:
    """Each distinct time's hour and forward duration in seconds: to the next time or the hour's end, capped."""
    t = times.select(F.col(column).alias("t")).distinct().withColumn("hour_start", F.date_trunc("hour", "t"))
    own = Window.partitionBy("hour_start").orderBy("t")
    seconds, end = F.unix_timestamp("t"), F.unix_timestamp("hour_start") + 3600
    following = F.least(F.coalesce(F.unix_timestamp(F.lead("t").over(own)), end), end)
    weight = F.least(F.greatest(following - seconds, F.lit(0)), F.lit(cap_minutes * 60))
    before = F.coalesce(seconds - F.unix_timestamp(F.lag("t").over(own)), seconds - F.unix_timestamp("hour_start"))
    return t.select("hour_start", F.col("t").alias(column), weight.alias("weight_s"), F.greatest(before, F.when(F.lead("t").over(own).isNull(), end - seconds)).alias("gap_s"))


def hour_quality(weights: DataFrame, column: str = "local_time", expected: int = 12) -> DataFrame:
    """One row for each observed hour: samples, coverage, covered minutes, largest gap, and the method."""
    q = weights.groupBy("hour_start").agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("weight_s").alias("covered_s"), F.max("gap_s").alias("max_gap_s"),
        F.min(column).alias("first_time"), F.max(column).alias("last_time"), F.min("weight_s").alias("_low"), F.max("weight_s").alias("_high"),
    )
    complete = F.col("sample_count") == expected
    regular = complete & (F.col("_low") == 300) & (F.col("_high") == 300)
    return q.select(
        "hour_start", "sample_count", (F.col("sample_count") / expected).alias("coverage_ratio"), (F.col("covered_s") / 60).alias("covered_minutes"),
        (F.col("max_gap_s") / 60).alias("max_gap_minutes"), complete.alias("is_complete_hour"),
        F.when(regular, "arithmetic_mean_regular_complete").otherwise("time_weighted_forward_duration_capped").alias("method"), "first_time", "last_time",
    )


def hour_coverage(rows: DataFrame, day: str = "local_date", hour: str = "local_hour") -> DataFrame:
    """Each day's rows, hours present and the list of hours that lack."""
    per = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set(hour).alias("_hours"))
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(23)), F.col("_hours"))
    return per.select(day, "n_rows", F.size("_hours").alias("n_hours"), F.array_join(F.array_sort(lacking).cast("array<string>"), ",").alias("missing_hours"))


def day_completeness(spark, rows: DataFrame, start: str, end: str, column: str = "local_time") -> DataFrame:
    """Each calendar day's expected, available and missing five-minute times, with the gaps as text."""
    expected = expected_times(spark, start, end)
    seen = rows.select(F.col(column).alias("t")).distinct().groupBy(day_text(F.col("t")).alias("day")).agg(F.count(F.lit(1)).alias("available"), F.min("t").alias("first_time"), F.max("t").alias("last_time"))
    calendar = expected.select(day_text(F.col("expected_time")).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("expected"))
    gaps = gap_islands(missing_times(expected, rows, column), day_text(F.col("expected_time")))
    out = calendar.join(seen, "day", "left").join(gaps, "day", "left").fillna(0, ["available"]).fillna("", ["missing_intervals"])
    return out.select("day", "expected", "available", (F.col("expected") - F.col("available")).alias("missing"), (F.col("available") / F.col("expected")).alias("coverage_ratio"), "first_time", "last_time", "missing_intervals", (F.col("available") == F.col("expected")).alias("is_complete"))


def date_quality(times: DataFrame, column: str = "local_time", expected: int = 288) -> DataFrame:
    """Each local date's distinct times, their share of those expected, and whether none lacks."""
    t = times.select(F.col(column).alias("t")).distinct().groupBy(day_text(F.col("t")).alias("local_date")).agg(F.count(F.lit(1)).alias("available"))
    return t.select("local_date", "available", (F.col("available") / expected).alias("date_coverage"), (F.col("available") == expected).alias("date_is_complete"))


def order_inversions(rows: DataFrame, file: str, position: str, column: str) -> DataFrame:
    """How many rows of each file come before the row that precedes them."""
    back = F.col(column) < F.lag(column).over(Window.partitionBy(file).orderBy(position))
    return rows.withColumn("_back", F.coalesce(back, F.lit(False)).cast("int")).groupBy(file).agg(F.sum("_back").alias("inversions"))


def local_hour_coverage(utc_hours: DataFrame, hours: int = 8) -> DataFrame:
    """From distinct (utc_date, utc_hour) that have data: each local date's hours present and the list of those that lack."""
    at = F.unix_timestamp(F.concat_ws(" ", "utc_date", F.lpad(F.col("utc_hour").cast("string"), 2, "0")), "yyyy-MM-dd HH")
    local = F.timestamp_seconds(at + hours * 3600)
    return hour_coverage(utc_hours.select(day_text(local).alias("local_date"), F.hour(local).alias("local_hour")).distinct()).drop("n_rows")
