"""Gates, flags, distributions, calendars of what is missing, and assertions between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import close, day_text, finite, ratio


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass; a rule that is null is broken."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, after a check that no row breaks a rule."""
    broken = {k: v for k, v in violations(df, rules).first().asDict().items() if v}
    if broken:
        raise ValueError(f"rows break rules: {broken}")
    return df


def spatial_gate(points: DataFrame, matched: Column, value: str = "cnt", most: float = 0.01) -> DataFrame:
    """Records and counts that are matched and not, their shares, and whether the gate is passed."""
    g = points.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(matched).alias("matched_records"), F.count_if(~matched).alias("unmatched_records"),
        F.coalesce(F.sum(value), F.lit(0)).alias("app_count"), F.coalesce(F.sum(F.when(~matched, F.col(value))), F.lit(0)).alias("unmatched_app_count"),
    )
    share = ratio(F.col("unmatched_records"), F.col("records"))
    return g.withColumn("unmatched_share", share).withColumn("passes", F.coalesce(share <= most, F.lit(False)))


def anomaly_flags(df: DataFrame, value: str, key: str) -> DataFrame:
    """Thresholds six scaled MADs from the median (with a MAD of zero, a quarter and four times it), and what lies below or above; the lower is never negative."""
    median = df.agg(F.median(value).alias("median"))
    with_median = df.select(key, value).crossJoin(F.broadcast(median))
    mad = with_median.agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    # one row each
    both = with_median.crossJoin(F.broadcast(mad))
    m, spread = F.col("median"), 6 * 1.4826 * F.col("mad")
    low = F.greatest(F.lit(0.0), F.when(F.col("mad") > 0, m - spread).otherwise(m * 0.25))
    high = F.when(F.col("mad") > 0, m + spread).otherwise(m * 4)
    marked = both.withColumn("low_threshold", low).withColumn("high_threshold", high)
    return marked.withColumn("is_low", F.col(value) < F.col("low_threshold")).withColumn("is_high", F.col(value) > F.col("high_threshold"))


def hour_checks(hourly: DataFrame) -> DataFrame:
    """How many rows of an hourly grid break each rule, and how many repeat a key; all zero for a sound grid."""
    values = [F.col(c) for c in ("population", "exposure", "pm25")]
    finite_all, positive = F.lit(True), F.lit(True)
    for v in values:
        finite_all, positive = finite_all & finite(v).isNotNull(), positive & (v >= 0)
    quotient = F.col("exposure") / F.when(F.col("population") > 0, F.col("population"))
    rules = {
        "time_agrees": (F.hour("hour_start") == F.col("local_hour")) & (day_text(F.col("hour_start")) == F.col("local_date")),
        "finite": finite_all, "not_negative": positive, "ratio_agrees": F.coalesce(close(F.col("pm25"), quotient), F.lit(True)),
    }
    # keys are counted by groups, so that no task holds them all
    keys = hourly.groupBy("hour_start", "grid_x", "grid_y").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"))
    return violations(hourly, rules).crossJoin(F.broadcast(keys))


def infinite_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_present and n_infinite (of either sign) of each field."""
    infinite = lambda c: F.abs(F.col(c).cast("double")) == F.lit(float("inf"))
    wide = df.agg(*[F.struct(F.count(c).alias("p"), F.count_if(infinite(c)).alias("i")).alias(c) for c in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}.p").alias("n_present"), F.col(f"{c}.i").alias("n_infinite")) for c in fields])).alias("x")).select("x.*")


def reconciliation(expected: DataFrame, found: DataFrame) -> DataFrame:
    """measure, expected, found and agrees, for the columns of two tables of one row each."""
    names = expected.columns
    both = expected.select(F.struct("*").alias("a")).crossJoin(F.broadcast(found.select(F.struct(*names).alias("b"))))
    rows = [F.struct(F.lit(c).alias("measure"), F.col(f"a.{c}").cast("double").alias("expected"), F.col(f"b.{c}").cast("double").alias("found"), F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias("agrees")) for c in names]
    return both.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def read_back_checks(points: DataFrame, hours: int = 8) -> DataFrame:
    """How many calibrated points break each rule when they are read again; all zero for sound output."""
    estimate = F.col("estimated_population")
    rules = {
        "local_offset": F.unix_timestamp("local_time") - F.unix_timestamp("utc_time") == hours * 3600,
        "local_partition": day_text(F.col("local_time")) == F.col("local_date"), "utc_partition": day_text(F.col("utc_time")) == F.col("utc_date"),
        "count_present": F.col("cnt") >= 0, "estimate_present": estimate.isNotNull(), "estimate_not_negative": F.coalesce(estimate >= 0, F.lit(True)),
        "region_present": F.col("region").isNotNull(), "zero_stays_zero": F.coalesce((F.col("cnt") != 0) | (estimate == 0), F.lit(True)),
    }
    return violations(points, rules)


def read_back_totals(points: DataFrame, day: str, region: str) -> DataFrame:
    """Records, counts and population by day and region, by day, and over all (nulls where a row spans all)."""
    sums = [F.count(F.lit(1)).alias("records"), F.sum("cnt").alias("app_count"), F.sum("estimated_population").alias("population")]
    return points.groupingSets([[day, region], [day], []], day, region).agg(*sums)


def distribution(df: DataFrame, value: str) -> DataFrame:
    """n, mean, sd, and percentiles by linear interpolation."""
    points = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    q = F.percentile(value, F.array(*[F.lit(p) for p in points]))
    out = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"))
    return out.select("n", "min", "max", "mean", "sd", *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(points)])


def value_diagnostics(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.98), F.lit(0.99)))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_present"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"), F.avg((v == 0).cast("int")).alias("zero_share"))
    return out.select("n", "n_present", "min", "max", *[F.col("q")[i].alias(c) for i, c in enumerate(("median", "p95", "p98", "p99"))], "zero_share")


def robust_limits(df: DataFrame, columns: list[str], diverging: bool, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentile limits pooled over columns, symmetric about zero if diverging; and how many values lie beyond."""
    pooled = df.unpivot([], columns, "name", "value").where("value is not null")
    limits = pooled.agg(F.percentile("value", F.lit(low)).alias("lo"), F.percentile("value", F.lit(high)).alias("hi"))
    if diverging:
        reach = F.greatest(F.abs("lo"), F.abs("hi"))
        limits = limits.select((-reach).alias("lo"), reach.alias("hi"))
    beyond = pooled.crossJoin(F.broadcast(limits)).groupBy("lo", "hi").agg(F.count_if(F.col("value") < F.col("lo")).alias("n_below"), F.count_if(F.col("value") > F.col("hi")).alias("n_above"))
    kind = F.when((F.col("n_below") > 0) & (F.col("n_above") > 0), "both").when(F.col("n_below") > 0, "min").when(F.col("n_above") > 0, "max").otherwise("neither")
    return beyond.withColumn("extend", kind)


def weight_flags(weights: DataFrame, value: str) -> DataFrame:
    """Low and high tenths, and outliers of the logarithm beyond 1.5 interquartile ranges."""
    ln = F.log(value)
    limits = weights.agg(F.percentile(value, F.lit(0.1)).alias("q10"), F.percentile(value, F.lit(0.9)).alias("q90"), F.percentile(ln, F.lit(0.25)).alias("l25"), F.percentile(ln, F.lit(0.75)).alias("l75"))
    both = weights.crossJoin(F.broadcast(limits))
    iqr = F.col("l75") - F.col("l25")
    out = (ln < F.col("l25") - 1.5 * iqr) | (ln > F.col("l75") + 1.5 * iqr)
    return both.withColumn("is_low", F.col(value) <= F.col("q10")).withColumn("is_high", F.col(value) >= F.col("q90")).withColumn("is_log_outlier", out).drop("q10", "q90", "l25", "l75")


def ranked(df: DataFrame, value: str, partition: list[str] | None = None) -> DataFrame:
    """Dense rank, largest first."""
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*(partition or [])).orderBy(F.desc(value))))


def share_of_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.withColumn("group_share", ratio(F.col(value), F.sum(value).over(Window.partitionBy(group))))


def counts_by_category(df: DataFrame, column: str, categories: list[str], by: str | None = None) -> DataFrame:
    """Counts and shares over a fixed list of categories, those without rows included (for each group, if given)."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(c,) for c in categories], f"{column} string")
    keys = [column] if by is None else [by, column]
    if by is not None:
        wanted = df.select(by).distinct().crossJoin(F.broadcast(wanted))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = wanted.join(counts, keys, "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(by if by is not None else F.lit(0)))
    return out.withColumn("share", ratio(F.col("n"), total))


def same_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """value and side of what only one table has; no rows mean that the sets agree."""
    one, two = a.select(F.col(column).alias("value")).distinct(), b.select(F.col(column).alias("value")).distinct()
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("right")))


def compare_tables(old: DataFrame, new: DataFrame, key: str, columns: list[str], rtol: float = 1e-7, atol: float = 1e-6) -> DataFrame:
    """Each column's largest difference over shared keys, and whether all are within tolerance."""
    pairs = old.select(key, *[F.col(c).alias(f"{c}_old") for c in columns]).join(new.select(key, *[F.col(c).alias(f"{c}_new") for c in columns]), key)
    aggregates = [F.struct(F.max(F.abs(F.col(f"{c}_new") - F.col(f"{c}_old"))).alias("d"), F.bool_and(close(F.col(f"{c}_new"), F.col(f"{c}_old"), rtol, atol)).alias("ok")).alias(c) for c in columns]
    wide = pairs.agg(*aggregates)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}.d").alias("max_difference"), F.col(f"{c}.ok").alias("within")) for c in columns])).alias("x")).select("x.*")


def duplicate_scan(points: DataFrame, time: str, coordinate: list[str], value: str) -> DataFrame:
    """For each time: rows, repeated coordinates, and repeated coordinates with the same value."""
    return points.groupBy(time).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.countDistinct(*coordinate)).alias("repeated_coordinates"),
        (F.count(F.lit(1)) - F.countDistinct(*coordinate, value)).alias("repeated_records"),
    )


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_present and share for each field."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("n"), *[F.count(f).alias(f) for f in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_present"), ratio(F.col(f), F.col("n")).alias("share")) for f in fields])).alias("x")).select("x.*")


def complete_cases(df: DataFrame, fields: list[str], least_rows: int = 100, least_share: float = 0.5) -> DataFrame:
    total, kept = df.count(), df.dropna(subset=fields)
    n = kept.count()
    if n < least_rows or n < least_share * total:
        raise ValueError(f"{n} of {total} rows are complete")
    return kept


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 2018) -> DataFrame:
    """n rows without replacement, the same for the same key and seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def evenly_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows at equal steps of their order by key, both ends included; nulls come last."""
    total = df.count()
    if total <= n:
        return df
    # positions come from counts of key ranges, so no task orders all rows. The ranges' bounds are values, taken once:
    # Spark's own range partitioning draws new ones for each job, and counts of one job don't fit the rows of the next
    drawn = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).orderBy(F.xxhash64("k", F.monotonically_increasing_id())).limit(5_000)
    held = [r["k"] for r in drawn.distinct().orderBy("k").collect()]
    ranges = min(256, total // 50_000 + 1, len(held))
    bounds = [held[len(held) * i // ranges] for i in range(1, ranges)]

    def range_of(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(key) < F.lit(bounds[middle]), range_of(low, middle)).otherwise(range_of(middle + 1, high))

    parts = df.withColumn("_p", range_of(0, len(bounds)))
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    wanted = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 else [0]
    # only ranges that hold a wanted position are ordered; nulls fall into the last one
    some = [p for p in starts if any(starts[p] <= at < starts[p] + sizes[p] for at in wanted)]
    start = F.element_at(F.create_map(*[F.lit(x) for p in some for x in (p, starts[p])]), F.col("_p"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(key).asc_nulls_last()))
    return parts.where(F.col("_p").isin(some)).withColumn("_at", start + place - 1).where(F.col("_at").isin(wanted)).drop("_p", "_at")
