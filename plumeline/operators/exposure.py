"""Calibration to official totals, raster matching, snapshot, hourly, daily and period grids, and contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_origin, conic, conic_inverse, grid_id, nearest_index
from ..functions.scalar import finite, ratio
from .times import hour_quality, hour_weights


def reference_sums(points: DataFrame, time: str = "utc_time", region: str = "region", value: str = "cnt") -> DataFrame:
    """Sums for each time and region."""
    return points.groupBy(time, region).agg(F.sum(value).alias("app_count"))


def region_weights(sums: DataFrame, official: DataFrame, region: str = "region", time: str = "utc_time") -> DataFrame:
    """Official total over the median of each region's sums across times."""
    medians = sums.groupBy(region).agg(F.median("app_count").alias("reference_app_count"), F.countDistinct(time).alias("n_times"))
    # one row for each region on both sides
    return official.join(medians, region, "left").withColumn("expansion_weight", ratio(F.col("official_population"), F.col("reference_app_count")))


def time_scales(sums: DataFrame, weights: DataFrame, region: str = "region", time: str = "utc_time") -> DataFrame:
    """Each time's preliminary total and the factor that brings it to the official total."""
    total = weights.agg(F.sum("official_population").alias("official_total"))
    part = sums.join(weights.select(region, "expansion_weight"), region).groupBy(time).agg(F.sum(F.col("app_count") * F.col("expansion_weight")).alias("preliminary_total"))
    out = part.crossJoin(total).withColumn("scaling_factor", ratio(F.col("official_total"), F.col("preliminary_total")))
    error = F.col("preliminary_total") - F.col("official_total")
    return out.withColumn("absolute_error", error).withColumn("relative_error", ratio(error, F.col("official_total")))


def calibrate(points: DataFrame, weights: DataFrame, scales: DataFrame, region: str = "region", time: str = "utc_time") -> DataFrame:
    """Points with preliminary and estimated population.

    There is one weight for each region and one factor for each time, and both are sums of the points themselves,
    so the planner sees their size and picks the join.
    """
    both = points.join(weights.select(region, "expansion_weight"), region, "left").join(scales.select(time, "scaling_factor"), time, "left")
    preliminary = F.col("cnt") * F.col("expansion_weight")
    return both.withColumn("preliminary_population", preliminary).withColumn("estimated_population", preliminary * F.col("scaling_factor"))


def match_raster(points: DataFrame, raster: DataFrame, lat: str, lon: str, axes: tuple[float, float, float, int, int]) -> DataFrame:
    """Each point's nearest raster cell on its own UTC date; null outside the raster and where it has no data."""
    lat_start, lon_start, step, n_lat, n_lon = axes
    # from the first coordinate to the last: points beyond the outermost cell centres are outside
    inside = F.col(lat).between(lat_start, lat_start + step * (n_lat - 1)) & F.col(lon).between(lon_start, lon_start + step * (n_lon - 1))
    at = points.withColumn("lat_i", F.when(inside, nearest_index(lat, lat_start, step, n_lat))).withColumn("lon_i", F.when(inside, nearest_index(lon, lon_start, step, n_lon)))
    return at.join(raster.select("utc_date", "lat_i", "lon_i", finite(F.col("pm25")).alias("pm25")), ["utc_date", "lat_i", "lon_i"], "left")


def exposure(population: Column, pm25: Column) -> Column:
    return population.cast("double") * pm25.cast("double")


def snapshot_grid(points: DataFrame, lon: str = "lon", lat: str = "lat", time: str = "local_time") -> DataFrame:
    """Sums of population, app counts and the exposure of each, for each time and 10 km cell.

    Points without a raster value are left out first, so a cell that has none else is absent at that time.
    """
    x, y = conic(lon, lat)
    cells = points.where("pm25 is not null").withColumn("grid_x", cell_origin(x)).withColumn("grid_y", cell_origin(y))
    return cells.groupBy(time, "grid_x", "grid_y").agg(
        F.sum("estimated_population").alias("population"), F.sum("cnt").alias("app_count"),
        F.sum(exposure(F.col("estimated_population"), F.col("pm25"))).alias("exposure"), F.sum(exposure(F.col("cnt"), F.col("pm25"))).alias("app_exposure"),
    )


def hourly_grid(snapshots: DataFrame, values: list[str], time: str = "local_time", cap_minutes: int = 10, expected: int = 12, times: DataFrame | None = None) -> DataFrame:
    """Capped-duration weighted mean of each value for each hour and cell.

    The denominator is the weight of all times of the hour, less the times where the cell's own value is null:
    a cell that is absent at a time counts as zero there. times: all observed times, if snapshots lacks some.
    pm25 is the hour's population-weighted concentration where exposure and population are among the values.
    """
    weights = hour_weights(snapshots if times is None else times, time, cap_minutes)
    quality = hour_quality(weights, time, expected)
    joined = snapshots.join(weights.select(time, "hour_start", "weight_s"), time)
    sums = []
    for v in values:
        sums += [F.sum(F.col(v) * F.col("weight_s")).alias(f"_{v}"), F.sum(F.when(F.col(v).isNull(), F.col("weight_s")).otherwise(0)).alias(f"_{v}_void")]
    grid = joined.groupBy("hour_start", "grid_x", "grid_y").agg(*sums).join(quality, "hour_start")
    means = [ratio(F.col(f"_{v}"), F.col("covered_minutes") * 60 - F.col(f"_{v}_void")).alias(v) for v in values]
    out = grid.select("hour_start", "grid_x", "grid_y", *means, "sample_count", "coverage_ratio", "covered_minutes", "max_gap_minutes", "is_complete_hour", "method")
    return out.withColumn("pm25", ratio(F.col("exposure"), F.col("population"))) if {"exposure", "population"} <= set(values) else out


def covered_hours(hourly: DataFrame, minimum: float = 0.0, include_incomplete: bool = True) -> DataFrame:
    """Rows of hours with at least this share of their samples, or of complete hours only; a null share is left out."""
    keep = F.col("coverage_ratio") >= minimum
    return hourly.where(keep if include_incomplete else keep & F.col("is_complete_hour"))


def finite_hours(hourly: DataFrame, values: tuple[str, ...] = ("population", "exposure", "pm25")) -> DataFrame:
    """Rows whose values are all present and finite."""
    ok = F.lit(True)
    for v in values:
        ok = ok & finite(F.col(v)).isNotNull()
    return hourly.where(ok)


def add_cell_centres(grid: DataFrame) -> DataFrame:
    lon, lat = conic_inverse(F.col("grid_x") + 5000, F.col("grid_y") + 5000)
    return grid.withColumn("grid_id", grid_id("grid_x", "grid_y")).withColumn("grid_lon", lon).withColumn("grid_lat", lat)


def daily_grid(hourly: DataFrame, dates: DataFrame) -> DataFrame:
    """Sums of population and exposure, the mean of the hours' weighted pollutant, and coverage, for each cell and local date.

    dates: local_date, date_coverage and date_is_complete, one row for each date (see times.date_quality).
    """
    d = hourly.groupBy("grid_x", "grid_y", "local_date").agg(
        F.sum("population").alias("population"), F.sum("exposure").alias("exposure"), F.avg("pm25").alias("pm25"),
        F.countDistinct("local_hour").alias("n_hours"), F.sum(F.col("is_complete_hour").cast("int")).alias("n_complete_hours"),
        F.avg("coverage_ratio").alias("mean_coverage"), F.min("coverage_ratio").alias("min_coverage"), F.sum("covered_minutes").alias("covered_minutes"),
    )
    weighted = F.when(F.col("population") > 0, F.col("exposure") / F.col("population"))
    return d.withColumn("weighted_pm25", weighted).join(dates.select("local_date", "date_coverage", "date_is_complete"), "local_date", "left")


def period_label(day: Column, periods: list[tuple[str, str, str]], strict: bool = False) -> Column:
    """The period whose bounds, both included, hold the day; null (or an error) outside all."""
    out = F.lit(None).cast("string")
    for name, start, end in periods:
        out = F.when(day.between(start, end), name).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no period holds "), day)).cast("string")) if strict else out


def period_grid(daily: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Means over the days present, for each cell and period, coverage, and whether one of the cell's dates lacks times."""
    labelled = daily.withColumn("period", period_label(F.col("local_date"), periods)).where("period is not null")
    length = F.lit(0)
    for name, start, end in periods:
        length = F.when(F.col("period") == name, F.datediff(F.lit(end), F.lit(start)) + 1).otherwise(length)
    p = labelled.groupBy("grid_x", "grid_y", "period").agg(
        F.avg("population").alias("population"), F.avg("exposure").alias("exposure"), F.avg("pm25").alias("pm25"), F.avg("weighted_pm25").alias("weighted_pm25"),
        F.countDistinct("local_date").alias("n_days"), F.sum("n_hours").alias("n_hours"), F.sum("n_complete_hours").alias("n_complete_hours"),
        F.avg("mean_coverage").alias("mean_coverage"), F.min("min_coverage").alias("min_coverage"), F.avg("date_coverage").alias("mean_date_coverage"),
        (~F.bool_and(F.coalesce("date_is_complete", F.lit(False)))).alias("has_incomplete_date"),
    )
    return p.withColumn("day_share", F.col("n_days") / length).withColumn("hour_share", F.col("n_hours") / (length * 24))


def wide_periods(period: DataFrame, values: list[str], names: list[str]) -> DataFrame:
    """One row for each cell, with a column for each period and value: a full outer join of the periods, in one shuffle."""
    aggregates = [F.max(F.when(F.col("period") == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values]
    return period.groupBy("grid_x", "grid_y").agg(*aggregates)


def changes(wide: DataFrame, values: list[str], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """comparison - baseline of each value for each (name, baseline, comparison); null where either is."""
    return wide.select("*", *[(F.col(f"{after}_{v}") - F.col(f"{before}_{v}")).alias(f"{name}_{v}_change") for name, before, after in pairs for v in values])


def valid_for_contrast(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows where population is present and not negative and concentration present and positive."""
    ok = F.lit(True)
    for population, concentration in pairs:
        ok = ok & (F.col(population) >= 0) & (F.col(concentration) > 0)
    return df.where(ok)


def contrast(df: DataFrame, name: str, p0: str, c0: str, p1: str, c1: str) -> DataFrame:
    """The exact three-term decomposition of p1*c1 - p0*c0, their sum, the total and its error."""
    dp, dc = F.col(p1) - F.col(p0), F.col(c1) - F.col(c0)
    mobility, pollution, interaction = F.col(c0) * dp, F.col(p0) * dc, dp * dc
    total = F.col(p1) * F.col(c1) - F.col(p0) * F.col(c0)
    return df.withColumns(
        {
            f"{name}_mobility": mobility, f"{name}_pollution": pollution, f"{name}_interaction": interaction,
            f"{name}_sum": mobility + pollution + interaction, f"{name}_total": total, f"{name}_error": mobility + pollution + interaction - total,
        }
    )


def identity_holds(df: DataFrame, name: str) -> DataFrame:
    """The largest error and whether it is within rounding of the largest total."""
    worst, scale = F.max(F.abs(f"{name}_error")), F.max(F.abs(f"{name}_total"))
    return df.agg(worst.alias("max_error"), scale.alias("scale")).withColumn("holds", F.col("max_error") <= F.greatest(F.lit(1e-8), F.col("scale") * 1e-10))


def unpivoted(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    return df.unpivot(keys or [], columns, "component", "value")


def contribution_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    v = F.col("value")
    return unpivoted(df, columns).groupBy("component").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("total"), F.sum(F.abs(v)).alias("abs_total"), F.avg(F.abs(v)).alias("mean_abs"),
        F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"),
    )


def grouped_totals(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A national row (null group) over all rows, and a row for each group; rows without a group count in the first only."""
    sums = [F.sum(c).alias(c) for c in columns]
    national = F.grouping(group) == 1
    both = df.groupingSets([[], [group]], group).agg(*sums, F.count(F.lit(1)).alias("n"), national.alias("is_national"))
    return both.where(F.col(group).isNotNull() | F.col("is_national"))
