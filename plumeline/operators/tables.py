"""Summaries, labels, official totals, covariates, and checks of what may be released."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, parsed_number, ratio
from .times import assert_unique


def file_summary(rows: DataFrame, file: str, value: str, others: list[str]) -> DataFrame:
    """For each file: rows, sums, shares of the whole, and distinct values of other columns as sorted text."""
    joined = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(f"{c}_values") for c in others]
    per = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"), *joined)
    whole = per.agg(F.sum("n_rows").alias("_n"), F.sum("total").alias("_t"))
    # one row
    both = per.crossJoin(F.broadcast(whole))
    return both.withColumn("row_share", ratio(F.col("n_rows"), F.col("_n"))).withColumn("total_share", ratio(F.col("total"), F.col("_t"))).drop("_n", "_t")


def utc_dates_used(rows: DataFrame, hour: list[str]) -> DataFrame:
    """The UTC dates behind each local hour, as text, and how many."""
    return rows.groupBy(*hour).agg(F.array_join(F.array_sort(F.collect_set("utc_date")), ",").alias("utc_dates"), F.countDistinct("utc_date").alias("n_utc_dates"))


def official_population(rows: DataFrame, name: str, text: str, regions: DataFrame) -> DataFrame:
    """Official totals as whole positive numbers, one for each region; an optional Total row must equal their sum."""
    parsed = rows.select(F.trim(name).alias(name), parsed_number(F.col(text)).alias("official_population"))
    total = parsed.where(F.lower(name) == "total").first()
    kept = assert_unique(parsed.where(F.lower(name) != "total"), [name])
    bad = kept.where(F.col("official_population").isNull() | (F.col("official_population") <= 0) | (F.col("official_population") % 1 != 0)).count()
    unknown = kept.join(regions, name, "left_anti").count() + regions.join(kept, name, "left_anti").count()
    if bad or unknown:
        raise ValueError(f"{bad} totals are not positive whole numbers; {unknown} names do not agree with the regions")
    whole = kept.agg(F.sum("official_population")).first()[0]
    if total is not None and total["official_population"] != whole:
        raise ValueError("the Total row differs from the sum of the regions")
    return kept.withColumn("official_population", F.col("official_population").cast("long"))


def code_labels(code: Column, labels: dict[int, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def covariate_source(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Means of finite values for each key rounded to four decimals."""
    rounded = [F.round(F.col(k).cast("double"), 4).alias(k) for k in keys]
    return df.select(*rounded, *[finite(F.col(f)).alias(f) for f in fields]).groupBy(*keys).agg(*[F.avg(f).alias(f) for f in fields])


def merge_source(base: DataFrame, source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """base with the source's fields; the source has one row for each key."""
    return base.join(assert_unique(source, keys).select(*keys, *fields), keys, "left")


def cleaned_inputs(df: DataFrame) -> DataFrame:
    """Negative values become null except in change columns; mean concentrations of zero or less become null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() not in ("double", "float", "integer", "long") or f.name.endswith("_change"):
            out.append(c)
        elif f.name.endswith("_mean_pm25"):
            out.append(F.when(c > 0, c).alias(f.name))
        else:
            out.append(F.when(c >= 0, c).alias(f.name))
    return df.select(*out)


def baseline_fields(df: DataFrame, with_extra: list[str], without: list[str], extra: str, least: float = 0.9) -> list[str]:
    """The wider list of fields where enough rows have the extra one, else the narrower."""
    share = df.agg(F.avg(F.col(extra).isNotNull().cast("int"))).first()[0]
    return with_extra if share is not None and share >= least else without


def supported(grid: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """All of the grid with values where there are some, and is_supported; keys that the grid lacks are an error."""
    unknown = values.join(grid, key, "left_anti").limit(1).count()
    if unknown:
        raise ValueError(f"values have a {key} that the grid lacks")
    return grid.join(values.withColumn("is_supported", F.lit(True)), key, "left").fillna(False, ["is_supported"])


def field_dictionary(df: DataFrame, suffix: str = "_change") -> DataFrame:
    """name and type of the columns with the suffix."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name.endswith(suffix)]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


# Columns that must not be released, and words of identifiers that must not.
SENSITIVE = (
    "population", "estimated_population", "hourly_population", "official_population_2018", "preliminary_population", "daily_population", "snapshot_population",
    "app_count", "pre_mean_count", "festival_mean_count", "post_mean_count", "festival_pre_count_change", "post_festival_count_change",
)
IDENTIFIED = ("device", "subscriber", "user", "trajectory", "individual", "person")


def is_sensitive(column: str) -> bool:
    """Whether a column is listed, or names someone's id or key: one of IDENTIFIED as a word of its own, followed by nothing, id or key."""
    name = column.lower()
    return name in SENSITIVE or re.search(rf"(?:^|_)(?:{'|'.join(IDENTIFIED)})_?(?:id|key)?(?:_|$)", name) is not None


def release_findings(schemas: dict[str, list[str]], sizes: dict[str, int], most_bytes: int = 50_000_000, blocked: tuple[str, ...] = (".nc", ".tif", ".shp", ".pkl", ".pickle", ".zip", ".7z", ".gz", ".bz2")) -> list[tuple[str, str]]:
    """(file, reason) for each file that is too large, of a blocked kind, or has a sensitive column."""
    out = []
    for name, size in sizes.items():
        if size > most_bytes:
            out.append((name, "too large"))
        if name.lower().endswith(blocked):
            out.append((name, "blocked suffix"))
        out += [(name, f"sensitive column {c}") for c in schemas.get(name, []) if is_sensitive(c)]
    return sorted(out)


def legacy_aliases(hourly: DataFrame) -> DataFrame:
    """The hourly grid with the older names of its columns beside the present ones."""
    old = {"date": "local_date", "hour": "local_hour", "total_count": "population", "total_exposure": "exposure", "weighted_pm25": "pm25"}
    return hourly.withColumns({name: F.col(c) for name, c in old.items()})


def comparison_of(name: Column) -> Column:
    """The comparison that a variable's name begins with; other where it is none."""
    out = F.lit("other")
    for comparison in ("post_festival", "festival_pre"):
        out = F.when(name.startswith(f"{comparison}_"), comparison).otherwise(out)
    return out


def scale_exponent(largest: Column) -> Column:
    """The power of ten to divide labels by: that of the largest absolute value if it is 4 or more either way, else 0."""
    power = F.floor(F.log10(largest)).cast("int")
    usable = (largest > 0) & (largest < float("inf"))
    return F.when(usable & (F.abs(power) >= 4), power).otherwise(0)


def union_means(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sources, columns that one lacks being null, and the mean of each column for each key."""
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[F.avg(c).alias(c) for c in rows.columns if c != key])


def unrecoverable_records(rows: DataFrame) -> DataFrame:
    """Audited rows whose time can't be recovered, with the decision; without any, an empty table of the same columns."""
    return rows.where("time_status = 'unrecoverable'").withColumn("is_used", F.lit(False))
