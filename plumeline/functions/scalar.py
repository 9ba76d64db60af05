"""Null-safe numbers, booleans and local times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parsed_number(c: Column) -> Column:
    """A number from text with thousands separators and spaces; null where it isn't one."""
    return finite(F.regexp_replace(c, "[, ]", "").try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def close(a: Column, b: Column, rtol: float = 1e-8, atol: float = 1e-10) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def sum_present(*columns: Column) -> Column:
    """The sum of what is present; null where nothing is."""
    total = sum((F.coalesce(c, F.lit(0)) for c in columns), F.lit(0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def floor_minutes(ts: Column, minutes: int) -> Column:
    seconds = minutes * 60
    return F.timestamp_seconds((F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds).cast("long"))


def shifted_hours(ts: Column, hours: int = 8) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts) + hours * 3600)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
