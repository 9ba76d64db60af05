"""Small cases worked out by hand: partly empty rasters, points beyond the axes, incomplete dates, sparse cells."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from plumeline.operators import exposure, models, quality, tables, times

AXES = (20.0, 100.0, 0.5, 3, 3)  # 20 to 21 by 100 to 101


def test_points_beyond_the_outermost_centres_have_no_value(spark):
    points = spark.createDataFrame([(1, 20.0, 100.0), (2, 19.9, 100.0), (3, 21.0, 101.0), (4, 21.1, 101.0), (5, 20.3, 101.2), (6, 20.25, 100.25), (7, None, 100.0)], "k int, lat double, lon double").selectExpr("*", "'2018-02-14' AS utc_date")
    raster = spark.createDataFrame([("2018-02-14", i, j, float(10 * i + j)) for i in range(3) for j in range(3)], "utc_date string, lat_i int, lon_i int, pm25 double")
    got = {r.k: r.pm25 for r in exposure.match_raster(points, raster, "lat", "lon", AXES).collect()}
    assert got == {1: 0.0, 2: None, 3: 22.0, 4: None, 5: None, 6: 0.0, 7: None}


def test_a_snapshot_without_raster_values_counts_as_zero(spark):
    start = datetime(2018, 2, 14, 8)
    rows = []
    for i in range(12):
        # a cell whose points have no value at the first six times, and another point far away that always has one
        rows.append((start + timedelta(minutes=5 * i), 110.0, 30.0, 2, 10.0, None if i < 6 else 40.0))
        rows.append((start + timedelta(minutes=5 * i), 110.0, 30.0, 1, 5.0, None if i < 6 else 20.0))
        rows.append((start + timedelta(minutes=5 * i), 115.0, 35.0, 1, 1.0, 8.0))
    points = spark.createDataFrame(rows, "local_time timestamp, lon double, lat double, cnt long, estimated_population double, pm25 double")
    snap = exposure.snapshot_grid(points)
    assert snap.count() == 6 + 12 and snap.where("population is null").count() == 0
    hourly = exposure.hourly_grid(snap, ["population", "app_count", "exposure", "app_exposure"], times=points.select("local_time").distinct())
    got = {round(r.app_count, 6): r for r in hourly.collect()}
    half, whole = got[1.5], got[1.0]
    assert (half.population, half.exposure, half.app_exposure) == (7.5, 250.0, 50.0)
    assert math.isclose(half.pm25, 250 / 7.5) and whole.pm25 == 8.0 and half.is_complete_hour


def hours(spark):
    rows = []
    for day, n, complete in (("2018-02-14", 24, True), ("2018-02-15", 3, True)):
        for h in range(n):
            rows.append((0, 0, day, h, 10.0 + h, (10.0 + h) * (20 + h), 20.0 + h, complete, 1.0 if complete else 0.5, 60.0))
    rows.append((0, 0, "2018-02-15", 23, float("nan"), 1.0, 1.0, True, 1.0, 60.0))
    rows.append((0, 0, "2018-02-15", 22, 1.0, float("inf"), 1.0, True, 1.0, 60.0))
    return spark.createDataFrame(rows, "grid_x long, grid_y long, local_date string, local_hour int, population double, exposure double, pm25 double, is_complete_hour boolean, coverage_ratio double, covered_minutes double")


def test_days_and_periods(spark):
    dates = spark.createDataFrame([("2018-02-14", 288, 1.0, True), ("2018-02-15", 144, 0.5, False)], "local_date string, available int, date_coverage double, date_is_complete boolean")
    daily = exposure.daily_grid(exposure.finite_hours(hours(spark)), dates)
    got = {r.local_date: r for r in daily.collect()}
    # the mean over hours, not weighted by population
    assert got["2018-02-15"].pm25 == 21.0 and got["2018-02-15"].n_hours == 3 and got["2018-02-15"].weighted_pm25 == pytest.approx((200 + 231 + 264) / 33)
    p = exposure.period_grid(daily, [("pre", "2018-02-14", "2018-02-15"), ("post", "2018-02-16", "2018-02-20")]).collect()
    assert len(p) == 1 and p[0].has_incomplete_date and p[0].mean_date_coverage == 0.75 and p[0].n_hours == 27 and p[0].n_complete_hours == 27 and p[0].day_share == 1.0
    # a cell with few hours on complete dates has no incomplete date
    sound = exposure.period_grid(exposure.daily_grid(exposure.finite_hours(hours(spark)).where("local_hour < 2"), dates.withColumn("date_is_complete", dates.available > 0)), [("pre", "2018-02-14", "2018-02-15")]).first()
    assert not sound.has_incomplete_date and sound.n_hours == 4


def test_hour_rule(spark):
    h = spark.createDataFrame([(1, 1.0, True), (2, 0.75, False), (3, 0.5, False), (4, None, True)], "k int, coverage_ratio double, is_complete_hour boolean")
    assert [sorted(r.k for r in exposure.covered_hours(h, m, i).collect()) for m, i in ((0.0, True), (0.75, True), (0.0, False))] == [[1, 2, 3], [1, 2], [1]]


def test_date_quality(spark):
    day = [datetime(2018, 2, 14) + timedelta(minutes=5 * i) for i in range(288)]
    t = spark.createDataFrame([(x,) for x in day + day[:5] + [datetime(2018, 2, 15)]], "local_time timestamp")
    assert sorted(tuple(r) for r in times.date_quality(t).collect()) == [("2018-02-14", 288, 1.0, True), ("2018-02-15", 1, 1 / 288, False)]


def test_dynamic_features_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cell, days, hours_a_day in (("a", 12, 24), ("b", 9, 24), ("c", 12, 17), ("d", 12, 24)):
        for day in range(days):
            for h in range(hours_a_day):
                v = -5.0 if cell == "d" and h == 3 else None if cell == "d" and h == 4 else float(rng.integers(0, 50))
                rows.append((cell, f"2018-02-{day + 1:02d}", h, v))
    frame = pd.DataFrame(rows, columns=["grid_id", "local_date", "local_hour", "v"])
    hourly = spark.createDataFrame(rows, "grid_id string, local_date string, local_hour int, v double")
    daily = hourly.groupBy("grid_id", "local_date").sum("v").withColumnRenamed("sum(v)", "v")
    got = {r.grid_id: r for r in models.dynamic_features(daily, hourly, "v", 10).collect()}
    same = lambda a, b: (a is None and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9)
    for cell, all_rows in frame.groupby("grid_id"):
        sums = all_rows.groupby("local_date").v.sum()
        sums = sums[sums >= 0]
        known = all_rows[all_rows.v >= 0]
        is_day = known.local_hour.between(8, 19)
        per_day = known.groupby("local_date").agg(h=("local_hour", "nunique"), a=("v", lambda x: x.max() - x.min()))
        full = per_day[per_day.h >= 18]
        r = got[cell]
        assert r.n_days == len(sums) and same(r.cv, sums.std(ddof=1) / sums.mean() if len(sums) >= 10 else math.nan)
        assert same(r.day_night_ratio, known.v[is_day].mean() / known.v[~is_day].mean() if len(known) >= 180 else math.nan)
        amplitude = full.a.mean() if len(full) >= 10 else math.nan
        assert same(r.mean_amplitude, amplitude) and same(r.relative_amplitude, amplitude / known.v.mean())
    assert got["b"].cv is None and got["b"].day_night_ratio is not None and got["c"].mean_amplitude is None


def test_anomaly_thresholds(spark):
    one = quality.anomaly_flags(spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 11, 12, 13, 14, 90, 1])], "k int, v double"), "v", "k")
    got = {r.v: r for r in one.collect()}
    assert got[90.0].is_high and not got[1.0].is_low and got[10.0].low_threshold == 0.0 and got[10.0].high_threshold == pytest.approx(12 + 6 * 1.4826 * 2)
    flat = quality.anomaly_flags(spark.createDataFrame([(i, float(v)) for i, v in enumerate([8, 8, 8, 8, 33, 1])], "k int, v double"), "v", "k")
    got = {r.v: (r.is_low, r.is_high, r.low_threshold, r.high_threshold) for r in flat.collect()}
    assert got == {8.0: (False, False, 2.0, 32.0), 33.0: (False, True, 2.0, 32.0), 1.0: (True, False, 2.0, 32.0)}


def test_checks_find_what_is_broken(spark):
    start = datetime(2018, 2, 14, 5)
    rows = [(start, 0, 0, "2018-02-14", 5, 2.0, 40.0, 20.0), (start, 0, 0, "2018-02-14", 5, 2.0, 40.0, 21.0), (start, 1, 0, "2018-02-15", 6, -1.0, float("inf"), 20.0)]
    h = spark.createDataFrame(rows, "hour_start timestamp, grid_x long, grid_y long, local_date string, local_hour int, population double, exposure double, pm25 double")
    r = quality.hour_checks(h).first()
    assert (r.time_agrees, r.finite, r.not_negative, r.ratio_agrees, r.repeated_keys) == (1, 1, 1, 1, 1)
    assert tuple(quality.hour_checks(h.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_release_rules():
    assert [c for c in ("user_id", "device", "my_person_key", "username", "app_count", "grid_id", "trajectory_x") if tables.is_sensitive(c)] == ["user_id", "device", "my_person_key", "app_count", "trajectory_x"]
    assert tables.release_findings({"a.csv": ["x", "population"]}, {"a.csv": 10, "b.zip": 1, "c.csv": 10**9}) == [("a.csv", "sensitive column population"), ("b.zip", "blocked suffix"), ("c.csv", "too large")]
