from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumeline.functions import geo, scalar
from plumeline.operators import exposure, quality, spatial, times

START = datetime(2018, 2, 14)


def snapshots(spark, minutes, value=lambda i: float(i), cell=(0, 0)):
    rows = [(START + timedelta(minutes=m), cell[0], cell[1], value(i)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "local_time timestamp, grid_x long, grid_y long, population double")


def hour(df):
    return exposure.hourly_grid(df, ["population"]).collect()


def test_regular_hour(spark):
    (r,) = hour(snapshots(spark, range(0, 60, 5)))
    assert (r.population, r.sample_count, r.is_complete_hour, r.method) == (5.5, 12, True, "arithmetic_mean_regular_complete")


def test_missing_first_snapshot(spark):
    (r,) = hour(snapshots(spark, range(5, 60, 5), lambda i: 100.0))
    assert (r.population, r.covered_minutes, r.is_complete_hour) == (100.0, 55.0, False)
    assert r.coverage_ratio == pytest.approx(11 / 12)


def test_long_gap_is_capped(spark):
    df = snapshots(spark, [0, 30, 55], lambda i: 1.0)
    weights = [r.weight_s for r in times.hour_weights(df).orderBy("local_time").collect()]
    (r,) = hour(df)
    assert weights == [600, 600, 300] and r.covered_minutes == 25.0 and r.max_gap_minutes == 30.0


def test_absent_cell_counts_as_zero(spark):
    both = snapshots(spark, range(0, 60, 5), lambda i: 1.0).unionByName(snapshots(spark, range(0, 30, 5), lambda i: 1.0, (1, 0)))
    assert {r.grid_x: r.population for r in hour(both)} == {0: 1.0, 1: 0.5}


def test_null_value_leaves_the_denominator(spark):
    (r,) = hour(snapshots(spark, range(0, 60, 5), lambda i: None if i < 6 else 2.0))
    assert r.population == 2.0


def test_nearest_index_ties_go_low(spark):
    q = spark.createDataFrame([(0.2,), (0.5,), (1.5,), (2.9,), (-9.0,), (99.0,)], "q double")
    assert [r[0] for r in q.select(geo.nearest_index("q", 0.0, 1.0, 4)).collect()] == [0, 0, 1, 3, 0, 3]


@pytest.mark.parametrize(("lon", "lat", "x", "y"), [(116.40, 39.90, 537986.686, 4615165.732), (121.47, 31.23, 1074297.628, 3715792.611), (87.60, 43.80, -1769611.983, 5230318.149), (110.0, 0.0, 0.0, 0.0)])
def test_conic_projection(spark, lon, lat, x, y):
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    east, north = geo.conic("lon", "lat")
    back = geo.conic_inverse(east, north)
    r = df.select(east.alias("x"), north.alias("y"), back[0].alias("lon"), back[1].alias("lat"), geo.cell_origin(east).alias("cell")).first()
    assert (round(r.x, 3) + 0.0, round(r.y, 3) + 0.0) == (x, y)
    assert r.lon == pytest.approx(lon, abs=1e-9) and r.lat == pytest.approx(lat, abs=1e-9)
    assert r.cell == x // 10_000 * 10_000


def test_numbers(spark):
    df = spark.createDataFrame([("1,234 ",), ("x",), (" NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.parsed_number(F.col("s"))).collect()] == [1234.0, None, None, None]
    assert df.select(geo.raw_hundredths(F.lit(0.025))).first()[0] == 2


def test_gaps_and_gate(spark):
    seen = snapshots(spark, [m for m in range(0, 120, 5) if not 20 <= m < 35 and m != 60])
    expected = times.expected_times(spark, "2018-02-14 00:00:00", "2018-02-14 02:00:00")
    (r,) = times.gap_islands(times.missing_times(expected, seen), scalar.day_text(F.col("expected_time"))).collect()
    assert r.missing_intervals == "00:20-00:30 | 01:00-01:00"
    with pytest.raises(ValueError):
        quality.enforce(seen, {"large": F.col("population") > 5})
    with pytest.raises(ValueError):
        times.assert_unique(seen.unionByName(seen), ["local_time"])


def test_polygons(spark):
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    polygons = {5: [square, hole], 7: [[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)]]}
    pts = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (4.0, 2.0), (6.0, 2.0), (9.0, 9.0), (1.0, 2.0), (None, 1.0)], "x double, y double")
    got = {(r.x, r.y): (r.region, r.assignment_method) for r in spatial.assign_regions(pts, "x", "y", polygons).collect()}
    assert got == {(0.5, 0.5): (5, "interior"), (2.0, 2.0): (None, "outside"), (4.0, 2.0): (5, "multiple"), (6.0, 2.0): (7, "interior"), (9.0, 9.0): (None, "outside"), (1.0, 2.0): (5, "boundary"), (None, 1.0): (None, "outside")}
    (o,) = spatial.largest_overlap(spark.createDataFrame([(3.9, 5.0)], "x double, y double"), "x", "y", polygons, 3.0).collect()
    assert (o.overlap_region, o.n_overlaps) == (5, 2)


def test_nearest_region(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    polygons = {2: [[(x + 6, y) for x, y in square]], 1: [square]}
    pts = spark.createDataFrame([(5.0, 2.0), (4.6, 2.0), (5.5, 2.0), (20.0, 2.0), (7.0, 1.0), (4.3, 4.4)], "x double, y double")
    got = {(r.x, r.y): (r.nearest_region, r.distance if r.distance is None else round(r.distance, 6)) for r in spatial.nearest_region(pts, "x", "y", polygons, 1.0).collect()}
    assert got == {(5.0, 2.0): (1, 1.0), (4.6, 2.0): (1, 0.6), (5.5, 2.0): (2, 0.5), (20.0, 2.0): (None, None), (7.0, 1.0): (2, 0.0), (4.3, 4.4): (1, 0.5)}
