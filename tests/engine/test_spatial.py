import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import spatial
from plumeline.plans import queries as plans
from plumeline.sources import views

SF = "/root/testdata/sf0.001"


def to_segment(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = min(1.0, max(0.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.dist((x, y), (a[0] + t * dx, a[1] + t * dy))


def covered(x, y):
    """The regions that hold the point, written out as boxes."""
    box = lambda x0, x1, y0, y1: x0 <= x <= x1 and y0 <= y <= y1
    return {0: box(80, 100, 20, 30), 1: box(100, 115, 20, 30), 2: box(80, 100, 32, 36) or box(80, 90, 32, 44), 3: box(102, 120, 32, 44) and not (106 < x < 110 and 35 < y < 40)}


def expected(x, y, most=0.5):
    """nearest region, its distance, and whether the region holds the point."""
    held = covered(x, y)
    near = {k: 0.0 if held[k] else min(to_segment(x, y, a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) for k, rings in plans.POLYGONS.items()}
    best = min(near, key=lambda k: (near[k], k))
    return (best, near[best], held[best]) if near[best] <= most else (None, None, False)


def agrees(r, region, distance):
    return r.nearest_region == region and (r.distance is None if distance is None else math.isclose(r.distance, distance, abs_tol=1e-9))


def test_nearest_region_of_all_observations_by_brute_force(spark):
    points = {r.event_id: (r.lon_raw / 100, r.lat_raw / 100) for r in views.observations(spark, SF).collect()}
    got = plans.QUERIES["nearest_region"](spark, SF).collect()
    assert sorted(r.event_id for r in got) == sorted(points)
    assert all(agrees(r, *expected(*points[r.event_id])[:2]) for r in got)
    assert {r.nearest_region for r in got} == {None, 0, 1, 2, 3}


def test_nearest_region_around_every_shape_by_brute_force(spark):
    rng = random.Random(4)
    # around the corners and sides of all rings, the hole's among them, and anywhere
    turns = [c for rings in plans.POLYGONS.values() for ring in rings for c in ring]
    points = [(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for x, y in turns for _ in range(60)] + [(rng.uniform(78, 122), rng.uniform(18, 46)) for _ in range(2000)]
    got = spatial.nearest_region(spark.createDataFrame(points, "x double, y double"), "x", "y", plans.POLYGONS, 0.5).collect()
    assert len(got) == len(points) and all(agrees(r, *expected(r.x, r.y)[:2]) for r in got)
    assert {region for region, distance, held in (expected(r.x, r.y) for r in got) if not held} == {None, 0, 1, 2, 3}


def by_hand(z, pairs, permutations, seed=42):
    """I of the values and of the same permutations, from the whole matrix of weights."""
    w = np.zeros((len(z), len(z)))
    w[tuple(np.array(pairs).T)] = 1
    degree = w.sum(axis=1)
    w /= np.maximum(degree, 1)[:, None]
    drawn = [z] + [np.random.default_rng([seed, i]).permutation(z) for i in range(permutations)]
    return [len(z) / (degree > 0).sum() * (v @ w @ v) / (v @ v) for v in drawn]


def same_test(r, sims):
    larger = sum(s >= sims[0] for s in sims[1:])
    z_sim = (sims[0] - np.mean(sims[1:])) / np.std(sims[1:])
    return math.isclose(r.moran_i, sims[0], rel_tol=1e-9) and math.isclose(r.z_sim, z_sim, rel_tol=1e-6) and math.isclose(r.p_sim, (min(larger, len(sims) - 1 - larger) + 1) / len(sims))


@pytest.mark.parametrize("held", [50, 2_000_000])
def test_permutation_test_by_hand(spark, monkeypatch, held):
    monkeypatch.setattr(spatial, "EDGES", held)
    rng = np.random.default_rng(6)
    value = rng.exponential(size=60)
    pairs = [(a, b) for a in range(55) for b in range(55) if a != b and rng.random() < 0.2]  # the last five are islands
    points = spark.createDataFrame([(i * 3, float(v)) for i, v in enumerate(value)], "key long, v double")
    edges = spark.createDataFrame([(a * 3, b * 3) for a, b in pairs], "src long, dst long")
    (r,) = spatial.permutation_test(spark, spatial.spatial_lag(points, edges, "key", "v"), edges, "key", 99).collect()
    assert same_test(r, by_hand(value - value.mean(), pairs, 99))


def test_permutation_test_beyond_five_million_edges(spark):
    n = 2400
    value = np.random.default_rng(7).exponential(size=n)
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], "key long, v double")
    edges = spark.range(n).select(F.col("id").alias("src")).crossJoin(spark.range(n).select(F.col("id").alias("dst"))).where("src != dst and (src * src + dst) % 30 != 0")
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b and (a * a + b) % 30]
    assert len(pairs) > 5_000_000
    (r,) = spatial.permutation_test(spark, spatial.spatial_lag(points, edges, "key", "v"), edges, "key", 9).collect()
    assert same_test(r, by_hand(value - value.mean(), pairs, 9))


def maps():
    """Points by chance, on a lattice with many to a place, at distances of exactly the radius, on a line and at one place; some keys repeat."""
    rng = np.random.default_rng(3)
    for xy, radius in ((rng.uniform(-3, 7, (1500, 2)), 0.37), (rng.integers(0, 40, (2000, 2)), 7.0), (np.round(rng.normal(0, 1, (1500, 2)), 1), 0.5), (np.c_[rng.uniform(0, 9, 900), np.zeros(900)], 0.3), (np.ones((200, 2)), 1.0)):
        yield [(i % (len(xy) - 5), float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, rng.exponential(size=len(xy)), strict=True))], radius


def test_band_sums_are_those_of_all_pairs(spark, monkeypatch):
    for rows, radius in maps():
        monkeypatch.setattr(spatial, "PLACES", 300 if radius == 0.37 else 1_000_000)
        points = spark.createDataFrame([*rows, (-1, None, 0.0, 1.0), (-2, math.nan, 0.0, 1.0)], "key long, x double, y double, v double")
        edges = spatial.distance_band(points, "key", "x", "y", radius)
        want = {r.src: (r.n, r.s) for r in edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("s")).collect()}
        assert {r.src: (r.n, r.key) for r in spatial.band_sums(points, "key", "x", "y", radius, ["key"]).collect()} == want
        one = sorted(spatial.spatial_lag(points, edges, "key", "v").collect())
        two = sorted(spatial.band_lag(points, "key", "x", "y", radius, "v").collect())
        assert [(r.key, r.n_neighbours) for r in one] == [(r.key, r.n_neighbours) for r in two]
        assert np.allclose([(r.z, r.lag) for r in one], [(r.z, r.lag) for r in two], rtol=0, atol=1e-9)


def test_distance_band_of_very_many_pairs(spark):
    # each of 60,000 points has some 1,400 others around it: 84 million pairs
    points = spark.range(60_000).select(F.col("id").alias("key"), (F.col("id") % 250).cast("double").alias("x"), F.floor(F.col("id") / 250).cast("double").alias("y"))
    found = spatial.band_sums(points, "key", "x", "y", 22.0, ["key"])
    circle = [(i, j) for i in range(-22, 23) for j in range(-22, 23) if i * i + j * j <= 484 and (i or j)]
    whole = found.where("n = " + str(len(circle)))
    # inside, neighbours lie around the point evenly
    assert whole.count() == (250 - 44) * (240 - 44) and whole.where("key != src * n").count() == 0
    assert found.agg(F.sum("n")).first()[0] == sum((250 - abs(i)) * (240 - abs(j)) for i, j in circle)


@pytest.mark.parametrize("shift", [0.0, 0.25])
def test_band_permutation_test_by_hand(spark, shift):
    """On a lattice, with places that repeat and a point without one, and off it."""
    rng = np.random.default_rng(8)
    n, radius = 400, 6.0
    x, y, v = rng.integers(0, 12, n) * 2.0, rng.integers(0, 9, n) * 3.0, rng.exponential(size=n)
    x[5] += shift
    rows = [(i, float(a), float(b) if i < n - 1 else None, float(c)) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))]
    points = spark.createDataFrame(rows, "key long, x double, y double, v double")
    pairs = [(a, b) for a in range(n - 1) for b in range(n - 1) if a != b and (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= radius**2]
    (r,) = spatial.band_permutation_test(spark, points, "key", "x", "y", radius, "v", 99).collect()
    assert same_test(r, by_hand(v - v.mean(), pairs, 99))


def test_local_significance_with_and_without_bounds(spark, monkeypatch):
    """All p by the draws themselves: ties, zeros, an outlier, equal and different numbers of neighbours, draws in several blocks."""
    monkeypatch.setattr(spatial, "DRAWS", 500)
    rng = np.random.default_rng(9)
    z = np.round(rng.normal(size=300), 1)
    z[0] = 40.0
    degree = rng.integers(0, 30, 300)
    lag = np.where(degree > 0, [rng.choice(z, max(1, d)).mean() for d in degree], 0.0)
    zz, values = float((z**2).sum()), np.sort(z)
    local = [(i, float(a), int(d), float(299 * a * b / zz)) for i, (a, d, b) in enumerate(zip(z, degree, lag, strict=True))]
    got = {r.key: r.p_sim for r in spatial.local_significance(spark.createDataFrame(local, "key long, z double, n_neighbours long, local_i double"), "key", 199).collect()}
    draw = np.random.default_rng(42)
    drawn = np.array([draw.choice(299, degree.max(), replace=False) for _ in range(199)])
    assert len(got) == 300
    for key, own, n, seen in local:
        others = drawn[:, :n]
        larger = int((299 * own * values[others + (others >= np.searchsorted(values, own))].mean(axis=1) / zz >= seen).sum()) if n else 0
        assert got[key] == ((min(larger, 199 - larger) + 1) / 200 if n else 1.0)


def test_local_significance_of_many_neighbours(spark):
    # 40,000 points of 600 neighbours each: 24 billion values, were all drawn one by one
    local = spark.range(40_000).select(F.col("id").alias("key"), ((F.col("id") * 7919 % 40_009) / 1000.0 - 20).alias("z"), F.lit(600).alias("n_neighbours"), F.lit(0.0).alias("local_i"))
    began = time.time()
    assert spatial.local_significance(local, "key").where("p_sim between 0.001 and 1").count() == 40_000
    assert time.time() - began < 60


def test_local_significance_draws_from_all_values(spark):
    # 120,000 skewed values, of which thirty have neighbours
    z = F.when(F.col("id") % 1000 == 7, F.col("id") / 10.0).otherwise(-(F.col("id") % 13) / 10.0)
    local = spark.range(120_000).select(F.col("id").alias("key"), z.alias("z"), F.when(F.col("id") % 4000 == 7, 5).otherwise(0).alias("n_neighbours"))
    # an I in the midst of those that are drawn
    middle = local.agg(-0.6 * F.count(F.lit(1)) / F.sum(F.col("z") * F.col("z"))).first()[0]
    local = local.withColumn("local_i", F.col("z") * middle)
    rows = local.orderBy("z").collect()
    values = np.array([r.z for r in rows])
    got = {r.key: r.p_sim for r in spatial.local_significance(local, "key").where("n_neighbours > 0").collect()}
    assert len(got) == 30
    draw = np.random.default_rng(42)
    others = np.array([draw.choice(len(values) - 1, 5, replace=False) for _ in range(999)])
    assert all(len(set(x)) == 5 for x in others.tolist())
    for r in rows:
        if r.n_neighbours:
            left = np.delete(values, np.searchsorted(values, r.z))
            larger = int(((len(values) - 1) * r.z * left[others].mean(axis=1) / (values**2).sum() >= r.local_i).sum())
            assert got[r.key] == (min(larger, 999 - larger) + 1) / 1000


def test_all_other_points_as_neighbours_leave_one_draw(spark):
    # each of four points has the three others around it, so every permutation gives the observed value
    z = [-3.0, -1.0, 1.0, 3.0]
    rows = [(i, v, 3, 3 * v * (sum(z) - v) / 3 / sum(x * x for x in z)) for i, v in enumerate(z)]
    local = spark.createDataFrame(rows, "key long, z double, n_neighbours long, local_i double")
    assert {r.p_sim for r in spatial.local_significance(local, "key", 99).collect()} == {0.01}
    with pytest.raises(ValueError, match="equal"):
        spatial.local_significance(local.withColumn("z", F.lit(0.0)), "key", 99)


def test_points_without_a_value_are_no_data(spark):
    points = spark.createDataFrame([(1, 2.0), (2, None)], "key long, v double")
    found = spark.createDataFrame([(1, 0.5, 0.01, 1, "HH")], "key long, local_i double, p_sim double, quadrant int, cluster string")
    assert {r.key: r.cluster for r in spatial.with_no_data(points, found, "key").collect()} == {1: "HH", 2: "NoData"}


def test_box_outline():
    ring = spatial.box_outline(0.0, 10.0, 4.0, 30.0, 3)
    assert ring == [(0, 10), (2, 10), (4, 10), (4, 20), (4, 30), (2, 30), (0, 30), (0, 20), (0, 10)]
