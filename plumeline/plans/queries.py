"""One query for each operator, over the whole test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import exposure, models, quality, spatial, tables, times
from ..sources import views
from ..sources.files import newest_per_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Logical inputs in SQL, as plumeline.sources.views makes them.
OBS = """
    ev AS (SELECT *, date_trunc('hour', ts) + to_minutes(CAST(extract(minute FROM ts) AS BIGINT) // 5 * 5) AS t5 FROM events),
    obs AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS source_date, 'f' || CAST(user_id % 10 AS VARCHAR) AS source_file, event_id AS line_no,
        CASE WHEN event_id % 97 = 0 THEN '' ELSE strftime(t5, '%Y-%m-%d %H:%M:%S') END AS time, t5 AS utc_true, CAST(floor(value) AS BIGINT) AS cnt,
        2000 + (user_id * 7919) % 2500 AS lat_raw, 8000 + (user_id * 10007) % 4500 AS lon_raw, user_id % 25 AS region FROM ev),
    rep AS (SELECT *, utc_true AS utc_time, strftime(utc_true, '%Y-%m-%d') AS utc_date, utc_true + to_hours(8) AS local_time,
        strftime(utc_true + to_hours(8), '%Y-%m-%d') AS local_date, CAST(extract(hour FROM utc_true + to_hours(8)) AS INTEGER) AS local_hour
        FROM obs WHERE NOT (event_id % 97 = 0 AND event_id % 194 <> 0))"""
OFFICIAL = "official AS (SELECT n_nationkey AS region, n_name AS region_name, 1000000 * (CAST(n_nationkey AS BIGINT) + 1) AS official_population FROM nation)"
SUMS = "sums AS (SELECT utc_time, region, sum(cnt) AS app_count FROM rep GROUP BY utc_time, region)"
WEIGHTS = """med AS (SELECT region, median(app_count) AS reference_app_count, count(DISTINCT utc_time) AS n_times FROM sums GROUP BY region),
    weights AS (SELECT o.*, m.reference_app_count, m.n_times, o.official_population / nullif(m.reference_app_count, 0) AS expansion_weight FROM official o LEFT JOIN med m ON o.region = m.region)"""
SCALES = """tot AS (SELECT sum(official_population) AS official_total FROM weights),
    pre AS (SELECT s.utc_time, sum(s.app_count * w.expansion_weight) AS preliminary_total FROM sums s JOIN weights w ON s.region = w.region GROUP BY s.utc_time),
    scales AS (SELECT p.utc_time, p.preliminary_total, t.official_total / nullif(p.preliminary_total, 0) AS scaling_factor, p.preliminary_total - t.official_total AS absolute_error FROM pre p, tot t)"""
CALIBRATED = """cal AS (SELECT r.*, r.cnt * w.expansion_weight AS preliminary_population, r.cnt * w.expansion_weight * s.scaling_factor AS estimated_population
    FROM rep r LEFT JOIN weights w ON r.region = w.region LEFT JOIN scales s ON r.utc_time = s.utc_time)"""
RASTER = """raster AS (SELECT '2024-01-' || lpad(CAST(d.day AS VARCHAR), 2, '0') AS utc_date, a.lat_i, b.lon_i,
        CASE WHEN (a.lat_i + b.lon_i) % 11 <> 0 THEN 20 + ((a.lat_i * 31 + b.lon_i * 17 + d.day * 7) % 100) / 2.0 END AS pm25
    FROM (SELECT unnest(range(0, 57)) AS lat_i) a, (SELECT unnest(range(0, 99)) AS lon_i) b, (SELECT unnest(range(1, 32)) AS day) d)"""
MATCHED = """near AS (SELECT c.*, c.lat_raw / 100.0 AS lat, c.lon_raw / 100.0 AS lon,
        CASE WHEN c.lat_raw / 100.0 BETWEEN 18.0 AND 46.0 AND c.lon_raw / 100.0 BETWEEN 78.0 AND 127.0 THEN CAST(least(greatest(ceil((c.lat_raw / 100.0 - 18.0) / 0.5 - 0.5), 0), 56) AS INTEGER) END AS lat_i,
        CASE WHEN c.lat_raw / 100.0 BETWEEN 18.0 AND 46.0 AND c.lon_raw / 100.0 BETWEEN 78.0 AND 127.0 THEN CAST(least(greatest(ceil((c.lon_raw / 100.0 - 78.0) / 0.5 - 0.5), 0), 98) AS INTEGER) END AS lon_i FROM cal c),
    matched AS (SELECT n.*, r.pm25 FROM near n LEFT JOIN raster r ON n.utc_date = r.utc_date AND n.lat_i = r.lat_i AND n.lon_i = r.lon_i)"""


def _conic_sql(lon: str, lat: str) -> tuple[str, str]:
    s = f"({geo.ECCENTRICITY!r} * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {geo.ECCENTRICITY / 2!r}))"
    rho, turn = f"({geo.SEMI_MAJOR * geo.SCALE!r} * pow({t}, {geo.CONE!r}))", f"({geo.CONE!r} * radians({lon} - {geo.LON_0!r}))"
    return f"{rho} * sin({turn})", f"{geo.RHO_0!r} - {rho} * cos({turn})"


_X, _Y = _conic_sql("lon", "lat")
SNAPSHOT = f"""cells AS (SELECT *, CAST(floor(({_X}) / 10000) * 10000 AS BIGINT) AS grid_x, CAST(floor(({_Y}) / 10000) * 10000 AS BIGINT) AS grid_y FROM matched),
    snap AS (SELECT local_time, grid_x, grid_y, sum(estimated_population) AS population, CAST(sum(cnt) AS BIGINT) AS app_count, sum(estimated_population * pm25) AS exposure, sum(cnt * pm25) AS app_exposure
        FROM cells WHERE pm25 IS NOT NULL GROUP BY local_time, grid_x, grid_y)"""
HOURS = """tm AS (SELECT DISTINCT local_time AS t, date_trunc('hour', local_time) AS hour_start FROM rep),
    td AS (SELECT t, hour_start, epoch(t) AS s, epoch(lead(t) OVER w) AS nx, epoch(lag(t) OVER w) AS pv, epoch(hour_start) AS h0 FROM tm WINDOW w AS (PARTITION BY hour_start ORDER BY t)),
    wt AS (SELECT t AS local_time, hour_start, least(greatest(least(coalesce(nx, h0 + 3600), h0 + 3600) - s, 0), 600) AS weight_s,
        greatest(s - coalesce(pv, h0), CASE WHEN nx IS NULL THEN h0 + 3600 - s ELSE 0 END) AS gap_s FROM td),
    hq AS (SELECT hour_start, count(*) AS sample_count, sum(weight_s) AS covered_s, max(gap_s) AS max_gap_s, count(*) = 12 AS is_complete_hour,
        CASE WHEN count(*) = 12 AND min(weight_s) = 300 AND max(weight_s) = 300 THEN 'arithmetic_mean_regular_complete' ELSE 'time_weighted_forward_duration_capped' END AS method FROM wt GROUP BY hour_start)"""
HOURLY = """hm AS (SELECT w.hour_start, s.grid_x, s.grid_y, sum(s.population * w.weight_s) / nullif(max(q.covered_s) - sum(CASE WHEN s.population IS NULL THEN w.weight_s ELSE 0 END), 0) AS population, sum(s.app_count * w.weight_s) / nullif(max(q.covered_s) - sum(CASE WHEN s.app_count IS NULL THEN w.weight_s ELSE 0 END), 0) AS app_count,
        sum(s.exposure * w.weight_s) / nullif(max(q.covered_s) - sum(CASE WHEN s.exposure IS NULL THEN w.weight_s ELSE 0 END), 0) AS exposure, sum(s.app_exposure * w.weight_s) / nullif(max(q.covered_s) - sum(CASE WHEN s.app_exposure IS NULL THEN w.weight_s ELSE 0 END), 0) AS app_exposure,
        max(q.sample_count) AS sample_count, max(q.sample_count) / 12.0 AS coverage_ratio, max(q.covered_s) / 60.0 AS covered_minutes, bool_or(q.is_complete_hour) AS is_complete_hour
        FROM snap s JOIN wt w ON s.local_time = w.local_time JOIN hq q ON w.hour_start = q.hour_start GROUP BY w.hour_start, s.grid_x, s.grid_y),
    hl AS (SELECT *, exposure / nullif(population, 0) AS pm25, strftime(hour_start, '%Y-%m-%d') AS local_date, CAST(extract(hour FROM hour_start) AS INTEGER) AS local_hour FROM hm)"""
DATES = """dq AS (SELECT local_date, count(DISTINCT local_time) AS available, count(DISTINCT local_time) / 288.0 AS date_coverage, count(DISTINCT local_time) = 288 AS date_is_complete FROM rep GROUP BY local_date)"""
DAILY = """dg AS (SELECT h.grid_x, h.grid_y, h.local_date, sum(population) AS population, sum(exposure) AS exposure, avg(pm25) AS pm25, count(DISTINCT local_hour) AS n_hours,
        sum(CASE WHEN is_complete_hour THEN 1 ELSE 0 END) AS n_complete_hours, avg(coverage_ratio) AS mean_coverage, min(coverage_ratio) AS min_coverage, sum(covered_minutes) AS covered_minutes,
        CASE WHEN sum(population) > 0 THEN sum(exposure) / sum(population) END AS weighted_pm25, any_value(q.date_coverage) AS date_coverage, any_value(q.date_is_complete) AS date_is_complete
        FROM hl h JOIN dq q ON h.local_date = q.local_date WHERE population IS NOT NULL AND exposure IS NOT NULL AND pm25 IS NOT NULL GROUP BY h.grid_x, h.grid_y, h.local_date)"""
PERIOD = """dl AS (SELECT *, CASE WHEN local_date BETWEEN '2024-01-01' AND '2024-01-10' THEN 'pre' WHEN local_date BETWEEN '2024-01-11' AND '2024-01-17' THEN 'festival' WHEN local_date BETWEEN '2024-01-18' AND '2024-01-30' THEN 'post' END AS period FROM dg),
    pg AS (SELECT grid_x, grid_y, period, avg(population) AS population, avg(exposure) AS exposure, avg(pm25) AS pm25, avg(weighted_pm25) AS weighted_pm25, count(DISTINCT local_date) AS n_days, sum(n_hours) AS n_hours,
        sum(n_complete_hours) AS n_complete_hours, avg(mean_coverage) AS mean_coverage, min(min_coverage) AS min_coverage, avg(date_coverage) AS mean_date_coverage, NOT bool_and(date_is_complete) AS has_incomplete_date,
        count(DISTINCT local_date) / CASE period WHEN 'pre' THEN 10.0 WHEN 'festival' THEN 7.0 ELSE 13.0 END AS day_share FROM dl WHERE period IS NOT NULL GROUP BY grid_x, grid_y, period)"""
CHAIN = [OBS, OFFICIAL, SUMS, WEIGHTS, SCALES, CALIBRATED, RASTER, MATCHED, SNAPSHOT, HOURS, HOURLY, DATES, DAILY, PERIOD]
LINES = """li AS (SELECT l_suppkey AS grid, s_nationkey AS region, year(l_shipdate) AS y, l_quantity AS q, l_extendedprice / l_quantity AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    gp AS (SELECT grid, region, sum(CASE WHEN y = 1996 THEN q END) AS p0, avg(CASE WHEN y = 1996 THEN c END) AS c0, sum(CASE WHEN y = 1998 THEN q END) AS p1, avg(CASE WHEN y = 1998 THEN c END) AS c1 FROM li GROUP BY grid, region),
    de AS (SELECT grid, region, p0, c0, p1, c1, c0 * (p1 - p0) AS mobility, p0 * (c1 - c0) AS pollution, (p1 - p0) * (c1 - c0) AS interaction, p1 * c1 - p0 * c0 AS total FROM gp WHERE p0 >= 0 AND c0 > 0 AND p1 >= 0 AND c1 > 0)"""


def _with(upto: str | list[str], select: str) -> str:
    parts = CHAIN[: CHAIN.index(upto) + 1] if isinstance(upto, str) else upto
    return "WITH " + ",\n".join(parts) + "\n" + select


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _r(c: str, digits: int = 4):
    return F.round(F.col(c), digits).alias(c)


# ---- inputs, built step by step -------------------------------------------------------------------

AXES = (views.LAT_START, views.LON_START, views.STEP, views.N_LAT, views.N_LON)


def _sums(spark, d):
    return exposure.reference_sums(views.repaired(spark, d))


def _weights(spark, d):
    return exposure.region_weights(_sums(spark, d), views.official_totals(spark, d))


def _scales(spark, d):
    return exposure.time_scales(_sums(spark, d), _weights(spark, d))


def _calibrated(spark, d):
    return exposure.calibrate(views.repaired(spark, d), _weights(spark, d), _scales(spark, d))


def _matched(spark, d):
    points = _calibrated(spark, d).withColumn("lat", F.col("lat_raw") / 100).withColumn("lon", F.col("lon_raw") / 100)
    return exposure.match_raster(points, views.raster(spark), "lat", "lon", AXES)


def _snapshots(spark, d):
    return exposure.snapshot_grid(_matched(spark, d))


def _times(spark, d):
    return views.repaired(spark, d).select("local_time").distinct()


def _hourly(spark, d):
    # weights and quality come from the observed times alone, not from the points' whole chain
    h = exposure.hourly_grid(_snapshots(spark, d), ["population", "app_count", "exposure", "app_exposure"], times=_times(spark, d))
    return h.withColumn("local_date", scalar.day_text(F.col("hour_start"))).withColumn("local_hour", F.hour("hour_start"))


def _daily(spark, d):
    return exposure.daily_grid(exposure.finite_hours(_hourly(spark, d)), times.date_quality(_times(spark, d)))


def _periods(spark, d):
    return exposure.period_grid(_daily(spark, d), views.PERIODS)


def _contrasts(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("grid"), F.col("s_nationkey").alias("region"))
    li = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grid"), F.year("l_shipdate").alias("y"), "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("c"))
    by = [f(F.when(F.col("y") == y, F.col(c))).alias(n) for y, k in ((1996, 0), (1998, 1)) for f, c, n in ((F.sum, "l_quantity", f"p{k}"), (F.avg, "c", f"c{k}"))]
    grid = li.groupBy("grid").agg(*by).join(s, "grid")
    return exposure.contrast(exposure.valid_for_contrast(grid, [("p0", "c0"), ("p1", "c1")]), "x", "p0", "c0", "p1", "c1")


def _customers(spark, d):
    """A map of customers: planar coordinates, covariates and a target."""
    o = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.sum(F.when(F.month("o_orderdate") <= 6, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("target"))
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) * 1000.0).alias("x"), (F.pmod(F.col("c_custkey") * 10007, F.lit(997)) * 1000.0).alias("y"))
    return c.join(o, "key")


MAP = """cu AS (SELECT c_custkey AS key, c_acctbal, (c_custkey * 7919) % 1000 * 1000.0 AS x, (c_custkey * 10007) % 997 * 1000.0 AS y FROM customer),
    ed AS (SELECT a.key AS src, b.key AS dst FROM cu a JOIN cu b ON b.x BETWEEN a.x - 50000 AND a.x + 50000 AND b.y BETWEEN a.y - 50000 AND a.y + 50000 AND a.key <> b.key AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2500000000),
    zs AS (SELECT key, c_acctbal - (SELECT avg(c_acctbal) FROM cu) AS z FROM cu),
    lg AS (SELECT e.src, avg(z.z) AS lag, count(*) AS n FROM ed e JOIN zs z ON e.dst = z.key GROUP BY e.src),
    la AS (SELECT z.key, z.z, coalesce(l.lag, 0) AS lag, coalesce(l.n, 0) AS n_neighbours FROM zs z LEFT JOIN lg l ON z.key = l.src)"""


def _map(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) * 1000.0).alias("x"), (F.pmod(F.col("c_custkey") * 10007, F.lit(997)) * 1000.0).alias("y"))


def _lagged(spark, d):
    return spatial.band_lag(_map(spark, d), "key", "x", "y", 50_000.0, "c_acctbal")


# ---- times ----------------------------------------------------------------------------------------


@query("time_status", _with(OBS, """SELECT CASE WHEN event_id % 97 <> 0 THEN 'parsed' WHEN event_id % 194 = 0 THEN 'recovered' ELSE 'unrecoverable' END AS time_status, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt FROM obs GROUP BY 1"""))
def time_status(spark, d):
    rows = times.with_audit(views.observations(spark, d), views.blank_time_audit(spark, d))
    return rows.groupBy("time_status").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"))


@query("local_times", _with(OBS, "SELECT event_id, strftime(utc_time, '%Y-%m-%d %H:%M:%S') AS utc_time, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, local_date, local_hour FROM rep"))
def local_times(spark, d):
    r = views.repaired(spark, d)
    return r.select("event_id", scalar.time_text(F.col("utc_time")).alias("utc_time"), scalar.time_text(F.col("local_time")).alias("local_time"), "local_date", "local_hour")


@query("time_range_filter", _with(OBS, "SELECT event_id, cnt FROM rep WHERE local_time >= TIMESTAMP '2024-01-11 00:00:00' AND local_time < TIMESTAMP '2024-01-18 00:00:00'"))
def time_range_filter(spark, d):
    return views.repaired(spark, d).where(times.in_range("local_time", "2024-01-11 00:00:00", "2024-01-18 00:00:00")).select("event_id", "cnt")


@query("blank_groups", _with(OBS, """SELECT source_date, source_file, count(*) AS blank_records, CAST(sum(cnt) AS BIGINT) AS app_count_sum, min(lat_raw) AS lat_min, max(lat_raw) AS lat_max, min(lon_raw) AS lon_min, max(lon_raw) AS lon_max FROM obs WHERE trim(time) = '' GROUP BY source_date, source_file"""))
def blank_groups(spark, d):
    return times.blank_groups(views.observations(spark, d), ["source_date", "source_file"])


@query("hour_coverage", _with(OBS, """, hh AS (SELECT local_date, count(*) AS n_rows, count(DISTINCT local_hour) AS n_hours FROM rep GROUP BY local_date),
    al AS (SELECT local_date, h FROM hh, (SELECT unnest(range(0, 24)) AS h) x), mi AS (SELECT a.local_date, CAST(a.h AS VARCHAR) AS h FROM al a LEFT JOIN (SELECT DISTINCT local_date, local_hour FROM rep) r ON a.local_date = r.local_date AND a.h = r.local_hour WHERE r.local_hour IS NULL)
    SELECT hh.local_date, hh.n_rows, hh.n_hours, coalesce(m.missing_hours, '') AS missing_hours FROM hh LEFT JOIN (SELECT local_date, string_agg(h, ',' ORDER BY CAST(h AS INTEGER)) AS missing_hours FROM mi GROUP BY local_date) m ON hh.local_date = m.local_date"""))
def hour_coverage(spark, d):
    return times.hour_coverage(views.repaired(spark, d))


@query("local_hour_coverage", _with(OBS, """, lh AS (SELECT DISTINCT local_date, local_hour FROM rep), al AS (SELECT d.local_date, h FROM (SELECT DISTINCT local_date FROM lh) d, (SELECT unnest(range(0, 24)) AS h) x),
    mi AS (SELECT a.local_date, a.h FROM al a LEFT JOIN lh ON a.local_date = lh.local_date AND a.h = lh.local_hour WHERE lh.local_hour IS NULL)
    SELECT c.local_date, c.n_hours, coalesce(m.g, '') AS missing_hours FROM (SELECT local_date, count(*) AS n_hours FROM lh GROUP BY local_date) c LEFT JOIN (SELECT local_date, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS g FROM mi GROUP BY local_date) m ON c.local_date = m.local_date"""))
def local_hour_coverage(spark, d):
    return times.local_hour_coverage(views.repaired(spark, d).select("utc_date", "utc_hour").distinct())


_EXPECTED = """, ex AS (SELECT TIMESTAMP '2024-01-02 00:00:00' + to_minutes(5 * i) AS t FROM (SELECT unnest(range(0, 8064)) AS i) x), ob AS (SELECT DISTINCT local_time AS t FROM rep),
    mi AS (SELECT ex.t FROM ex LEFT JOIN ob ON ex.t = ob.t WHERE ob.t IS NULL)"""


@query("day_completeness", _with(OBS, _EXPECTED + """, br AS (SELECT strftime(t, '%Y-%m-%d') AS day, t, CASE WHEN epoch(t) - epoch(lag(t) OVER (PARTITION BY strftime(t, '%Y-%m-%d') ORDER BY t)) = 300 THEN 0 ELSE 1 END AS b FROM mi),
    ru AS (SELECT day, t, sum(b) OVER (PARTITION BY day ORDER BY t) AS r FROM br), it AS (SELECT day, r, strftime(min(t), '%H:%M') || '-' || strftime(max(t), '%H:%M') AS s FROM ru GROUP BY day, r),
    ga AS (SELECT day, string_agg(s, ' | ' ORDER BY s) AS g FROM it GROUP BY day), av AS (SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS n FROM ob GROUP BY 1)
    SELECT c.day, c.expected, coalesce(av.n, 0) AS available, c.expected - coalesce(av.n, 0) AS missing, coalesce(ga.g, '') AS missing_intervals, coalesce(av.n, 0) = c.expected AS is_complete
    FROM (SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS expected FROM ex GROUP BY 1) c LEFT JOIN av ON c.day = av.day LEFT JOIN ga ON c.day = ga.day"""))
def day_completeness(spark, d):
    out = times.day_completeness(spark, views.repaired(spark, d), "2024-01-02 00:00:00", "2024-01-30 00:00:00")
    return out.select("day", "expected", "available", "missing", "missing_intervals", "is_complete")


@query("missing_times", _with(OBS, _EXPECTED + "SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS expected_time FROM mi"))
def missing_times(spark, d):
    expected = times.expected_times(spark, "2024-01-02 00:00:00", "2024-01-30 00:00:00")
    return times.missing_times(expected, views.repaired(spark, d)).select(scalar.time_text(F.col("expected_time")).alias("expected_time"))


@query("missing_region_hours", _with(OBS, """, ex AS (SELECT TIMESTAMP '2024-01-02 00:00:00' + to_hours(i) AS h, n_nationkey AS region FROM (SELECT unnest(range(0, 672)) AS i) x, nation), ob AS (SELECT DISTINCT date_trunc('hour', local_time) AS h, region FROM rep)
    SELECT ex.region, count(*) AS n_missing FROM ex LEFT JOIN ob ON ex.h = ob.h AND ex.region = ob.region WHERE ob.h IS NULL GROUP BY ex.region"""))
def missing_region_hours(spark, d):
    hours = times.expected_times(spark, "2024-01-02 00:00:00", "2024-01-30 00:00:00", 60)
    # every hour of the window for a fixed list of regions
    wanted = hours.crossJoin(F.broadcast(views.official_totals(spark, d).select("region")))
    seen = views.repaired(spark, d).select(F.date_trunc("hour", "local_time").alias("expected_time"), "region").distinct()
    return wanted.join(seen, ["expected_time", "region"], "left_anti").groupBy("region").agg(F.count(F.lit(1)).alias("n_missing"))


@query("cadence", _with(OBS, """, t AS (SELECT DISTINCT utc_time FROM rep), g AS (SELECT (epoch(utc_time) - epoch(lag(utc_time) OVER (ORDER BY utc_time))) / 60 AS gap FROM t), c AS (SELECT gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY gap)
    SELECT CAST(coalesce((SELECT gap FROM c ORDER BY n DESC, gap LIMIT 1), 60) AS DOUBLE) AS cadence_minutes"""))
def cadence(spark, d):
    return times.cadence_minutes(views.repaired(spark, d), "utc_time")


@query("order_inversions", _with(OBS, """, b AS (SELECT source_file, CASE WHEN time < lag(time) OVER (PARTITION BY source_file ORDER BY line_no) THEN 1 ELSE 0 END AS back FROM obs) SELECT source_file, CAST(sum(back) AS BIGINT) AS inversions FROM b GROUP BY source_file"""))
def order_inversions(spark, d):
    return times.order_inversions(views.observations(spark, d), "source_file", "line_no", "time")


# ---- projections ----------------------------------------------------------------------------------


@query("packed_coordinates", _with(OBS, "SELECT DISTINCT lat_raw, lon_raw, (lat_raw + 32768) * 65536 + lon_raw + 32768 AS packed, (lat_raw - 2000) * 4500 + lon_raw - 8000 AS flat FROM obs"))
def packed_coordinates(spark, d):
    o = views.observations(spark, d).select("lat_raw", "lon_raw").distinct()
    return o.select("lat_raw", "lon_raw", geo.packed("lat_raw", "lon_raw").alias("packed"), geo.flat_index(F.col("lat_raw"), F.col("lon_raw"), 2000, 8000, 4500).alias("flat"))


@query("flat_round_trip", _with(OBS, "SELECT DISTINCT lat_raw, lon_raw, true AS returns FROM obs"))
def flat_round_trip(spark, d):
    o = packed_coordinates(spark, d)
    lat, lon = geo.from_flat(F.col("flat"), 2000, 8000, 4500)
    return o.select("lat_raw", "lon_raw", ((lat == F.col("lat_raw")) & (lon == F.col("lon_raw"))).alias("returns"))


@query("conic_grid", _with(OBS, f", p AS (SELECT DISTINCT lat_raw, lon_raw, lat_raw / 100.0 AS lat, lon_raw / 100.0 AS lon FROM obs), q AS (SELECT lat_raw, lon_raw, {_X} AS x, {_Y} AS y FROM p) SELECT lat_raw, lon_raw, round(x, 3) AS x, round(y, 3) AS y, CAST(floor(x / 10000) * 10000 AS BIGINT) AS grid_x, CAST(floor(y / 10000) * 10000 AS BIGINT) AS grid_y, CAST(CAST(floor(x / 10000) * 10000 AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / 10000) * 10000 AS BIGINT) AS VARCHAR) AS grid_id FROM q"))
def conic_grid(spark, d):
    o = views.observations(spark, d).select("lat_raw", "lon_raw").distinct()
    x, y = geo.conic(F.col("lon_raw") / 100, F.col("lat_raw") / 100)
    o = o.withColumn("x", x).withColumn("y", y).withColumn("grid_x", geo.cell_origin(F.col("x"))).withColumn("grid_y", geo.cell_origin(F.col("y")))
    return o.select("lat_raw", "lon_raw", _r("x", 3), _r("y", 3), "grid_x", "grid_y", geo.grid_id("grid_x", "grid_y").alias("grid_id"))


@query("conic_inverse", _with(OBS, "SELECT DISTINCT lat_raw, lon_raw, round(lon_raw / 100.0, 7) AS lon, round(lat_raw / 100.0, 7) AS lat FROM obs"))
def conic_inverse(spark, d):
    o = views.observations(spark, d).select("lat_raw", "lon_raw").distinct()
    x, y = geo.conic(F.col("lon_raw") / 100, F.col("lat_raw") / 100)
    lon, lat = geo.conic_inverse("x", "y")
    return o.withColumn("x", x).withColumn("y", y).select("lat_raw", "lon_raw", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("web_mercator", _with(OBS, "SELECT DISTINCT lat_raw, lon_raw, round(6378137.0 * radians(lon_raw / 100.0), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat_raw / 100.0) / 2)), 3) AS y FROM obs"))
def web_mercator(spark, d):
    x, y = geo.web_mercator(F.col("lon_raw") / 100, F.col("lat_raw") / 100)
    return views.observations(spark, d).select("lat_raw", "lon_raw").distinct().select("lat_raw", "lon_raw", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("tenth_degree_keys", _with(OBS, "SELECT round(floor(lon_raw / 100.0 * 10 + 1e-9) / 10, 4) AS grid_lon, round(floor(lat_raw / 100.0 * 10 + 1e-9) / 10, 4) AS grid_lat, count(*) AS n, round(avg(cnt), 6) AS mean_cnt FROM obs GROUP BY 1, 2"))
def tenth_degree_keys(spark, d):
    o = views.observations(spark, d)
    return o.groupBy(geo.tenth_degree(F.col("lon_raw") / 100).alias("grid_lon"), geo.tenth_degree(F.col("lat_raw") / 100).alias("grid_lat")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cnt"), 6).alias("mean_cnt"))


# ---- calibration and exposure ---------------------------------------------------------------------


@query("reference_sums", _with(SUMS, "SELECT strftime(utc_time, '%Y-%m-%d %H:%M:%S') AS utc_time, region, CAST(app_count AS BIGINT) AS app_count FROM sums"))
def reference_sums(spark, d):
    return _sums(spark, d).withColumn("utc_time", scalar.time_text(F.col("utc_time")))


@query("region_weights", _with(WEIGHTS, "SELECT region, region_name, official_population, reference_app_count, n_times, round(expansion_weight, 4) AS expansion_weight FROM weights"))
def region_weights(spark, d):
    return _weights(spark, d).withColumn("expansion_weight", F.round("expansion_weight", 4))


@query("time_scales", _with(SCALES, "SELECT strftime(utc_time, '%Y-%m-%d %H:%M:%S') AS utc_time, round(preliminary_total, 2) AS preliminary_total, round(scaling_factor, 6) AS scaling_factor FROM scales"))
def time_scales(spark, d):
    return _scales(spark, d).select(scalar.time_text(F.col("utc_time")).alias("utc_time"), _r("preliminary_total", 2), _r("scaling_factor", 6))


@query("calibrated_points", _with(CALIBRATED, "SELECT event_id, round(preliminary_population, 2) AS preliminary_population, round(estimated_population, 2) AS estimated_population FROM cal"))
def calibrated_points(spark, d):
    return _calibrated(spark, d).select("event_id", _r("preliminary_population", 2), _r("estimated_population", 2))


@query("raster_match", _with(MATCHED, "SELECT event_id, lat_i, lon_i, pm25 FROM matched"))
def raster_match(spark, d):
    return _matched(spark, d).select("event_id", "lat_i", "lon_i", "pm25")


@query("raster_gaps", _with(MATCHED, "SELECT local_date, local_hour, count(*) AS n, sum(CASE WHEN pm25 IS NULL THEN 1 ELSE 0 END) AS n_missing, round(sum(CASE WHEN pm25 IS NULL THEN estimated_population ELSE 0 END), 1) AS population_missing FROM matched GROUP BY local_date, local_hour"))
def raster_gaps(spark, d):
    void = F.col("pm25").isNull()
    return _matched(spark, d).groupBy("local_date", "local_hour").agg(F.count(F.lit(1)).alias("n"), F.count_if(void).alias("n_missing"), F.round(F.sum(F.when(void, F.col("estimated_population")).otherwise(0)), 1).alias("population_missing"))


@query("snapshot_grid", _with(SNAPSHOT, "SELECT strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, grid_x, grid_y, round(population, 2) AS population, app_count, round(exposure, 1) AS exposure, round(app_exposure, 4) AS app_exposure FROM snap"))
def snapshot_grid(spark, d):
    return _snapshots(spark, d).select(scalar.time_text(F.col("local_time")).alias("local_time"), "grid_x", "grid_y", _r("population", 2), "app_count", _r("exposure", 1), _r("app_exposure"))


@query("hour_weights", _with(HOURS, "SELECT strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, CAST(weight_s AS BIGINT) AS weight_s, CAST(gap_s AS BIGINT) AS gap_s FROM wt"))
def hour_weights(spark, d):
    return times.hour_weights(views.repaired(spark, d)).select(scalar.time_text(F.col("local_time")).alias("local_time"), "weight_s", "gap_s")


@query("hour_quality", _with(HOURS, "SELECT strftime(hour_start, '%Y-%m-%d %H:%M:%S') AS hour_start, sample_count, round(sample_count / 12.0, 6) AS coverage_ratio, round(covered_s / 60.0, 4) AS covered_minutes, round(max_gap_s / 60.0, 4) AS max_gap_minutes, is_complete_hour, method FROM hq"))
def hour_quality(spark, d):
    q = times.hour_quality(times.hour_weights(views.repaired(spark, d)))
    return q.select(scalar.time_text(F.col("hour_start")).alias("hour_start"), "sample_count", _r("coverage_ratio", 6), _r("covered_minutes"), _r("max_gap_minutes"), "is_complete_hour", "method")


@query("hourly_grid", _with(HOURLY, "SELECT local_date, local_hour, grid_x, grid_y, round(population, 2) AS population, round(app_count, 4) AS app_count, round(exposure, 1) AS exposure, round(app_exposure, 4) AS app_exposure, round(pm25, 6) AS pm25, sample_count, is_complete_hour FROM hl"))
def hourly_grid(spark, d):
    return _hourly(spark, d).select("local_date", "local_hour", "grid_x", "grid_y", _r("population", 2), _r("app_count"), _r("exposure", 1), _r("app_exposure"), _r("pm25", 6), "sample_count", "is_complete_hour")


@query("daily_grid", _with(DAILY, "SELECT grid_x, grid_y, local_date, round(population, 2) AS population, round(exposure, 1) AS exposure, round(pm25, 6) AS pm25, round(weighted_pm25, 4) AS weighted_pm25, n_hours, n_complete_hours, round(mean_coverage, 6) AS mean_coverage, round(covered_minutes, 3) AS covered_minutes, round(date_coverage, 6) AS date_coverage, date_is_complete FROM dg"))
def daily_grid(spark, d):
    return _daily(spark, d).select("grid_x", "grid_y", "local_date", _r("population", 2), _r("exposure", 1), _r("pm25", 6), _r("weighted_pm25"), "n_hours", "n_complete_hours", _r("mean_coverage", 6), _r("covered_minutes", 3), _r("date_coverage", 6), "date_is_complete")


@query("period_grid", _with(PERIOD, "SELECT grid_x, grid_y, period, round(population, 2) AS population, round(exposure, 1) AS exposure, round(pm25, 6) AS pm25, n_days, n_hours, n_complete_hours, round(mean_coverage, 6) AS mean_coverage, round(mean_date_coverage, 6) AS mean_date_coverage, has_incomplete_date, round(day_share, 6) AS day_share FROM pg"))
def period_grid(spark, d):
    return _periods(spark, d).select("grid_x", "grid_y", "period", _r("population", 2), _r("exposure", 1), _r("pm25", 6), "n_days", "n_hours", "n_complete_hours", _r("mean_coverage", 6), _r("mean_date_coverage", 6), "has_incomplete_date", _r("day_share", 6))


@query("period_changes", _with(PERIOD, """, w AS (SELECT grid_x, grid_y, max(CASE WHEN period = 'pre' THEN population END) AS a, max(CASE WHEN period = 'festival' THEN population END) AS b, max(CASE WHEN period = 'post' THEN population END) AS c, max(CASE WHEN period = 'pre' THEN pm25 END) AS d, max(CASE WHEN period = 'festival' THEN pm25 END) AS e, max(CASE WHEN period = 'post' THEN pm25 END) AS f FROM pg GROUP BY grid_x, grid_y)
    SELECT grid_x, grid_y, round(b - a, 2) AS festival_pre_population_change, round(c - b, 2) AS post_festival_population_change, round(e - d, 6) AS festival_pre_pm25_change, round(f - e, 6) AS post_festival_pm25_change FROM w"""))
def period_changes(spark, d):
    values = ["population", "pm25"]
    wide = exposure.wide_periods(_periods(spark, d), values, ["pre", "festival", "post"])
    out = exposure.changes(wide, values, [("festival_pre", "pre", "festival"), ("post_festival", "festival", "post")])
    return out.select("grid_x", "grid_y", _r("festival_pre_population_change", 2), _r("post_festival_population_change", 2), _r("festival_pre_pm25_change", 6), _r("post_festival_pm25_change", 6))


@query("national_hours", _with(HOURLY, "SELECT local_date, local_hour, round(sum(population), 1) AS population, round(sum(exposure), 0) AS exposure, round(avg(pm25), 6) AS pm25, count(*) AS n_cells, bool_and(is_complete_hour) AS all_complete FROM hl GROUP BY local_date, local_hour"))
def national_hours(spark, d):
    return _hourly(spark, d).groupBy("local_date", "local_hour").agg(F.round(F.sum("population"), 1).alias("population"), F.round(F.sum("exposure"), 0).alias("exposure"), F.round(F.avg("pm25"), 6).alias("pm25"), F.count(F.lit(1)).alias("n_cells"), F.bool_and("is_complete_hour").alias("all_complete"))


@query("region_totals", _with(MATCHED, "SELECT region, local_date, CAST(sum(cnt) AS BIGINT) AS app_count, round(sum(estimated_population), 1) AS population, round(sum(estimated_population * pm25) / nullif(sum(CASE WHEN pm25 IS NOT NULL THEN estimated_population END), 0), 4) AS weighted_pm25 FROM matched GROUP BY region, local_date"))
def region_totals(spark, d):
    m = _matched(spark, d)
    known = F.when(F.col("pm25").isNotNull(), F.col("estimated_population"))
    return m.groupBy("region", "local_date").agg(F.sum("cnt").alias("app_count"), F.round(F.sum("estimated_population"), 1).alias("population"), F.round(scalar.ratio(F.sum(F.col("estimated_population") * F.col("pm25")), F.sum(known)), 4).alias("weighted_pm25"))


# ---- decomposition --------------------------------------------------------------------------------


@query("decomposition", _with([LINES], "SELECT grid, region, round(mobility, 2) AS mobility, round(pollution, 2) AS pollution, round(interaction, 2) AS interaction, round(total, 2) AS total FROM de"))
def decomposition(spark, d):
    return _contrasts(spark, d).select("grid", "region", *[F.round(f"x_{c}", 2).alias(c) for c in ("mobility", "pollution", "interaction", "total")])


_PARTS = "up AS (SELECT 'mobility' AS component, mobility AS v FROM de UNION ALL SELECT 'pollution', pollution FROM de UNION ALL SELECT 'interaction', interaction FROM de)"


@query("contribution_statistics", _with([LINES, _PARTS], "SELECT component, count(v) AS n, round(avg(v), 3) AS mean, round(median(v), 3) AS median, round(stddev_samp(v), 3) AS sd, round(sum(v), 2) AS total, round(sum(abs(v)), 2) AS abs_total, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative FROM up GROUP BY component"))
def contribution_statistics(spark, d):
    s = exposure.contribution_statistics(_contrasts(spark, d).select(*[F.col(f"x_{c}").alias(c) for c in ("mobility", "pollution", "interaction")]), ["mobility", "pollution", "interaction"])
    return s.select("component", "n", _r("mean", 3), _r("median", 3), _r("sd", 3), _r("total", 2), _r("abs_total", 2), "n_positive", "n_negative")


@query("grouped_totals", _with([LINES], "SELECT region, region IS NULL AS is_national, count(*) AS n, round(sum(mobility), 2) AS mobility, round(sum(pollution), 2) AS pollution FROM de GROUP BY GROUPING SETS ((), (region))"))
def grouped_totals(spark, d):
    g = exposure.grouped_totals(_contrasts(spark, d), "region", ["x_mobility", "x_pollution"])
    return g.select("region", "is_national", "n", F.round("x_mobility", 2).alias("mobility"), F.round("x_pollution", 2).alias("pollution"))


@query("identity_check", _with([LINES], "SELECT max(abs(mobility + pollution + interaction - total)) <= greatest(1e-8, max(abs(total)) * 1e-10) AS holds FROM de"))
def identity_check(spark, d):
    return exposure.identity_holds(_contrasts(spark, d), "x").select("holds")


@query("accounting_benchmark", _with([LINES], "SELECT round(1 - sum(pow(pollution - p0 * (c1 - c0), 2)) / (count(*) * var_pop(pollution)), 6) AS r2, round(max(abs(pollution - p0 * (c1 - c0))), 6) AS worst, count(*) AS n FROM de"))
def accounting_benchmark(spark, d):
    c = _contrasts(spark, d).withColumn("prediction", F.col("p0") * (F.col("c1") - F.col("c0")))
    worst = c.agg(F.round(F.max(F.abs(F.col("x_pollution") - F.col("prediction"))), 6).alias("worst"))
    return models.metrics(c, "x_pollution", "prediction").select(_r("r2", 6), "n").crossJoin(worst)


# ---- quality --------------------------------------------------------------------------------------


@query("spatial_gate", _with(OBS, "SELECT count(*) AS records, CAST(sum(CASE WHEN lat_raw < 4400 THEN 1 ELSE 0 END) AS BIGINT) AS matched_records, CAST(sum(CASE WHEN lat_raw < 4400 THEN 0 ELSE cnt END) AS BIGINT) AS unmatched_app_count, round(sum(CASE WHEN lat_raw < 4400 THEN 0 ELSE 1 END) / count(*), 6) AS unmatched_share, sum(CASE WHEN lat_raw < 4400 THEN 0 ELSE 1 END) / count(*) <= 0.01 AS passes FROM rep"))
def spatial_gate(spark, d):
    g = quality.spatial_gate(views.repaired(spark, d), F.col("lat_raw") < 4400)
    return g.select("records", "matched_records", "unmatched_app_count", _r("unmatched_share", 6), "passes")


@query("rule_violations", _with(OBS, "SELECT CAST(sum(CASE WHEN cnt > 0 THEN 0 ELSE 1 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN time <> '' THEN 0 ELSE 1 END) AS BIGINT) AS timed, CAST(sum(CASE WHEN lon_raw BETWEEN 8000 AND 12000 THEN 0 ELSE 1 END) AS BIGINT) AS in_domain FROM obs"))
def rule_violations(spark, d):
    return quality.violations(views.observations(spark, d), {"positive": F.col("cnt") > 0, "timed": F.col("time") != "", "in_domain": F.col("lon_raw").between(8000, 12000)})


@query("anomaly_flags", _with([OBS, "ds AS (SELECT local_date, CAST(sum(cnt) AS DOUBLE) AS v FROM rep GROUP BY local_date), m AS (SELECT median(v) AS m FROM ds), k AS (SELECT median(abs(ds.v - m.m)) AS mad FROM ds, m), t AS (SELECT CASE WHEN mad > 0 THEN greatest(0, m - 6 * 1.4826 * mad) ELSE greatest(0, m * 0.25) END AS low, CASE WHEN mad > 0 THEN m + 6 * 1.4826 * mad ELSE m * 4 END AS high FROM m, k)"], "SELECT ds.local_date, ds.v, round(t.low, 6) AS low_threshold, round(t.high, 6) AS high_threshold, ds.v < t.low AS is_low, ds.v > t.high AS is_high FROM ds, t"))
def anomaly_flags(spark, d):
    days = views.repaired(spark, d).groupBy("local_date").agg(F.sum("cnt").cast("double").alias("v"))
    return quality.anomaly_flags(days, "v", "local_date").select("local_date", "v", _r("low_threshold", 6), _r("high_threshold", 6), "is_low", "is_high")


@query("scale_distribution", _with(SCALES, "SELECT count(scaling_factor) AS n, round(min(scaling_factor), 6) AS min, round(avg(scaling_factor), 6) AS mean, round(stddev_samp(scaling_factor), 6) AS sd, round(quantile_cont(scaling_factor, 0.01), 6) AS p01, round(quantile_cont(scaling_factor, 0.5), 6) AS p50, round(quantile_cont(scaling_factor, 0.99), 6) AS p99 FROM scales"))
def scale_distribution(spark, d):
    return quality.distribution(_scales(spark, d), "scaling_factor").select("n", _r("min", 6), _r("mean", 6), _r("sd", 6), _r("p01", 6), _r("p50", 6), _r("p99", 6))


@query("region_series_summary", _with(SUMS, "SELECT region, count(DISTINCT utc_time) AS n_times, CAST(min(app_count) AS BIGINT) AS min, round(avg(app_count), 4) AS mean, median(app_count) AS median, CAST(max(app_count) AS BIGINT) AS max, round(stddev_samp(app_count), 4) AS sd FROM sums GROUP BY region"))
def region_series_summary(spark, d):
    return _sums(spark, d).groupBy("region").agg(F.countDistinct("utc_time").alias("n_times"), F.min("app_count").alias("min"), F.round(F.avg("app_count"), 4).alias("mean"), F.median("app_count").alias("median"), F.max("app_count").alias("max"), F.round(F.stddev_samp("app_count"), 4).alias("sd"))


@query("weight_flags", _with([*CHAIN[:4], "lm AS (SELECT quantile_cont(expansion_weight, 0.1) AS a, quantile_cont(expansion_weight, 0.9) AS b, quantile_cont(ln(expansion_weight), 0.25) AS l, quantile_cont(ln(expansion_weight), 0.75) AS h FROM weights)"], "SELECT region, expansion_weight <= a AS is_low, expansion_weight >= b AS is_high, ln(expansion_weight) < l - 1.5 * (h - l) OR ln(expansion_weight) > h + 1.5 * (h - l) AS is_log_outlier FROM weights, lm"))
def weight_flags(spark, d):
    return quality.weight_flags(_weights(spark, d), "expansion_weight").select("region", "is_low", "is_high", "is_log_outlier")


@query("weight_ranks", _with(WEIGHTS, "SELECT region, dense_rank() OVER (ORDER BY expansion_weight DESC) AS rank FROM weights"))
def weight_ranks(spark, d):
    return quality.ranked(_weights(spark, d), "expansion_weight").select("region", F.col("rank").cast("long").alias("rank"))


@query("extreme_weights", _with(WEIGHTS, "(SELECT 'top' AS side, region FROM weights ORDER BY expansion_weight DESC NULLS LAST, region LIMIT 5) UNION ALL (SELECT 'bottom', region FROM weights ORDER BY expansion_weight NULLS LAST, region LIMIT 5)"))
def extreme_weights(spark, d):
    w = _weights(spark, d)
    top = w.orderBy(F.desc_nulls_last("expansion_weight"), "region").limit(5).select(F.lit("top").alias("side"), "region")
    return top.unionByName(w.orderBy(F.asc_nulls_last("expansion_weight"), "region").limit(5).select(F.lit("bottom").alias("side"), "region"))


@query("group_shares", _with([LINES], "SELECT grid, round(p0 / nullif(sum(p0) OVER (PARTITION BY region), 0), 8) AS group_share FROM de"))
def group_shares(spark, d):
    return quality.share_of_group(_contrasts(spark, d), "region", "p0").select("grid", _r("group_share", 8))


@query("value_diagnostics", "SELECT count(*) AS n, count(value) AS n_present, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value = 0 THEN 1 ELSE 0 END), 6) AS zero_share FROM events")
def value_diagnostics(spark, d):
    return quality.value_diagnostics(views.table(spark, d, "events"), "value").select("n", "n_present", "min", "max", _r("median", 6), _r("p95", 6), _r("zero_share", 6))


@query("robust_limits", _with([LINES, "pv AS (SELECT mobility AS v FROM de UNION ALL SELECT pollution FROM de), lm AS (SELECT greatest(abs(quantile_cont(v, 0.02)), abs(quantile_cont(v, 0.98))) AS r FROM pv)"], "SELECT round(-max(r), 3) AS lo, round(max(r), 3) AS hi, CAST(sum(CASE WHEN v < -r THEN 1 ELSE 0 END) AS BIGINT) AS n_below, CAST(sum(CASE WHEN v > r THEN 1 ELSE 0 END) AS BIGINT) AS n_above FROM pv, lm"))
def robust_limits(spark, d):
    return quality.robust_limits(_contrasts(spark, d), ["x_mobility", "x_pollution"], True).select(_r("lo", 3), _r("hi", 3), "n_below", "n_above")


@query("duplicate_scan", _with(OBS, "SELECT time, count(*) AS n_rows, count(*) - count(DISTINCT lat_raw * 100000 + lon_raw) AS repeated_coordinates, count(*) - count(DISTINCT (lat_raw * 100000 + lon_raw) * 1000000 + cnt) AS repeated_records FROM obs GROUP BY time"))
def duplicate_scan(spark, d):
    return quality.duplicate_scan(views.observations(spark, d), "time", ["lat_raw", "lon_raw"], "cnt")


@query("set_agreement", "SELECT DISTINCT c_custkey AS value, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) UNION ALL SELECT DISTINCT user_id, 'right' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def set_agreement(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return quality.same_sets(c, views.table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query("covariate_coverage", "SELECT 'n_orders' AS field, count(o.n) AS n_present, round(count(o.n) / count(*), 6) AS share FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey UNION ALL SELECT 'c_acctbal', count(c_acctbal), round(count(c_acctbal) / count(*), 6) FROM customer")
def covariate_coverage(spark, d):
    o = views.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = views.table(spark, d, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")
    return quality.coverage(c, ["n_orders", "c_acctbal"]).select("field", "n_present", _r("share", 6))


@query("manifest_update", "SELECT o_custkey AS key, max(o_orderkey) AS last_order, count(*) > 0 AS present FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey UNION ALL SELECT o_custkey, max(o_orderkey), count(*) > 0 FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_custkey")
def manifest_update(spark, d):
    o = views.table(spark, d, "orders")
    part = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("last_order"), F.lit(True).alias("present"))
    return newest_per_key(part(0), part(1), "key")


@query("parsed_totals", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS parsed, lower(trim(o_orderstatus)) IN ('true', '1', 'yes') AS flag FROM orders")
def parsed_totals(spark, d):
    o = views.table(spark, d, "orders")
    text = F.concat(F.lit(" "), F.format_number(F.round("o_totalprice"), 0), F.lit(" "))
    return o.select("o_orderkey", scalar.parsed_number(text).cast("long").alias("parsed"), scalar.truthy(F.col("o_orderstatus")).alias("flag"))


@query("compare_versions", "SELECT 'p_retailprice' AS name, round(max(p_retailprice * 1e-9), 9) AS max_difference, true AS within FROM part")
def compare_versions(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", "p_retailprice")
    q = p.withColumn("p_retailprice", F.col("p_retailprice") * (1 + 1e-9))
    return quality.compare_tables(p, q, "p_partkey", ["p_retailprice"]).select("name", _r("max_difference", 9), "within")


@query("row_sums", "SELECT c_custkey, CASE WHEN c_acctbal > 0 OR c_nationkey > 12 THEN CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END + CASE WHEN c_nationkey > 12 THEN c_nationkey ELSE 0 END END AS total FROM customer")
def row_sums(spark, d):
    c = views.table(spark, d, "customer")
    return c.select("c_custkey", scalar.sum_present(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("double"))).alias("total"))


# ---- space ----------------------------------------------------------------------------------------

# Test regions; 2 is concave, 0 and 1 share an edge, 3 has a hole.
POLYGONS = {
    0: [[(80.0, 20.0), (100.0, 20.0), (100.0, 30.0), (80.0, 30.0)]],
    1: [[(100.0, 20.0), (115.0, 20.0), (115.0, 30.0), (100.0, 30.0)]],
    2: [[(80.0, 32.0), (100.0, 32.0), (100.0, 36.0), (90.0, 36.0), (90.0, 44.0), (80.0, 44.0)]],
    3: [[(102.0, 32.0), (120.0, 32.0), (120.0, 44.0), (102.0, 44.0)], [(106.0, 35.0), (110.0, 35.0), (110.0, 40.0), (106.0, 40.0)]],
}


@query("point_in_polygon", _with([OBS, "p AS (SELECT event_id, lon_raw / 100.0 AS x, lat_raw / 100.0 AS y FROM obs), h AS (SELECT event_id, x, y, x BETWEEN 80 AND 100 AND y BETWEEN 20 AND 30 AS a, x BETWEEN 100 AND 115 AND y BETWEEN 20 AND 30 AS b, (x BETWEEN 80 AND 100 AND y BETWEEN 32 AND 36) OR (x BETWEEN 80 AND 90 AND y BETWEEN 32 AND 44) AS c, x BETWEEN 102 AND 120 AND y BETWEEN 32 AND 44 AND NOT (x > 106 AND x < 110 AND y > 35 AND y < 40) AS d FROM p)"], "SELECT event_id, CASE WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 WHEN d THEN 3 END AS region FROM h"))
def point_in_polygon(spark, d):
    o = views.observations(spark, d).drop("region").withColumn("lon", F.col("lon_raw") / 100).withColumn("lat", F.col("lat_raw") / 100)
    return spatial.assign_regions(o, "lon", "lat", POLYGONS).select("event_id", "region")


@query("region_overlap")
def region_overlap(spark, d):
    o = views.observations(spark, d).drop("region").withColumn("lon", F.col("lon_raw") / 100).withColumn("lat", F.col("lat_raw") / 100)
    outside = spatial.assign_regions(o, "lon", "lat", POLYGONS).where("region is null").drop("region")
    return spatial.largest_overlap(outside, "lon", "lat", POLYGONS, 1.0).select("event_id", "overlap_region", "n_overlaps")


@query("nearest_region")
def nearest_region(spark, d):
    o = views.observations(spark, d).select("event_id", (F.col("lon_raw") / 100).alias("x"), (F.col("lat_raw") / 100).alias("y"))
    return spatial.nearest_region(o, "x", "y", POLYGONS, 0.5).select("event_id", "nearest_region", "distance")


@query("distance_band", _with([MAP], "SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS dst_sum FROM ed GROUP BY src"))
def distance_band(spark, d):
    return spatial.band_sums(_map(spark, d), "key", "x", "y", 50_000.0, ["key"]).withColumnRenamed("key", "dst_sum")


@query("spatial_lag", _with([MAP], "SELECT key, round(z, 4) + 0.0 AS z, round(lag, 4) + 0.0 AS lag, n_neighbours FROM la"))
def spatial_lag(spark, d):
    return _lagged(spark, d).select("key", (F.round("z", 4) + 0.0).alias("z"), (F.round("lag", 4) + 0.0).alias("lag"), "n_neighbours")


@query("global_moran", _with([MAP], "SELECT round(count(*) / sum(CASE WHEN n_neighbours > 0 THEN 1.0 ELSE 0 END) * sum(z * lag) / sum(z * z), 9) AS moran_i, round(-1.0 / (count(*) - 1), 12) AS expected_i, count(*) AS n, CAST(sum(CASE WHEN n_neighbours = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_islands FROM la"))
def global_moran(spark, d):
    return spatial.global_moran(_lagged(spark, d)).select(_r("moran_i", 9), _r("expected_i", 12), "n", "n_islands")


@query("local_moran", _with([MAP], "SELECT key, round((count(*) OVER () - 1) * z * lag / sum(z * z) OVER (), 8) + 0.0 AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM la"))
def local_moran(spark, d):
    return spatial.local_moran(_lagged(spark, d), "key").select("key", (F.round("local_i", 8) + 0.0).alias("local_i"), "quadrant")


@query("lisa_clusters")
def lisa_clusters(spark, d):
    local = spatial.local_significance(spatial.local_moran(_lagged(spark, d), "key"), "key")
    return quality.counts_by_category(spatial.lisa_clusters(local), "cluster", ["HH", "LL", "HL", "LH", "Not significant", "NoData"])


@query("moran_permutations")
def moran_permutations(spark, d):
    return spatial.band_permutation_test(spark, _map(spark, d), "key", "x", "y", 50_000.0, "c_acctbal")


@query("category_counts", "SELECT s.s AS o_orderstatus, count(o.o_orderkey) AS n, round(count(o.o_orderkey) / sum(count(o.o_orderkey)) OVER (), 8) AS share FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) s LEFT JOIN orders o ON o.o_orderstatus = s.s GROUP BY s.s")
def category_counts(spark, d):
    return quality.counts_by_category(views.table(spark, d, "orders").select("o_orderstatus"), "o_orderstatus", ["F", "O", "P", "X"]).withColumn("share", F.round("share", 8))


# ---- models ---------------------------------------------------------------------------------------

FEATURES = ["c_acctbal", "n_orders", "mean_price"]


@query("dynamic_features", _with([OBS, """hv AS (SELECT region AS grid_id, local_date, local_hour, CAST(sum(cnt) AS DOUBLE) AS v FROM rep GROUP BY region, local_date, local_hour),
    ds AS (SELECT grid_id, local_date, sum(v) AS s FROM hv GROUP BY grid_id, local_date),
    ft AS (SELECT grid_id, avg(s) AS mean, stddev_samp(s) AS sd, count(s) AS n_days FROM ds WHERE s >= 0 GROUP BY grid_id),
    hp AS (SELECT *, local_hour BETWEEN 8 AND 19 AS is_day FROM hv WHERE v >= 0),
    dn AS (SELECT grid_id, avg(v) FILTER (WHERE is_day) AS dm, avg(v) FILTER (WHERE NOT is_day) AS nm, count(*) FILTER (WHERE is_day) AS dh, count(*) FILTER (WHERE NOT is_day) AS nh, avg(v) AS hm FROM hp GROUP BY grid_id),
    gd AS (SELECT grid_id, local_date, count(DISTINCT local_hour) AS h, max(v) - min(v) AS a FROM hp GROUP BY grid_id, local_date),
    am AS (SELECT grid_id, avg(a) AS amp, count(DISTINCT local_date) AS days, min(h) AS least FROM gd WHERE h >= 18 GROUP BY grid_id)"""], """SELECT coalesce(ft.grid_id, dn.grid_id) AS grid_id, ft.n_days, round(CASE WHEN ft.n_days >= 10 THEN ft.sd / nullif(ft.mean, 0) END, 8) AS cv,
        dn.dh AS day_hours, dn.nh AS night_hours, round(CASE WHEN dn.dh + dn.nh >= 180 THEN dn.dm / nullif(dn.nm, 0) END, 8) AS day_night_ratio, am.days AS n_hour_days, am.least AS least_hours,
        round(CASE WHEN am.days >= 10 THEN am.amp END, 4) AS mean_amplitude, round(CASE WHEN am.days >= 10 THEN am.amp / nullif(dn.hm, 0) END, 8) AS relative_amplitude
    FROM ft FULL JOIN dn ON ft.grid_id = dn.grid_id LEFT JOIN am ON am.grid_id = dn.grid_id"""))
def dynamic_features(spark, d):
    h = views.repaired(spark, d).groupBy(F.col("region").alias("grid_id"), "local_date", "local_hour").agg(F.sum("cnt").cast("double").alias("v"))
    daily = h.groupBy("grid_id", "local_date").agg(F.sum("v").alias("v"))
    f = models.dynamic_features(daily, h, "v", 10)
    return f.select("grid_id", "n_days", _r("cv", 8), "day_hours", "night_hours", _r("day_night_ratio", 8), "n_hour_days", "least_hours", _r("mean_amplitude"), _r("relative_amplitude", 8))


@query("day_period_pivot", _with(OBS, "SELECT region, round(avg(CASE WHEN local_hour BETWEEN 8 AND 19 THEN cnt END), 6) AS day, round(avg(CASE WHEN local_hour BETWEEN 8 AND 19 THEN NULL ELSE cnt END), 6) AS night FROM rep GROUP BY region"))
def day_period_pivot(spark, d):
    r = views.repaired(spark, d).withColumn("day_period", F.when(F.col("local_hour").between(8, 19), "day").otherwise("night"))
    return r.groupBy("region").pivot("day_period", ["day", "night"]).agg(F.round(F.avg("cnt"), 6))


@query("model_metrics", "SELECT round(1 - sum(pow(l_extendedprice - 1000 * l_quantity, 2)) / (count(*) * var_pop(l_extendedprice)), 6) AS r2, round(sqrt(avg(pow(l_extendedprice - 1000 * l_quantity, 2))), 3) AS rmse, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 3) AS mae, count(*) AS n FROM lineitem")
def model_metrics(spark, d):
    li = views.table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return models.metrics(li, "l_extendedprice", "p").select(_r("r2", 6), _r("rmse", 3), _r("mae", 3), "n")


@query("spatial_folds")
def spatial_folds(spark, d):
    return models.spatial_folds(_customers(spark, d), "x", "y").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("n_blocks"))


@query("spatial_cross_validation")
def spatial_cross_validation(spark, d):
    data = models.spatial_folds(_customers(spark, d), "x", "y").select("key", "target", "fold", *FEATURES)
    return models.cross_validate(data, models.forest(FEATURES, "target", trees=10, depth=5), "target")


@query("tree_attributions")
def tree_attributions(spark, d):
    data = models.seeded_split(_customers(spark, d), "key")
    fitted = models.fit(models.boosted(FEATURES, "target", trees=10, rate=0.3, depth=4), data.where("not is_test"))
    return models.mean_absolute(models.attributions(data, fitted.stages[-1], FEATURES, "key"), FEATURES)


@query("residuals")
def residuals(spark, d):
    data = models.seeded_split(_customers(spark, d), "key")
    fitted = models.fit(models.forest(FEATURES, "target", trees=20, depth=6), data.where("not is_test"))
    out = fitted.transform(data.where("is_test"))
    return out.select("key", "target", "prediction", (F.col("target") - F.col("prediction")).alias("residual"))


@query("even_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) x WHERE i IN (SELECT CAST(round(k * (n - 1) / 9.0) AS BIGINT) FROM (SELECT unnest(range(0, 10)) AS k) y, (SELECT count(*) AS n FROM orders) z)")
def even_sample(spark, d):
    return quality.evenly_spaced(views.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10)


@query("previous_gap", "SELECT event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS BIGINT) AS gap_us FROM events")
def previous_gap(spark, d):
    e = views.table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", (micros - F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts"))).alias("gap_us"))


# ---- tables ---------------------------------------------------------------------------------------


@query("file_summary", _with(OBS, "SELECT source_file, count(*) AS n_rows, CAST(sum(cnt) AS BIGINT) AS total, string_agg(DISTINCT CAST(region AS VARCHAR), ',' ORDER BY CAST(region AS VARCHAR)) AS region_values, round(count(*) / sum(count(*)) OVER (), 8) AS row_share, round(sum(cnt) / sum(sum(cnt)) OVER (), 8) AS total_share FROM obs GROUP BY source_file"))
def file_summary(spark, d):
    return tables.file_summary(views.observations(spark, d), "source_file", "cnt", ["region"]).withColumns({"row_share": F.round("row_share", 8), "total_share": F.round("total_share", 8)})


@query("utc_dates_used", _with(OBS, "SELECT local_date, local_hour, string_agg(DISTINCT utc_date, ',' ORDER BY utc_date) AS utc_dates, count(DISTINCT utc_date) AS n_utc_dates FROM rep GROUP BY local_date, local_hour"))
def utc_dates_used(spark, d):
    return tables.utc_dates_used(views.repaired(spark, d), ["local_date", "local_hour"])


@query("official_population", "SELECT n_name, 1000000 * (CAST(n_nationkey AS BIGINT) + 1) AS official_population FROM nation")
def official_population(spark, d):
    n = views.official_totals(spark, d)
    text = n.select(F.col("region_name").alias("n_name"), F.format_number("official_population", 0).alias("t"))
    total = n.agg(F.lit("Total").alias("n_name"), F.format_number(F.sum("official_population"), 0).alias("t"))
    return tables.official_population(text.unionByName(total), "n_name", "t", n.select(F.col("region_name").alias("n_name")))


@query("status_labels", "SELECT o_orderstatus, CASE ascii(o_orderstatus) WHEN 70 THEN 'finished' WHEN 79 THEN 'open' ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def status_labels(spark, d):
    o = views.table(spark, d, "orders")
    return o.groupBy("o_orderstatus", tables.code_labels(F.ascii("o_orderstatus"), {70: "finished", 79: "open"}, "other").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders) x WHERE n = 1")
def first_per_key(spark, d):
    o = views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.first_per_key(o, ["o_custkey"], [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("merged_covariates", _with(OBS, ", src AS (SELECT round(lon_raw / 100.0, 4) AS lon, round(lat_raw / 100.0, 4) AS lat, avg(cnt) AS road FROM obs WHERE region < 20 GROUP BY 1, 2), b AS (SELECT DISTINCT round(lon_raw / 100.0, 4) AS lon, round(lat_raw / 100.0, 4) AS lat FROM obs) SELECT b.lon, b.lat, round(s.road, 6) AS road FROM b LEFT JOIN src s ON b.lon = s.lon AND b.lat = s.lat"))
def merged_covariates(spark, d):
    o = views.observations(spark, d).select((F.col("lon_raw") / 100).alias("lon"), (F.col("lat_raw") / 100).alias("lat"), F.col("cnt").alias("road"), "region")
    source = tables.covariate_source(o.where("region < 20"), ["lon", "lat"], ["road"])
    base = o.select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat")).distinct()
    return tables.merge_source(base, source, ["lon", "lat"], ["road"]).withColumn("road", F.round("road", 6))


@query("cleaned_inputs", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_acctbal AS balance_change, CASE WHEN c_acctbal - 100 > 0 THEN c_acctbal - 100 END AS x_mean_pm25 FROM customer")
def cleaned_inputs(spark, d):
    c = views.table(spark, d, "customer")
    return tables.cleaned_inputs(c.select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_acctbal").alias("balance_change"), (F.col("c_acctbal") - 100).alias("x_mean_pm25")))


@query("supported_grid", "SELECT c_custkey, o.n, o.n IS NOT NULL AS is_supported FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def supported_grid(spark, d):
    o = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return tables.supported(views.table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("shared_keys", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def shared_keys(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


# ---- gates, checks and small tables ---------------------------------------------------------------


@query("hour_rule", _with(HOURS, "SELECT strftime(hour_start, '%Y-%m-%d %H:%M:%S') AS hour_start, sample_count, is_complete_hour FROM hq WHERE sample_count / 12.0 >= 0.75"))
def hour_rule(spark, d):
    q = times.hour_quality(times.hour_weights(views.repaired(spark, d)))
    return exposure.covered_hours(q, 0.75).select(scalar.time_text(F.col("hour_start")).alias("hour_start"), "sample_count", "is_complete_hour")


@query("hour_checks", _with(HOURLY, """SELECT CAST(sum(CASE WHEN strftime(hour_start, '%H') <> lpad(CAST(local_hour AS VARCHAR), 2, '0') OR strftime(hour_start, '%Y-%m-%d') <> local_date THEN 1 ELSE 0 END) AS BIGINT) AS time_agrees,
    CAST(sum(CASE WHEN population IS NULL OR exposure IS NULL OR pm25 IS NULL OR isinf(population) OR isinf(exposure) OR isinf(pm25) THEN 1 ELSE 0 END) AS BIGINT) AS finite,
    CAST(sum(CASE WHEN population < 0 OR exposure < 0 OR pm25 < 0 OR population IS NULL OR exposure IS NULL OR pm25 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_negative,
    CAST(sum(CASE WHEN population > 0 AND abs(pm25 - exposure / population) > 1e-10 + 1e-8 * abs(exposure / population) THEN 1 ELSE 0 END) AS BIGINT) AS ratio_agrees,
    count(*) - count(DISTINCT (hour_start, grid_x, grid_y)) AS repeated_keys FROM hl"""))
def hour_checks(spark, d):
    return quality.hour_checks(_hourly(spark, d))


@query("infinite_counts", "SELECT 'l_extendedprice' AS field, count(l_extendedprice) AS n_present, CAST(0 AS BIGINT) AS n_infinite FROM lineitem UNION ALL SELECT 'per_discount', count(*), CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem")
def infinite_counts(spark, d):
    li = views.table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double"), F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1 / F.col("l_discount").cast("double")).alias("per_discount"))
    return quality.infinite_counts(li, ["l_extendedprice", "per_discount"])


@query("reconciliation", _with(CALIBRATED, "SELECT 'records' AS measure, CAST((SELECT count(*) FROM rep) AS DOUBLE) AS expected, CAST(count(*) AS DOUBLE) AS found, count(*) = (SELECT count(*) FROM rep) AS agrees FROM cal UNION ALL SELECT 'app_count', CAST((SELECT sum(cnt) FROM rep) AS DOUBLE), CAST(sum(cnt) AS DOUBLE), sum(cnt) = (SELECT sum(cnt) FROM rep) FROM cal"))
def reconciliation(spark, d):
    measures = {"records": F.count(F.lit(1)), "app_count": F.sum("cnt")}
    return quality.reconciliation(views.repaired(spark, d).agg(*[m.alias(c) for c, m in measures.items()]), _calibrated(spark, d).agg(*[m.alias(c) for c, m in measures.items()]))


@query("read_back_checks", _with(CALIBRATED, """SELECT CAST(sum(CASE WHEN local_time - utc_time <> INTERVAL 8 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS local_offset, CAST(sum(CASE WHEN strftime(local_time, '%Y-%m-%d') <> local_date THEN 1 ELSE 0 END) AS BIGINT) AS local_partition,
    CAST(sum(CASE WHEN strftime(utc_time, '%Y-%m-%d') <> utc_date THEN 1 ELSE 0 END) AS BIGINT) AS utc_partition, CAST(sum(CASE WHEN cnt IS NULL OR cnt < 0 THEN 1 ELSE 0 END) AS BIGINT) AS count_present,
    CAST(sum(CASE WHEN estimated_population IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS estimate_present, CAST(sum(CASE WHEN estimated_population < 0 THEN 1 ELSE 0 END) AS BIGINT) AS estimate_not_negative, CAST(sum(CASE WHEN region IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS region_present,
    CAST(sum(CASE WHEN cnt = 0 AND estimated_population <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_stays_zero FROM cal"""))
def read_back_checks(spark, d):
    return quality.read_back_checks(_calibrated(spark, d))


@query("read_back_totals", _with(CALIBRATED, "SELECT local_date, region, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS app_count, round(sum(estimated_population), 1) AS population FROM cal GROUP BY GROUPING SETS ((local_date, region), (local_date), ())"))
def read_back_totals(spark, d):
    return quality.read_back_totals(_calibrated(spark, d), "local_date", "region").select("local_date", "region", "records", "app_count", _r("population", 1))


@query("category_counts_by_group", "SELECT p.o_orderpriority, s.s AS o_orderstatus, count(o.o_orderkey) AS n, round(count(o.o_orderkey) / sum(count(o.o_orderkey)) OVER (PARTITION BY p.o_orderpriority), 8) AS share FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS s) s LEFT JOIN orders o ON o.o_orderstatus = s.s AND o.o_orderpriority = p.o_orderpriority GROUP BY p.o_orderpriority, s.s")
def category_counts_by_group(spark, d):
    o = views.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus")
    return quality.counts_by_category(o, "o_orderstatus", ["F", "O", "P", "X"], "o_orderpriority").withColumn("share", F.round("share", 8))


@query("legacy_aliases", _with(HOURLY, "SELECT local_date AS date, local_hour AS hour, grid_x, grid_y, round(population, 2) AS total_count, round(exposure, 1) AS total_exposure, round(pm25, 6) AS weighted_pm25 FROM hl"))
def legacy_aliases(spark, d):
    h = tables.legacy_aliases(_hourly(spark, d))
    return h.select("date", "hour", "grid_x", "grid_y", _r("total_count", 2), _r("total_exposure", 1), _r("weighted_pm25", 6))


@query("comparison_names", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'festival_pre' WHEN p_partkey % 3 = 1 THEN 'post_festival' ELSE 'other' END AS comparison FROM part")
def comparison_names(spark, d):
    names = F.element_at(F.array(F.lit("festival_pre_x"), F.lit("post_festival_y"), F.lit("pre_mean_z")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return views.table(spark, d, "part").select("p_partkey", tables.comparison_of(names).alias("comparison"))


@query("scale_exponents", "SELECT o_orderpriority, CASE WHEN max(abs(v)) = 0 OR abs(floor(log10(max(abs(v))))) < 4 THEN 0 ELSE CAST(floor(log10(max(abs(v)))) AS INTEGER) END AS exponent FROM (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) * CASE WHEN o_orderpriority LIKE '1%' THEN 0.001 ELSE 1 END AS v FROM orders) x GROUP BY o_orderpriority")
def scale_exponents(spark, d):
    v = F.col("o_totalprice").cast("double") * F.when(F.col("o_orderpriority").startswith("1"), 0.001).otherwise(1.0)
    return views.table(spark, d, "orders").groupBy("o_orderpriority").agg(tables.scale_exponent(F.max(F.abs(v))).alias("exponent"))


@query("lookup_join", _with([OBS, "lk AS (SELECT DISTINCT lat_raw, lon_raw, (lat_raw * 7 + lon_raw) % 26 AS code FROM obs WHERE lat_raw BETWEEN 2100 AND 4300)"], """SELECT o.region, count(*) AS records, CAST(sum(CASE WHEN o.lat_raw BETWEEN 2100 AND 4300 AND o.lon_raw BETWEEN 8100 AND 12300 THEN 1 ELSE 0 END) AS BIGINT) AS in_domain,
    CAST(sum(CASE WHEN o.lat_raw BETWEEN 2100 AND 4300 AND o.lon_raw BETWEEN 8100 AND 12300 AND lk.code > 0 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM obs o LEFT JOIN lk ON o.lat_raw = lk.lat_raw AND o.lon_raw = lk.lon_raw GROUP BY o.region"""))
def lookup_join(spark, d):
    o = views.observations(spark, d)
    lookup = o.where("lat_raw between 2100 and 4300").select("lat_raw", "lon_raw", ((F.col("lat_raw") * 7 + F.col("lon_raw")) % 26).cast("int").alias("code")).distinct()
    found = spatial.lookup_join(o, lookup, "lat_raw", "lon_raw", (2100, 4300, 8100, 12300))
    return found.groupBy("region").agg(F.count(F.lit(1)).alias("records"), F.count_if("in_domain").alias("in_domain"), F.count_if("is_inside").alias("inside"))


@query("union_means", "SELECT k, avg(a) AS a, avg(b) AS b FROM (SELECT s_nationkey AS k, CAST(s_acctbal AS DOUBLE) AS a, NULL::DOUBLE AS b FROM supplier UNION ALL SELECT c_nationkey, CAST(c_acctbal AS DOUBLE), CAST(c_custkey AS DOUBLE) FROM customer) x GROUP BY k".replace("avg(a) AS a, avg(b) AS b", "round(avg(a), 4) AS a, round(avg(b), 4) AS b"))
def union_means(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").cast("double").alias("a"))
    c = views.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").cast("double").alias("a"), F.col("c_custkey").cast("double").alias("b"))
    return tables.union_means([s, c], "k").select("k", _r("a"), _r("b"))


@query("unrecoverable_records", _with(OBS, "SELECT source_date, source_file, line_no, cnt, lat_raw, lon_raw, 'unrecoverable' AS time_status, FALSE AS is_used FROM obs WHERE event_id % 97 = 0 AND event_id % 194 <> 0"))
def unrecoverable_records(spark, d):
    rows = times.with_audit(views.observations(spark, d).drop("utc_true"), views.blank_time_audit(spark, d))
    return tables.unrecoverable_records(rows).select("source_date", "source_file", "line_no", "cnt", "lat_raw", "lon_raw", "time_status", "is_used")


@query("cell_centres", _with(HOURLY, f"SELECT DISTINCT grid_x, grid_y, CAST(grid_x AS VARCHAR) || '_' || CAST(grid_y AS VARCHAR) AS grid_id FROM hl"))
def cell_centres(spark, d):
    return exposure.add_cell_centres(_snapshots(spark, d).select("grid_x", "grid_y").distinct()).select("grid_x", "grid_y", "grid_id")


@query("day_period_counts", _with(OBS, "SELECT region, round(avg(cnt) FILTER (WHERE local_hour BETWEEN 8 AND 19), 6) AS day_mean, count(cnt) FILTER (WHERE local_hour BETWEEN 8 AND 19) AS day_n, round(avg(cnt) FILTER (WHERE NOT local_hour BETWEEN 8 AND 19), 6) AS night_mean, count(cnt) FILTER (WHERE NOT local_hour BETWEEN 8 AND 19) AS night_n FROM rep GROUP BY region"))
def day_period_counts(spark, d):
    r = views.repaired(spark, d).withColumn("day_period", F.when(F.col("local_hour").between(8, 19), "day").otherwise("night"))
    return r.groupBy("region").pivot("day_period", ["day", "night"]).agg(F.round(F.avg("cnt"), 6).alias("mean"), F.count("cnt").alias("n"))


@query("complete_cases", "SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0")
def complete_cases(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("price"))
    return quality.complete_cases(p, ["price"]).select("p_partkey")


@query("seeded_sample")
def seeded_sample(spark, d):
    return quality.hashed_sample(views.table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@query("change_fields", "SELECT * FROM (VALUES ('festival_pre_population_change', 'double'), ('festival_pre_pm25_change', 'double'), ('post_festival_population_change', 'double'), ('post_festival_pm25_change', 'double')) AS t(name, type)")
def change_fields(spark, d):
    values = ["population", "pm25"]
    wide = exposure.wide_periods(_periods(spark, d), values, ["pre", "festival", "post"])
    return tables.field_dictionary(exposure.changes(wide, values, [("festival_pre", "pre", "festival"), ("post_festival", "festival", "post")]))
