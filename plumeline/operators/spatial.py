"""Points in polygons, polygon overlap, distance bands, and spatial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Ring = list[tuple[float, float]]


def on_edge(x: np.ndarray, y: np.ndarray, ring: Ring, tolerance: float = 1e-12) -> np.ndarray:
    """Whether each point lies on the ring's line."""
    hit = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        within = (x >= min(ax, bx) - tolerance) & (x <= max(ax, bx) + tolerance) & (y >= min(ay, by) - tolerance) & (y <= max(ay, by) + tolerance)
        hit |= within & (np.abs(cross) <= tolerance * max(1.0, abs(bx - ax) + abs(by - ay)))
    return hit


def inside_ring(x: np.ndarray, y: np.ndarray, ring: Ring) -> np.ndarray:
    """Even-odd rule by a ray to the right."""
    odd = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            odd ^= crosses
    return odd


def touches(x: np.ndarray, y: np.ndarray, rings: list[Ring]) -> tuple[np.ndarray, np.ndarray]:
    """(inside or on the boundary, on the boundary) of a polygon with holes: its rings together, even-odd."""
    edge, odd = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        edge |= on_edge(x, y, ring)
        odd ^= inside_ring(x, y, ring)
    return edge | odd, edge


def assign_regions(points: DataFrame, lon: str, lat: str, polygons: dict[int, list[Ring]]) -> DataFrame:
    """region and assignment_method of each point: interior, boundary, multiple or outside; ties to the lowest code.

    Only distinct coordinates are tested; the polygons are a fixed set that tasks receive whole.
    """
    schema = pa.schema([("_lon", pa.float64()), ("_lat", pa.float64()), ("region", pa.int32()), ("assignment_method", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            best, n, edge = np.full(len(x), -1), np.zeros(len(x), int), np.zeros(len(x), bool)
            for code in sorted(polygons):
                inside, line = touches(x, y, polygons[code])
                best = np.where((best < 0) & inside, code, best)
                edge |= line
                n += inside
            method = np.select([n == 0, n > 1, edge], ["outside", "multiple", "boundary"], "interior")
            region = pa.array(best, pa.int32(), mask=best < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), region, pa.array(method.astype(object), pa.string())], schema=schema)

    keyed = points.withColumn("_lon", F.col(lon).cast("double")).withColumn("_lat", F.col(lat).cast("double"))
    tested = keyed.select("_lon", "_lat").where("_lon is not null and _lat is not null").distinct().mapInArrow(run, "_lon double, _lat double, region int, assignment_method string")
    return keyed.join(tested, ["_lon", "_lat"], "left").drop("_lon", "_lat").fillna("outside", ["assignment_method"])


def clip_to_box(ring: Ring, x0: float, y0: float, x1: float, y1: float) -> Ring:
    """The part of a ring in an upright box, side by side of the box."""
    sides: list[tuple[int, float, int]] = [(0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)]
    for axis, bound, sign in sides:
        out: Ring = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da > 0 > db) or (da < 0 < db):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return []
    return ring


def ring_area(ring: Ring) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0


def largest_overlap(points: DataFrame, lon: str, lat: str, polygons: dict[int, list[Ring]], box: float = 0.1) -> DataFrame:
    """overlap_region of the box around each point: the most area (scaled by the cosine of latitude), then the lowest code."""
    schema = pa.schema([("_lon", pa.float64()), ("_lat", pa.float64()), ("overlap_region", pa.int32()), ("overlap_area", pa.float64()), ("n_overlaps", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                areas = {}
                for code, rings in polygons.items():
                    parts = [ring_area(clip_to_box(r, x - box / 2, y - box / 2, x + box / 2, y + box / 2)) for r in rings]
                    areas[code] = (parts[0] - sum(parts[1:])) * math.cos(math.radians(y))  # further rings are holes
                hit = {c: a for c, a in areas.items() if a > 0}
                best = min(hit, key=lambda c: (-hit[c], c)) if hit else None
                rows.append((x, y, best, hit.get(best, 0.0), len(hit)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 5, schema, strict=True)], schema=schema)

    keyed = points.withColumn("_lon", F.col(lon).cast("double")).withColumn("_lat", F.col(lat).cast("double"))
    tested = keyed.select("_lon", "_lat").distinct().mapInArrow(run, "_lon double, _lat double, overlap_region int, overlap_area double, n_overlaps int")
    return keyed.join(tested, ["_lon", "_lat"], "left").drop("_lon", "_lat")


def nearest_region(points: DataFrame, x: str, y: str, polygons: dict[int, list[Ring]], most: float) -> DataFrame:
    """nearest_region and its distance (planar units) for points within `most` of a region's boundary or inside it; ties to the lowest code."""
    schema = pa.schema([("_x", pa.float64()), ("_y", pa.float64()), ("nearest_region", pa.int32()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            best, code_of = np.full(len(px), np.inf), np.full(len(px), -1)
            for code in sorted(polygons):
                near = np.full(len(px), np.inf)
                for ring in polygons[code]:
                    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                        length = (bx - ax) ** 2 + (by - ay) ** 2
                        t = np.clip(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length, 0, 1) if length else 0.0
                        near = np.minimum(near, np.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
                near[touches(px, py, polygons[code])[0]] = 0.0
                code_of, best = np.where(near < best, code, code_of), np.minimum(near, best)
            void = ~(best <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code_of, pa.int32(), mask=void), pa.array(best, mask=void)], schema=schema)

    keyed = points.withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    tested = keyed.select("_x", "_y").where("_x is not null and _y is not null").distinct().mapInArrow(run, "_x double, _y double, nearest_region int, distance double")
    return keyed.join(tested, ["_x", "_y"], "left").drop("_x", "_y")


def distance_band(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """src and dst of all ordered pairs of points within the radius, a point and itself left out.

    Points meet in squares of the radius' size: one side is copied to the nine squares around it, so the
    join is an equality of squares and its work follows the number of near pairs.
    """
    p = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).withColumn("bx", F.floor(F.col("x") / radius)).withColumn("by", F.floor(F.col("y") / radius))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = p.withColumn("o", F.explode(around)).select(F.col("k").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    d2 = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)
    return p.join(near, ["bx", "by"]).where((F.col("k") != F.col("dst")) & (d2 <= radius * radius)).select(F.col("k").alias("src"), "dst")


def spatial_lag(points: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """key, z (deviation from the mean), lag (mean of the neighbours' z; 0 for islands) and n_neighbours."""
    mean = points.agg(F.avg(value).alias("mean"))
    z = points.select(key, value).where(F.col(value).isNotNull()).crossJoin(F.broadcast(mean)).select(F.col(key).alias("k"), (F.col(value) - F.col("mean")).alias("z"))
    near = edges.join(z.select(F.col("k").alias("dst"), F.col("z").alias("zn")), "dst").groupBy("src").agg(F.avg("zn").alias("lag"), F.count(F.lit(1)).alias("n_neighbours"))
    out = z.join(near, z["k"] == near["src"], "left")
    return out.select(F.col("k").alias(key), "z", F.coalesce("lag", F.lit(0.0)).alias("lag"), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


#: Places, or pairs of them, that a pass of band_sums holds at a time.
PLACES = 1_000_000


def _sums_around(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, values: list[np.ndarray], radius: float) -> list[np.ndarray]:
    """For each wanted place, the sums of the values of all places within the radius, itself included; places are distinct.

    Places are sorted along strips, about as high as places lie apart. A strip's places surely within the radius
    are a run, whose sum is a difference of running totals; those near the run's ends are measured one by one.
    So the work follows the strips that a circle meets, the root of the places in it.
    """
    span = float(x.max() - x.min()), float(y.max() - y.min())
    height = min(radius, max(radius / 2000, (span[0] * span[1] / len(x)) ** 0.5, span[1] / 1_000_000))
    strip = ((y - y.min()) / height).astype(np.int64)
    order = np.lexsort((x, strip))
    sx, sy, row = x[order], y[order], strip[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    low, high = np.full(row[-1] + 1, np.inf), np.full(row[-1] + 1, -np.inf)
    low[row[first]], high[row[first]] = np.minimum.reduceat(sy, first), np.maximum.reduceat(sy, first)
    # one sorted number for strip and x; what it rounds off is less than the slack
    wide = span[0] + 4 * radius
    place = row * wide + (sx - x.min())
    slack = 1e-9 * radius + 1e-14 * wide * (row[-1] + 2)
    values = [v[order] for v in values]
    totals = [np.concatenate([[0], np.cumsum(v)]) for v in values]
    sums = [np.zeros(len(wanted), t.dtype) for t in totals]
    reach = int(radius / height) + 1
    for begin in range(0, len(wanted), PLACES):
        at = wanted[begin : begin + PLACES]
        for step in range(-reach, reach + 1):
            to = strip[at] + step
            some = np.flatnonzero((to >= 0) & (to <= row[-1]))
            some = some[(low[to[some]] - radius - slack <= y[at[some]]) & (y[at[some]] <= high[to[some]] + radius + slack)]
            if not len(some):
                continue
            px, py, line = x[at[some]], y[at[some]], to[some]
            far = np.maximum(np.abs(py - low[line]), np.abs(py - high[line]))
            near = np.maximum(np.maximum(low[line] - py, py - high[line]), 0)
            inner, outer = (np.sqrt(np.maximum(radius**2 * scale - d**2, 0)) for scale, d in ((1 - 1e-12, far), (1 + 1e-12, near)))
            middle = line * wide + (px - x.min())
            left, right = np.searchsorted(place, middle - outer - slack), np.searchsorted(place, middle + outer + slack, "right")
            one, two = np.searchsorted(place, middle - inner + slack), np.searchsorted(place, middle + inner - slack, "right")
            run = (far < radius) & (one < two)
            one, two = np.where(run, one, right), np.where(run, two, right)
            for total, found in zip(totals, sums, strict=True):
                found[begin + some] += total[two] - total[one]
            for lo, hi in ((left, one), (two, right)):
                sizes = hi - lo
                held = np.flatnonzero(sizes)
                cuts = np.searchsorted(np.cumsum(sizes[held]), np.arange(PLACES, int(sizes.sum()) + PLACES, PLACES))
                for part in np.split(held, np.unique(cuts)):
                    if not len(part):
                        continue
                    ends = np.cumsum(sizes[part])
                    other = np.arange(ends[-1]) + np.repeat(lo[part] - ends + sizes[part], sizes[part])
                    mine = np.repeat(part, sizes[part])
                    within = (px[mine] - sx[other]) ** 2 + (py[mine] - sy[other]) ** 2 <= radius * radius
                    for v, found in zip(values, sums, strict=True):
                        counted = np.concatenate([[0], np.cumsum(np.where(within, v[other], 0))])
                        found[begin + some[part]] += counted[ends] - counted[ends - sizes[part]]
    return sums


def _block_sums(radius: float, kinds: list[pa.DataType], schema: pa.Schema) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        own = block.column("own").to_numpy()
        x, y = block.column("x").to_numpy(), block.column("y").to_numpy()
        if not own.any():
            return schema.empty_table()
        given = [block.column(f"v{i}").fill_null(0).to_numpy() for i in range(len(kinds))]
        # longs are added exactly, other numbers with more bits than they have
        given = [np.ones(len(x), np.int64), *(v if v.dtype == np.int64 else v.astype(np.longdouble) for v in given)]
        places, of = np.unique(x + 1j * y, return_inverse=True)
        at = np.argsort(of, kind="stable")
        begins = np.searchsorted(of[at], np.arange(len(places)))
        wanted, mine = np.unique(of[own], return_inverse=True)
        around = _sums_around(places.real, places.imag, wanted, [np.add.reduceat(v[at], begins) for v in given], radius)
        # rows of the same key, the point itself among them, aren't its neighbours
        key = block.column("k").combine_chunks().dictionary_encode().indices.to_numpy()
        same = np.argsort(key, kind="stable")
        out = [np.zeros(len(x), v.dtype) for v in given]
        for v, total, found in zip(out, around, given, strict=True):
            v[own] = total[mine]
            v -= found
        apart, left = 1, same
        while apart < len(same):
            left = np.flatnonzero(key[same[apart:]] == key[same[:-apart]])
            if not len(left):
                break
            a, b = same[left], same[left + apart]
            close = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= radius * radius
            for v, found in zip(out, given, strict=True):
                v[a[close]] -= found[b[close]]
                v[b[close]] -= found[a[close]]
            apart += 1
        kept = own & (out[0] > 0)
        columns = [block.column("k").filter(pa.array(kept)), *(pa.array(v[kept].astype(t.to_pandas_dtype())) for v, t in zip(out, [pa.int64(), *kinds], strict=True))]
        return pa.table(columns, schema=schema)

    return run


def band_sums(points: DataFrame, key: str, x: str, y: str, radius: float, columns: list[str]) -> DataFrame:
    """What distance_band's pairs add up to, without making them: src, n (its pairs), and the sums of dst's columns.

    Longs are added exactly and other columns, which have to be finite, as doubles; nulls add nothing. Points go to
    squares of twice the radius, with copies to those that their circle touches, four on average.
    """
    known = points.where(F.col(key).isNotNull() & (F.abs(F.col(x).cast("double")) < math.inf) & (F.abs(F.col(y).cast("double")) < math.inf))
    whole = [points.schema[c].dataType.typeName() in ("long", "integer", "short", "byte") for c in columns]
    given = [F.col(c).cast("long" if w else "double").alias(f"v{i}") for i, (c, w) in enumerate(zip(columns, whole, strict=True))]
    rows = known.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *given)
    side, reach = 2 * radius, radius * (1 + 1e-9)
    square = lambda c: F.floor(c / side).cast("long")
    touched = lambda c: F.explode(F.sequence(square(F.col(c) - reach), square(F.col(c) + reach)))
    spread = rows.withColumn("gx", touched("x")).withColumn("gy", touched("y")).withColumn("own", (F.col("gx") == square(F.col("x"))) & (F.col("gy") == square(F.col("y"))))
    kinds = [pa.int64() if w else pa.float64() for w in whole]
    types = ", ".join(f"`{c}` {'long' if w else 'double'}" for c, w in zip(columns, whole, strict=True))
    like = rows.select(F.col("k").alias("src")).schema
    out_type = f"src {like['src'].dataType.simpleString()}, n long" + (f", {types}" if types else "")
    schema = pa.schema([("src", to_arrow_type(like["src"].dataType)), ("n", pa.int64()), *zip(columns, kinds, strict=True)])
    parts = spread.groupBy("gx", "gy").applyInArrow(_block_sums(radius, kinds, schema), out_type)
    # rows that repeat a key
    return parts.groupBy("src").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])


def band_lag(points: DataFrame, key: str, x: str, y: str, radius: float, value: str) -> DataFrame:
    """spatial_lag over the pairs of distance_band, without making them."""
    mean = points.agg(F.avg(value).alias("mean"))
    z = points.select(key, value).where(F.col(value).isNotNull()).crossJoin(F.broadcast(mean)).select(F.col(key).alias("k"), (F.col(value) - F.col("mean")).alias("z"))
    known = z.groupBy("k").agg(F.sum("z").alias("zn"), F.count(F.lit(1)).alias("rows"))
    near = band_sums(points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).join(known, "k"), "k", "x", "y", radius, ["zn", "rows"])
    out = z.join(near, z["k"] == near["src"], "left")
    return out.select(F.col("k").alias(key), "z", F.coalesce(F.col("zn") / F.col("rows"), F.lit(0.0)).alias("lag"), F.coalesce("rows", F.lit(0)).alias("n_neighbours"))


def global_moran(lagged: DataFrame) -> DataFrame:
    """Moran's I with row-standardised weights, its expectation, n and the number of islands."""
    s = lagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_neighbours") == 0).alias("n_islands"), F.sum(F.col("z") * F.col("lag")).alias("zl"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    return s.select((F.col("n") / (F.col("n") - F.col("n_islands")) * F.col("zl") / F.col("zz")).alias("moran_i"), (F.lit(-1.0) / (F.col("n") - 1)).alias("expected_i"), "n", "n_islands")


QUADRANTS = ["HH", "LH", "LL", "HL"]


def local_moran(lagged: DataFrame, key: str) -> DataFrame:
    """Local I and quadrant: 1 high among high, 2 low among high, 3 low among low, 4 high among low."""
    total = lagged.agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count(F.lit(1)).alias("n"))
    high, around = F.col("z") > 0, F.col("lag") > 0
    quadrant = F.when(high & around, 1).when(~high & around, 2).when(~high & ~around, 3).otherwise(4)
    return lagged.crossJoin(F.broadcast(total)).select(key, "z", "lag", "n_neighbours", ((F.col("n") - 1) * F.col("z") * F.col("lag") / F.col("zz")).alias("local_i"), quadrant.alias("quadrant"))


#: Draws that a task holds at a time.
DRAWS = 2_000_000


def _permuter(values: np.ndarray, most: int, permutations: int, seed: int) -> Callable:
    schema = pa.schema([("k", pa.int64()), ("p_sim", pa.float64())])
    scale = len(values) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        held = pa.Table.from_batches(batches)
        keys, z, degree, observed = (held.column(i).to_numpy() for i in range(4))
        zz, gaps = float((values**2).sum()), np.diff(values)
        own_place = np.searchsorted(values, z)
        larger = np.zeros(len(keys), np.int64)
        # the sum of neighbours that gives the observed value
        with np.errstate(divide="ignore", invalid="ignore"):
            target = observed * zz / (scale * z) * degree
        by = np.argsort(degree, kind="stable")
        sizes, begins = np.unique(degree[by], return_index=True)
        groups = [(int(n), by[a:b]) for n, a, b in zip(sizes, begins, [*begins[1:], len(by)], strict=True) if n]
        rng = np.random.default_rng(seed)
        block = max(1, DRAWS // max(1, most))
        for begin in range(0, permutations, block):
            # the same draws without replacement for each point, of the others' places
            drawn = np.array([rng.choice(scale, most, replace=False) for _ in range(min(block, permutations - begin))], np.int64).reshape(-1, most)
            # the place of the point's own value is passed over, so a draw from there on gives the next value: by so much the sum is larger at most
            least, further = np.cumsum(values[drawn], axis=1), np.cumsum(gaps[drawn], axis=1)
            for n, members in groups:
                low, high = least[:, n - 1], least[:, n - 1] + further[:, n - 1]
                slack = 1e-9 * (np.abs(low).max() + np.abs(high).max() + n * np.abs(values[[0, -1]]).max())
                for some in np.array_split(members, -(-len(members) * len(drawn) // DRAWS)):
                    aim, up = target[some][:, None], (z[some] > 0)[:, None]
                    above, below = low[None, :] > aim + slack, high[None, :] < aim - slack
                    larger[some] += np.where(up, above, below).sum(axis=1)
                    # what the bounds leave open is drawn in full; a value of 0 has no bounds
                    who, which = np.nonzero(~(above | below))
                    step = max(1, DRAWS // n)
                    for k in range(0, len(who), step):
                        i, others = some[who[k : k + step]], drawn[which[k : k + step], :n]
                        others = others + (others >= own_place[i][:, None])
                        simulated = scale * z[i] * values[others].mean(axis=1) / zz
                        np.add.at(larger, i, simulated >= observed[i])
        p = np.where(degree > 0, (np.minimum(larger, permutations - larger) + 1) / (permutations + 1), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p)], schema=schema)

    return run


def local_significance(local: DataFrame, key: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """p_sim of each local I by conditional permutation: neighbours are drawn without replacement from all other points' values.

    Tasks receive all deviations (8 bytes each) and hold their own points; draws are made in blocks of bounded size.
    Points with as many neighbours share a permutation's sum up to the place of their own value, which bounds decide
    for most of them. Fewer than three points, or equal values, are an error.
    """
    values = np.sort(local.select(F.col("z").cast("double")).toArrow().column(0).to_numpy())
    if len(values) < 3 or np.isclose(values.std(), 0):
        raise ValueError("too few points, or all values equal")
    most = int(local.agg(F.max("n_neighbours")).first()[0] or 0)
    rows = local.select(F.col(key).cast("long").alias("k"), F.col("z").cast("double"), F.col("n_neighbours").cast("long"), F.col("local_i").cast("double"))
    # each task makes all draws, so tasks are as many as run at once, or hold a million points
    tasks = max(min(len(values) // 1000 + 1, local.sparkSession.sparkContext.defaultParallelism), len(values) // 1_000_000)
    tested = rows.repartition(tasks, "k").mapInArrow(_permuter(values, most, permutations, seed), "k long, p_sim double")
    return local.join(tested, local[key] == tested["k"]).drop("k")


def with_no_data(points: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """All points with their cluster; those without a value, which have none, are NoData."""
    found = clusters.select(F.col(key).alias("_k"), "local_i", "p_sim", "quadrant", "cluster")
    return points.join(found, points[key] == F.col("_k"), "left").drop("_k").withColumn("cluster", F.coalesce("cluster", F.lit("NoData")))


def lookup_join(points: DataFrame, lookup: DataFrame, lat: str, lon: str, domain: tuple[int, int, int, int]) -> DataFrame:
    """points with in_domain, code and is_inside, from a table of codes for each whole coordinate (lat, lon, code).

    domain: least and largest lat and lon that the table covers; what lies beyond it, or has no code above 0 in it, is outside.
    """
    a, b, c, e = domain
    inside = F.coalesce(F.col(lat).between(a, b) & F.col(lon).between(c, e), F.lit(False))
    known = lookup.where(F.col(lat).between(a, b) & F.col(lon).between(c, e)).select(lat, lon, "code")
    out = points.withColumn("in_domain", inside).join(known, [lat, lon], "left")
    return out.withColumn("is_inside", F.col("in_domain") & F.coalesce(F.col("code") > 0, F.lit(False)))


def box_outline(lon_lo: float, lat_lo: float, lon_hi: float, lat_hi: float, samples: int = 161) -> list[tuple[float, float]]:
    """A closed ring along the edges of a box of longitudes and latitudes, with so many points on each, so that its projection keeps the edges' curves."""
    x, y = np.linspace(lon_lo, lon_hi, samples), np.linspace(lat_lo, lat_hi, samples)
    edges = [(x, np.full(samples, lat_lo)), (np.full(samples, lon_hi), y), (x[::-1], np.full(samples, lat_hi)), (np.full(samples, lon_lo), y[::-1])]
    ring = [edge[k] for edge in ([*zip(p.tolist(), q.tolist(), strict=True)] for p, q in edges) for k in range(samples - 1)]
    return [*ring, ring[0]]


def lisa_clusters(local: DataFrame, level: float = 0.05):
    label = F.element_at(F.array(*[F.lit(q) for q in QUADRANTS]), F.col("quadrant"))
    return local.withColumn("cluster", F.when(F.col("p_sim") < level, label).otherwise("Not significant"))


#: Edges that a task holds at a time, while all permutations pass over them.
EDGES = 2_000_000


def permutation_test(spark, lagged: DataFrame, edges: DataFrame, key: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Global I's z_sim and p_sim: each permutation has a seed of its own and shuffles all values over the graph.

    I is a sum over edges of the two ends' values by the neighbours of the first, so edges stay in their
    partitions, in any number: a task draws the same permutations for its edges and gives their partial sums.
    Tasks receive key, value and number of neighbours of each point (24 bytes).
    """
    points = lagged.select(F.col(key).alias("k"), F.col("z").cast("double"), F.col("n_neighbours").cast("long")).toArrow().sort_by("k")
    keys, z, degree = (points.column(c).to_numpy() for c in ("k", "z", "n_neighbours"))

    def sums(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        at, to = np.searchsorted(keys, src), np.searchsorted(keys, dst)
        at, to = np.minimum(at, len(keys) - 1), np.minimum(to, len(keys) - 1)
        known = (keys[at] == src) & (keys[to] == dst)
        at, to = at[known], to[known]
        weight = 1 / degree[at]
        drawn = ((np.random.default_rng([seed, i]).permutation(z) if i >= 0 else z) for i in range(-1, permutations))  # -1: as observed
        found = [float((weight * v[at] * v[to]).sum()) for v in drawn]
        return pa.RecordBatch.from_arrays([pa.array(range(-1, permutations), pa.int64()), pa.array(found, pa.float64())], schema=pa.schema([("i", pa.int64()), ("s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += batch.num_rows
            if n >= EDGES:
                yield sums(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield sums(*map(np.concatenate, zip(*held, strict=True)))

    # the join that makes edges reads little, so its tasks are few
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = edges.select("src", "dst").repartition(spread, "src").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    return _test_of(spark, parts, z, degree, permutations)


#: Places of a lattice, at most, on which all points are put; their transform takes 24 bytes each in a task.
LATTICE = 1 << 24


def _lattice(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """Row and column of each point where all coordinates are whole numbers, and the steps between rows and columns; None if they don't fit."""
    found = []
    for c in (x, y):
        if not len(c) or not (np.abs(c) < 1 << 50).all() or (c != np.rint(c)).any():
            return None
        apart = (c - c.min()).astype(np.int64)
        step = max(1, int(np.gcd.reduce(apart)))
        found.append((apart // step, step))
    (i, dx), (j, dy) = found
    return (i, j, float(dx), float(dy)) if (int(i.max()) + 1) * (int(j.max()) + 1) <= LATTICE else None


def _fast_length(n: int) -> int:
    """The least number from n on without prime factors above 5."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


def band_permutation_test(spark, points: DataFrame, key: str, x: str, y: str, radius: float, value: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """permutation_test over the pairs of distance_band, with the same permutations; keys don't repeat.

    Where coordinates are whole numbers on a lattice, sums over neighbours are a convolution of the values on it
    with the circle, by a Fourier transform; each task takes some of the permutations, and receives value, number of
    neighbours, place and number of each point (32 bytes). Elsewhere, and where pairs are few, the pairs are made.
    """
    known = points.where(F.col(value).isNotNull())
    lagged = band_lag(points, key, x, y, radius, value)
    at = known.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = lagged.join(at, F.col(key) == F.col("_k")).select(F.col(key).alias("k"), F.col("z").cast("double"), F.col("n_neighbours").cast("long").alias("degree"), "_x", "_y").toArrow().sort_by("k")
    z, degree = rows.column("z").to_numpy(), rows.column("degree").to_numpy()
    px, py = (rows.column(c).fill_null(math.nan).to_numpy() for c in ("_x", "_y"))
    placed = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    lattice = _lattice(px[placed], py[placed])
    if lattice is None or 10 * (int(lattice[0].max()) + 1) * (int(lattice[1].max()) + 1) > degree.sum():
        return permutation_test(spark, lagged, distance_band(known, key, x, y, radius), key, permutations, seed)
    i, j, dx, dy = lattice
    # room for the circle, so that what passes the edge meets nothing
    shape = tuple(_fast_length(int(c.max()) + 1 + int(radius / d)) for c, d in ((i, dx), (j, dy)))
    place, cells = i * shape[1] + j, shape[0] * shape[1]
    weight = 1 / np.maximum(degree[placed], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        away = [np.minimum(np.arange(n), n - np.arange(n)) * d for n, d in zip(shape, (dx, dy), strict=True)]
        circle = np.fft.rfft2((away[0][:, None] ** 2 + away[1][None, :] ** 2 <= radius * radius).astype(float))
        for batch in batches:
            number, found = batch.column(0).to_numpy(), []
            for n in number.tolist():  # -1: as observed
                v = (np.random.default_rng([seed, n]).permutation(z) if n >= 0 else z)[placed]
                around = np.fft.irfft2(np.fft.rfft2(np.bincount(place, v, cells).reshape(shape)) * circle, shape).ravel()
                found.append(float((weight * v * (around[place] - v)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(found, pa.float64())], schema=pa.schema([("i", pa.int64()), ("s", pa.float64())]))

    tasks = min(permutations + 1, 4 * spark.sparkContext.defaultParallelism)
    return _test_of(spark, spark.range(-1, permutations, 1, tasks).mapInArrow(run, "i long, s double"), z, degree, permutations)


def _test_of(spark, parts: DataFrame, z: np.ndarray, degree: np.ndarray, permutations: int) -> DataFrame:
    """moran_i, z_sim and p_sim, from each permutation's sum s (i is -1 for the observed values)."""
    scale = len(z) / max(1, int((degree > 0).sum()))
    zz = float((z**2).sum())
    # a graph without edges has I = 0 throughout
    sims = spark.range(-1, permutations).withColumnRenamed("id", "i").join(parts, "i", "left").select("i", F.try_divide(F.lit(scale) * F.coalesce("s", F.lit(0.0)), F.lit(zz)).alias("i_sim"))
    observed = sims.where("i = -1").select(F.col("i_sim").alias("moran_i"))
    drawn = sims.where("i >= 0").crossJoin(F.broadcast(observed))
    out = drawn.agg(F.first("moran_i").alias("moran_i"), F.avg("i_sim").alias("m"), F.stddev_pop("i_sim").alias("s"), F.count_if(F.col("i_sim") >= F.col("moran_i")).alias("larger"))
    return out.select("moran_i", F.try_divide(F.col("moran_i") - F.col("m"), F.col("s")).alias("z_sim"), ((F.least("larger", F.lit(permutations) - F.col("larger")) + 1) / (permutations + 1)).alias("p_sim"))
