"""Closed-form map projections and grid keys as column expressions (WGS84).

The conic projection follows Snyder, Map Projections: A Working Manual (USGS PP 1395, 1987), ellipsoidal
form with two standard parallels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84, and the national conic grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
PARALLEL_1, PARALLEL_2, LAT_0, LON_0 = 25.0, 47.0, 0.0, 110.0
CELL_M = 10_000

ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (ECCENTRICITY * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    s = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (ECCENTRICITY / 2)


_P1, _P2 = math.radians(PARALLEL_1), math.radians(PARALLEL_2)
CONE = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
SCALE = _m(_P1) / (CONE * _t(_P1) ** CONE)
RHO_0 = SEMI_MAJOR * SCALE * _t(math.radians(LAT_0)) ** CONE


def _as(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def conic(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, turn = F.radians(_as(lat)), F.lit(CONE) * F.radians(_as(lon) - LON_0)
    s = F.lit(ECCENTRICITY) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ECCENTRICITY / 2))
    rho = F.lit(SEMI_MAJOR * SCALE) * F.pow(t, F.lit(CONE))
    return rho * F.sin(turn), F.lit(RHO_0) - rho * F.cos(turn)


def conic_inverse(x: str | Column, y: str | Column, steps: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; the latitude by fixed-point steps."""
    dx, dy = _as(x), F.lit(RHO_0) - _as(y)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / F.lit(SEMI_MAJOR * SCALE), F.lit(1 / CONE))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(steps):
        s = F.lit(ECCENTRICITY) * F.sin(phi)
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(ECCENTRICITY / 2)))
    return F.degrees(F.atan2(dx, dy) / CONE) + LON_0, F.degrees(phi)


def cell_origin(metres: Column, size: int = CELL_M) -> Column:
    """South-west corner of the cell: floor, so that negative coordinates go down."""
    return (F.floor(metres / size) * size).cast("long")


def grid_id(grid_x: str | Column, grid_y: str | Column) -> Column:
    return F.concat_ws("_", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (grid_x, grid_y)])


def web_mercator(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    return F.lit(SEMI_MAJOR) * F.radians(_as(lon)), F.lit(SEMI_MAJOR) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(_as(lat)) / 2))


def tenth_degree(x: str | Column) -> Column:
    return F.round(F.floor(_as(x) * 10 + 1e-9) / 10, 4)


def packed(lat_raw: str | Column, lon_raw: str | Column) -> Column:
    """One long for a pair of hundredths of a degree."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat_raw, lon_raw))
    return (lat.cast("long") + 32768) * 65536 + lon.cast("long") + 32768


def raw_hundredths(degrees: str | Column) -> Column:
    """Hundredths of a degree, halves to the even neighbour."""
    return F.rint(_as(degrees) * 100).cast("int")


def flat_index(lat_raw: Column, lon_raw: Column, lat_min: int, lon_min: int, n_lon: int) -> Column:
    return (lat_raw.cast("long") - lat_min) * n_lon + (lon_raw.cast("long") - lon_min)


def from_flat(flat: Column, lat_min: int, lon_min: int, n_lon: int) -> tuple[Column, Column]:
    return (F.floor(flat / n_lon) + lat_min).cast("int"), (F.pmod(flat, F.lit(n_lon)) + lon_min).cast("int")


def nearest_index(q: str | Column, start: float, step: float, n: int) -> Column:
    """Index of the nearest point of a regular ascending axis; an exact tie goes to the lower coordinate."""
    at = F.ceil((_as(q) - start) / step - 0.5)
    return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int")
