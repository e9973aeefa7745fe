"""Geodesy as Column expressions.

All of these compile into whole-stage codegen; none is a Python UDF. Several distance
formulas coexist on purpose (trap T3): each operator uses the one its source uses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
# continental grid of the field: lon0, lat0, lon1, lat1 and step in degrees
GRID_BOX = (-10.0, 35.0, 30.0, 60.0)
GRID_STEP = 0.35
# point-query theatre: lat 34..55, lon -2..24 (inclusive)
THEATRE = (34.0, 55.0, -2.0, 24.0)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def cell_index(v, size: float) -> Column:
    """Integer cell index ``floor(v / size)`` (join on this, never on a rounded double)."""
    return F.floor(_c(v) / F.lit(float(size))).cast("long")


def snap(v, size: float) -> Column:
    """centre of the ``size``-degree cell holding ``v``, rounded to 4 decimals."""
    return F.round((F.floor(_c(v) / F.lit(float(size))) + F.lit(0.5)) * F.lit(float(size)), 4)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance, r = 6371 km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = F.radians(_c(lat2) - _c(lat1))
    dl = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees times 111 (no cosine)."""
    return F.sqrt(F.pow(_c(lat2) - _c(lat1), 2) + F.pow(_c(lon2) - _c(lon1), 2)) * F.lit(KM_PER_DEGREE)


def equirect_mean_km(lat1, lon1, lat2, lon2) -> Column:
    """F8: equirectangular distance with the cosine of the mean latitude."""
    dy = (_c(lat2) - _c(lat1)) * F.lit(KM_PER_DEGREE)
    dx = (_c(lon2) - _c(lon1)) * F.lit(KM_PER_DEGREE) * F.cos(F.radians((_c(lat1) + _c(lat2)) / 2))
    return F.hypot(dx, dy)


def equirect_point_km(plat, plon, slat, slon) -> Column:
    """equirectangular distance with the cosine of the first (grid) point's latitude."""
    dy = (_c(plat) - _c(slat)) * F.lit(KM_PER_DEGREE)
    dx = (_c(plon) - _c(slon)) * F.lit(KM_PER_DEGREE) * F.cos(F.radians(_c(plat)))
    return F.sqrt(dx * dx + dy * dy)


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """point on the unit sphere."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord(lat1, lon1, lat2, lon2) -> Column:
    """straight-line distance between two unit-sphere points."""
    x1, y1, z1 = unit_vector(lat1, lon1)
    x2, y2, z2 = unit_vector(lat2, lon2)
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2) + F.pow(z1 - z2, 2))


def max_chord(km: float) -> float:
    """chord length on the unit sphere for a surface distance of ``km``."""
    return 2.0 * math.sin(km / EARTH_RADIUS_KM / 2.0)


def chord_to_km(c) -> Column:
    """Surface km for a unit-sphere chord."""
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(_c(c) / 2)


def tile_key(v, size: float = 5.0) -> Column:
    """integer tile by floor division."""
    return cell_index(v, size)


def mercator_y(lat) -> Column:
    """Web-Mercator y in degrees."""
    mer = 180.0 / math.pi
    return F.lit(mer) * F.ln(F.tan(F.lit(math.pi / 4) + _c(lat) * F.lit(math.pi / 360)))


def mercator_lat(y) -> Column:
    """inverse Web-Mercator."""
    mer = 180.0 / math.pi
    return (F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(mer))) - F.lit(math.pi / 2)) * F.lit(180.0 / math.pi)


def tile_xy(lat, lon, zoom: int) -> tuple[Column, Column]:
    """slippy-map tile x / y at ``zoom``."""
    n = float(1 << zoom)
    tx = F.floor((_c(lon) + 180.0) / 360.0 * n).cast("long")
    ty = F.floor((F.lit(1.0) - mercator_y(lat) / 180.0) / 2.0 * n).cast("long")
    return tx, ty


def box_wkt(lon0, lat0, lon1, lat1) -> Column:
    """closed WKT polygon for a box."""
    return F.format_string("POLYGON((%s %s,%s %s,%s %s,%s %s,%s %s))",
                           _c(lon0), _c(lat0), _c(lon1), _c(lat0), _c(lon1), _c(lat1),
                           _c(lon0), _c(lat1), _c(lon0), _c(lat0))


def in_theatre(lat, lon, box=THEATRE) -> Column:
    """Inclusive theatre test."""
    la0, la1, lo0, lo1 = box
    return _c(lat).between(la0, la1) & _c(lon).between(lo0, lo1)


def grid_shape(box=GRID_BOX, step: float = GRID_STEP) -> tuple[int, int]:
    """(rows, cols) of the regular grid; integer steps avoid float drift."""
    lon0, lat0, lon1, lat1 = box
    rows = int(math.floor((lat1 - lat0) / step + 1e-9)) + 1
    cols = int(math.floor((lon1 - lon0) / step + 1e-9)) + 1
    return rows, cols
