"""Spatial operators (J3 helpers, J6, J8-J11, J13, J18, AG5, F13, W2).

Spark has no spatial index, and plain distance predicates plan as a nested-loop
join. A search within a radius is an *equi* join on integer cell keys: the site side
is assigned to one cell, the query side is exploded to the few cells its search
radius can reach (longitude span widened by 1/cos(latitude), wrapped at 180 degrees),
and the exact distance is filtered afterwards.

Unbounded k-nearest searches (J8, J10, J11) descend a pyramid of cells with counts of
sites. Points descend together, by the cell they lie in: at each level a cell of points keeps
only cells of sites that can still hold one of the k nearest of any of its points: those whose
least possible distance doesn't exceed the least upper bound that covers k sites. A far
point so follows a dense cluster down to the few cells at its edge and never meets the whole
cluster. A point itself is shuffled to its finest cell, meets the sites of the few cells left
there as arrays, and only its best k go on. The depth is fixed, so the search is one plan
without driver rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airfill.functions import geo
from airfill.session import checkpoint, written

# Fixed values
KM_PER_DEG_SAFE = 110.0   # fewer km per degree than any metric uses: boxes stay wide enough
#: The pyramid: cells of 180 degrees, cut four by four; the last level's are about 5 km.
PYRAMID_LEVELS = 6
FAN = 4
#: Sites of a finest cell that lie in one array.
PACK = 1024
#: Cells of the first level that hold every coordinate, poles and 180 E included.
ROOTS = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]

METRICS = {
    "haversine": geo.haversine_km,       # F6
    "planar": geo.planar_km,             # F7
    "equirect_mean": geo.equirect_mean_km,  # F8
    "equirect_point": geo.equirect_point_km,  # F9
    "chord": geo.chord,                  # F10 (unit-sphere chord; radius converted)
}


def _distance(metric: str, plat: Column, plon: Column, slat: Column, slon: Column) -> Column:
    return METRICS[metric](plat, plon, slat, slon)


def _within(metric: str, d: Column, radius_km: float) -> Column:
    if metric == "chord":
        return d <= F.lit(geo.max_chord(radius_km))
    return d <= F.lit(float(radius_km))


def _km(metric: str, d: Column) -> Column:
    return geo.chord_to_km(d) if metric == "chord" else d


def _wraps(metric: str) -> bool:
    """Whether the metric knows that 180 W is 180 E (the flat ones don't)."""
    return metric in ("haversine", "chord")


def _lon_cells(cell_deg: float) -> tuple[float, int]:
    """Longitude cells that divide the circle evenly: (width, number)."""
    n = max(1, math.floor(360.0 / cell_deg))
    return 360.0 / n, n


def _lon_cell(lon: Column, cell_deg: float, wrap: bool) -> Column:
    width, n = _lon_cells(cell_deg)
    c = F.floor((lon + F.lit(180.0)) / width).cast("long")
    return F.pmod(c, F.lit(n)) if wrap else c


def _cells_around(lat: Column, lon: Column, radius_km: float, cell_deg: float, wrap: bool) -> Column:
    """Array of struct(ci, cj): every cell a site within ``radius_km`` of (lat, lon)
    can lie in, for a conservative box valid for all METRICS. Wrapped columns are
    visited once each."""
    width, n = _lon_cells(cell_deg)
    dlat = radius_km / KM_PER_DEG_SAFE
    reach = F.least(F.abs(lat) + F.lit(dlat), F.lit(89.999))
    cosr = F.cos(F.radians(reach))
    # small-angle bound with margin; beyond it (or near a pole) take all longitudes
    ratio = F.lit(dlat) / cosr
    all_lon = (ratio * F.lit(math.pi / 180.0) > F.lit(0.3)) | F.lit(dlat >= 90.0)
    dlon = F.when(all_lon, F.lit(180.0)).otherwise(ratio * F.lit(1.02))
    lat_lo = F.floor((lat - F.lit(dlat)) / cell_deg).cast("long")
    lat_hi = F.floor((lat + F.lit(dlat)) / cell_deg).cast("long")
    lon_lo = F.when(all_lon, F.lit(0)).otherwise(F.floor((lon - dlon + F.lit(180.0)) / width)).cast("long")
    lon_hi = F.when(all_lon, F.lit(n - 1)).otherwise(F.floor((lon + dlon + F.lit(180.0)) / width)).cast("long")
    columns = F.sequence(lon_lo, F.greatest(lon_lo, F.least(lon_hi, lon_lo + F.lit(n - 1))))
    if wrap:
        columns = F.transform(columns, lambda c: F.pmod(c, F.lit(n)))
    return F.flatten(F.transform(
        F.sequence(lat_lo, lat_hi),
        lambda ci: F.transform(columns, lambda cj: F.struct(ci.alias("ci"), cj.alias("cj")))))


def pairs_within(points: DataFrame, sites: DataFrame, radius_km: float, metric: str = "haversine",
                 group: Sequence[str] = (), plat: str = "lat", plon: str = "lon",
                 slat: str = "s_lat", slon: str = "s_lon", filter_radius: bool = True) -> DataFrame:
    """All (point, site) pairs with the same ``group`` values and distance within
    ``radius_km``; adds ``_d`` (metric value). ``sites`` columns must not clash with
    ``points`` columns except ``group``. One equi join on (group, cell)."""
    cell = max(radius_km / KM_PER_DEG_SAFE, 1e-4)
    p = points.withColumn("_cell", F.explode(_cells_around(
        F.col(plat), F.col(plon), radius_km, cell, _wraps(metric))))
    p = p.select("*", F.col("_cell.ci").alias("_ci"), F.col("_cell.cj").alias("_cj")).drop("_cell")
    s = sites.withColumns({"_ci": F.floor(F.col(slat) / cell).cast("long"),
                           "_cj": _lon_cell(F.col(slon), cell, _wraps(metric))})
    j = p.join(s, [*group, "_ci", "_cj"], "inner").drop("_ci", "_cj")
    j = j.withColumn("_d", _distance(metric, F.col(plat), F.col(plon), F.col(slat), F.col(slon)))
    if filter_radius:
        j = j.filter(_within(metric, F.col("_d"), radius_km))
    return j


def nearest_within(points: DataFrame, sites: DataFrame, radius_km: float, point_key: Sequence[str],
                   site_key: str, by: Sequence[str] = (), metric: str = "chord",
                   carry: Sequence[str] = (), **cols) -> DataFrame:
    """Per point (and per ``by`` columns of the sites, e.g. granule) the nearest site
    within ``radius_km``; ties go to the lowest ``site_key``. Points with no site in
    range are absent. The choice is a ``min_by`` aggregate (partial before shuffle).

    Output: point_key, by, site_key, carry columns, dist_km."""
    pr = pairs_within(points, sites, radius_km, metric, **cols)
    best = (pr.groupBy(*point_key, *by)
              .agg(F.min_by(F.struct(F.col(site_key), *[F.col(c) for c in carry], F.col("_d")),
                            F.struct(F.col("_d"), F.col(site_key))).alias("_b")))
    return best.select(*point_key, *by, F.col(f"_b.{site_key}").alias(site_key),
                       *[F.col(f"_b.{c}").alias(c) for c in carry],
                       _km(metric, F.col("_b._d")).alias("dist_km"))


def _bounds(metric: str, pi: Column, pj: Column, ni: Column, nj: Column, size: float) -> tuple[Column, Column]:
    """Least and greatest distance (km, by ``metric``) from any point of the cell (pi, pj) to any site of
    the cell (ni, nj) of the same level."""
    zero, one, wide = F.lit(0), F.lit(1), F.lit(size)
    rows, cols = F.abs(ni - pi), F.abs(nj - pj)
    if _wraps(metric):
        around = F.lit(round(360.0 / size))
        cols = F.least(F.pmod(nj - pj, around), F.pmod(pj - nj, around))
    near_lat, far_lat = F.greatest(zero, rows - one) * wide, (rows + one) * wide
    near_lon, far_lon = F.greatest(zero, cols - one) * wide, (cols + one) * wide
    cos = lambda d: F.cos(F.radians(F.least(d, F.lit(90.0))))

    def edges(i: Column) -> tuple[Column, Column]:
        return i * wide - F.lit(90.0), (i + one) * wide - F.lit(90.0)

    def cosines(lo: Column, hi: Column) -> tuple[Column, Column]:
        """Least and greatest cosine of the latitudes between two."""
        return cos(F.greatest(F.abs(lo), F.abs(hi))), F.when((lo <= 0) & (hi >= 0), F.lit(1.0)).otherwise(
            cos(F.least(F.abs(lo), F.abs(hi))))

    (p0, p1), (n0, n1) = edges(pi), edges(ni)
    if _wraps(metric):
        def arc(dlat: Column, dlon: Column, c: Column) -> Column:
            h = F.pow(F.sin(F.radians(dlat) / 2), 2) + c * F.pow(F.sin(F.radians(dlon) / 2), 2)
            return F.lit(2 * geo.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
        (p_least, p_most), (n_least, n_most) = cosines(p0, p1), cosines(n0, n1)
        half = F.lit(180.0)
        return arc(near_lat, near_lon, p_least * n_least), arc(F.least(half, far_lat), F.least(half, far_lon), p_most * n_most)
    if metric == "planar":
        least, most = F.lit(1.0), F.lit(1.0)
    elif metric == "equirect_point":
        least, most = cosines(p0, p1)
    else:  # the cosine of a latitude between the point's and the site's
        least, most = cosines((p0 + n0) / 2, (p1 + n1) / 2)
    flat = lambda dlat, dlon, c: F.hypot(dlat, dlon * c) * F.lit(geo.KM_PER_DEGREE)
    return flat(near_lat, near_lon, least), flat(far_lat, far_lon, most)


def knn(points: DataFrame, sites: DataFrame, k: int, point_key: Sequence[str], site_key: str,
        metric: str = "haversine", group: Sequence[str] = (), exclude_self: str | None = None,
        plat: str = "lat", plon: str = "lon", slat: str = "s_lat", slon: str = "s_lon",
        site_cols: Sequence[str] = (), levels: int = PYRAMID_LEVELS) -> DataFrame:
    """The ``k`` nearest sites of every point (exact), ranked by
    (distance, site_key); W2 numbering in ``rank``.

    exclude_self: name of a point column that must differ from ``site_key`` (J11).
    Output: point_key, rank, site_key, site_cols, dist_km. Points whose group has
    fewer than k sites get fewer rows; points or sites without coordinates get none.
    """
    key, grp = list(point_key), list(group)
    size = [180.0 / FAN ** level for level in range(levels + 1)]

    def leaf(lat: str, lon: str) -> tuple[Column, Column]:
        wide = F.pmod(F.col(lon) + F.lit(180.0), F.lit(360.0)) if _wraps(metric) else F.col(lon) + F.lit(180.0)
        return tuple(F.floor(v / F.lit(size[levels])).cast("long") for v in (F.col(lat) + F.lit(90.0), wide))

    def at(level: int, c: str) -> Column:
        return F.floor(F.col(c) / F.lit(FAN ** (levels - level))).cast("long")

    pi, pj = leaf("_plat", "_plon")
    pts = (points.select(*key, *[c for c in grp if c not in key], F.col(plat).alias("_plat"), F.col(plon).alias("_plon"))
                 .where(F.col("_plat").isNotNull() & F.col("_plon").isNotNull()).withColumns({"_pi": pi, "_pj": pj}))
    tiles = written(pts.select(*grp, "_pi", "_pj").distinct(), "knn-tiles")
    # the sites of a finest cell in arrays of bounded length; what is small is broadcast by its size on disk
    ni, nj = leaf(slat, slon)
    item = F.struct(F.col(site_key).alias("k"), F.col(slat).alias("lat"), F.col(slon).alias("lon"), *site_cols)
    within = Window.partitionBy(*grp, "_ni", "_nj").orderBy(site_key)
    packed = written(
        sites.where(F.col(slat).isNotNull() & F.col(slon).isNotNull())
             .select(*grp, ni.alias("_ni"), nj.alias("_nj"), F.col(site_key), item.alias("_s"))
             .withColumn("_chunk", F.floor((F.row_number().over(within) - 1) / F.lit(PACK)))
             .groupBy(*grp, "_ni", "_nj", "_chunk").agg(F.collect_list("_s").alias("_sites"), F.count(F.lit(1)).alias("_n")), "knn-sites")
    need = k + (1 if exclude_self else 0)
    roots = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in ROOTS])
    front = (tiles.select(*grp, at(0, "_pi").alias("_pi"), at(0, "_pj").alias("_pj")).distinct()
                  .withColumn("_root", F.explode(roots))
                  .select(*grp, F.col("_pi").alias("_ui"), F.col("_pj").alias("_uj"), F.col("_root.i").alias("_vi"),
                          F.col("_root.j").alias("_vj"), F.lit(None).cast("double").alias("_bound")))
    up = lambda c: F.floor(F.col(c) / F.lit(FAN)).cast("long")
    for level in range(1, levels + 1):
        own = (tiles.select(*grp, at(level, "_pi").alias("_pi"), at(level, "_pj").alias("_pj")).distinct()
                    .withColumns({"_ui": up("_pi"), "_uj": up("_pj")}))
        nodes = (packed.groupBy(*grp, at(level, "_ni").alias("_ni"), at(level, "_nj").alias("_nj")).agg(F.sum("_n").alias("_n"))
                       .withColumns({"_vi": up("_ni"), "_vj": up("_nj")}))
        if level <= 2:  # at most 45 and 585 cells a group
            own, nodes = F.broadcast(own), F.broadcast(nodes)
        joined = front.join(own, [*grp, "_ui", "_uj"]).join(nodes, [*grp, "_vi", "_vj"])
        low, high = _bounds(metric, F.col("_pi"), F.col("_pj"), F.col("_ni"), F.col("_nj"), size[level])
        near = lambda: F.col("_bound").isNull() | (F.col("_low") <= F.col("_bound") * F.lit(1 + 1e-9) + F.lit(1e-9))
        # what covers k sites for the cell above does so for this one
        joined = joined.withColumns({"_low": low, "_high": high}).where(near())
        tile = [*grp, "_ui", "_uj", "_pi", "_pj"]  # with the cell above: its rows lie together already
        reached = F.sum("_n").over(Window.partitionBy(*tile).orderBy("_high").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("_reached") >= need, F.col("_high"))).over(Window.partitionBy(*tile))
        front = (joined.withColumn("_reached", reached).withColumn("_bound", bound).where(near())
                       .select(*grp, F.col("_pi").alias("_ui"), F.col("_pj").alias("_uj"), F.col("_ni").alias("_vi"),
                               F.col("_nj").alias("_vj"), "_bound"))
    held = (front.select(*grp, F.col("_ui").alias("_pi"), F.col("_uj").alias("_pj"), F.col("_vi").alias("_ni"), F.col("_vj").alias("_nj"))
                 .join(packed.drop("_n", "_chunk"), [*grp, "_ni", "_nj"]).drop("_ni", "_nj"))
    met = pts.dropDuplicates(key).join(held, [*grp, "_pi", "_pj"])
    others = F.filter("_sites", lambda x: F.col(exclude_self) != x["k"]) if exclude_self else F.col("_sites")
    scored = F.transform(others, lambda x: F.struct(
        _distance(metric, F.col("_plat"), F.col("_plon"), x["lat"], x["lon"]).alias("d"), x["k"].alias("k"),
        *[x[c].alias(c) for c in site_cols]))
    best = F.array(F.array_min(scored)) if k == 1 else F.slice(F.array_sort(scored), 1, k)
    rows = met.select(*key, F.explode(best).alias("_x")).where(F.col("_x").isNotNull()).select(
        *key, F.col("_x.d").alias("_d"), F.col("_x.k").alias(site_key), *[F.col("_x")[c].alias(c) for c in site_cols])
    w = Window.partitionBy(*key).orderBy("_d", site_key)
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select(*key, "rank", site_key, *site_cols, _km(metric, F.col("_d")).alias("dist_km")))


def nearest_other(stations: DataFrame, metric: str = "planar", group: Sequence[str] = (),
                  key: str = "station_eoi") -> DataFrame:
    """Distance to the nearest *other* station (same ``group``), one row per
    station; stations alone in their group get NULL (left join back)."""
    stations = checkpoint(stations.select(key, *group, "lat", "lon"))
    sites = stations.select(F.col(key).alias("_site"), *group,
                            F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    nn = knn(stations, sites, 1, [key, *group], "_site",
             metric=metric, group=group, exclude_self=key)
    d = nn.select(key, *group, "dist_km")
    return stations.select(key, *group).dropDuplicates([key, *group]).join(d, [key, *group], "left")


def grid_points(spark, box=geo.GRID_BOX, step: float = geo.GRID_STEP) -> DataFrame:
    """the regular field grid, row-major (row = latitude index), coordinates from
    integer steps rounded to 4 decimals (no float drift)."""
    lon0, lat0, _, _ = box
    rows, cols = geo.grid_shape(box, step)
    return (spark.range(rows * cols)
                 .select((F.col("id") / cols).cast("long").alias("row"),
                         (F.col("id") % cols).alias("col"))
                 .select("row", "col",
                         F.round(F.lit(lat0) + F.col("row") * F.lit(step), 4).alias("lat"),
                         F.round(F.lit(lon0) + F.col("col") * F.lit(step), 4).alias("lon")))


def grid_cell_of(lat: Column, lon: Column, box=geo.GRID_BOX, step: float = geo.GRID_STEP):
    """(row, col) of the nearest grid point by rounding half up; NULL outside."""
    lon0, lat0, _, _ = box
    rows, cols = geo.grid_shape(box, step)
    ic = F.floor((lon - F.lit(lon0)) / F.lit(step) + F.lit(0.5)).cast("long")
    ir = F.floor((lat - F.lit(lat0)) / F.lit(step) + F.lit(0.5)).cast("long")
    ok = (ic >= 0) & (ic < cols) & (ir >= 0) & (ir < rows)
    return F.when(ok, ir), F.when(ok, ic)


def station_boxes(stations: DataFrame, tile_deg: float = 5.0, margin: float = 0.5) -> DataFrame:
    """AG5: bounding box per occupied ``tile_deg`` tile, widened by ``margin``."""
    return (stations.groupBy(geo.tile_key(F.col("lon"), tile_deg).alias("tile_x"),
                             geo.tile_key(F.col("lat"), tile_deg).alias("tile_y"))
                    .agg((F.min("lon") - margin).alias("box_lon0"), (F.min("lat") - margin).alias("box_lat0"),
                         (F.max("lon") + margin).alias("box_lon1"), (F.max("lat") + margin).alias("box_lat1")))


def boxes_overlap(items: DataFrame, boxes: DataFrame, tile_deg: float = 1.0,
                  item_box=("lon0", "lat0", "lon1", "lat1"),
                  other_box=("box_lon0", "box_lat0", "box_lon1", "box_lat1")) -> DataFrame:
    """Item x box pairs whose rectangles intersect (edges touching count).

    Both sides are exploded to the ``tile_deg`` tiles they cover and joined on the
    tile; a pair meeting in several tiles is kept once, in its lowest common tile."""
    def tiles(df, b):
        x0, y0, x1, y1 = [F.col(c) for c in b]
        return df.withColumn("_t", F.explode(F.flatten(F.transform(
            F.sequence(F.floor(x0 / tile_deg).cast("long"), F.floor(x1 / tile_deg).cast("long")),
            lambda tx: F.transform(
                F.sequence(F.floor(y0 / tile_deg).cast("long"), F.floor(y1 / tile_deg).cast("long")),
                lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))))
    a = tiles(items, item_box)
    b = tiles(boxes, other_box)
    ax0, ay0, ax1, ay1 = [F.col(c) for c in item_box]
    bx0, by0, bx1, by1 = [F.col(c) for c in other_box]
    j = a.join(b, "_t", "inner").filter((ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1))
    # the lowest tile inside both rectangles is where the pair is kept
    first_x = F.floor(F.greatest(ax0, bx0) / tile_deg).cast("long")
    first_y = F.floor(F.greatest(ay0, by0) / tile_deg).cast("long")
    return j.filter((F.col("_t.tx") == first_x) & (F.col("_t.ty") == first_y)).drop("_t")
