"""Evaluation aggregates (AG6-AG10, AG14-AG16, M9, M13).

All are single-pass aggregates (partial + final in Catalyst); exact percentiles are
used where the reference reports them, with ``percentile_approx`` offered for scale.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airfill.functions.display import distance_bin

# Hex-bin lattice of the predicted-vs-observed density plot
HEX_GRIDSIZE = 45


def error_metrics(y: Column, p: Column, prefix: str = "", digits: int | None = 6) -> list[Column]:
    """AG6: RMSE, MAE, R^2 of prediction ``p`` against label ``y`` as aggregate columns.

    R^2 is NULL when the label is constant (T5); ``try_divide`` keeps ANSI mode quiet."""
    e = p - y
    rmse = F.sqrt(F.avg(e * e))
    mae = F.avg(F.abs(e))
    ss_tot = F.var_pop(y) * F.count(y)
    r2 = F.lit(1.0) - F.try_divide(F.sum(e * e), F.when(ss_tot > 0, ss_tot))
    out = [rmse, mae, r2]
    if digits is not None:
        out = [F.round(c, digits) for c in out]
    return [c.alias(f"{prefix}{n}") for c, n in zip(out, ("rmse", "mae", "r2"))]


def reduction(model: str, base: str, digits: int = 4) -> Column:
    """AG7: ``1 - model/base`` rounded to 4 decimals; NULL when the base is 0."""
    return F.round(F.lit(1.0) - F.try_divide(F.col(model), F.col(base)), digits)


def report(df: DataFrame, group: Sequence[str], label: str, predictions: dict[str, str],
           station: str | None = "station_eoi") -> DataFrame:
    """M9: metrics of each prediction column per group, row and station counts (AG11)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if station:
        aggs.append(F.count_distinct(station).alias("stations"))
    for name, col in predictions.items():
        aggs += error_metrics(F.col(label), F.col(col), prefix=f"{name}_")
    return df.groupBy(*group).agg(*aggs)


def mae_by_distance(df: DataFrame, group: Sequence[str], label: str, dist_col: str,
                    predictions: dict[str, str], digits: int = 6) -> DataFrame:
    """AG8 + F16: mean absolute error per right-closed distance bin; rows outside the
    bins (d = 0, no neighbour) are left out, as in the source (T4)."""
    binned = df.withColumn("dist_bin", distance_bin(F.col(dist_col))).filter(F.col("dist_bin").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, col in predictions.items():
        aggs.append(F.round(F.avg(F.abs(F.col(col) - F.col(label))), digits).alias(f"{name}_mae"))
    return binned.groupBy(*group, "dist_bin").agg(*aggs)


def exact_quantiles(df: DataFrame, group: Sequence[str], col: str, q: float, name: str,
                    buckets: int = 1024) -> DataFrame:
    """AG9: the linear-interpolation percentile of ``col`` per group, exact, without a group's
    values meeting anywhere. Only finite values count.

    The two order statistics it lies between are narrowed down together: each pass counts
    the rows of the interval that still holds one, in ``buckets`` equal parts with the least
    and greatest value of each, and goes on with the part of the wanted rank until that
    holds a single value. The driver keeps a few numbers per group, so groups have to be
    few (pollutants, distance bins). Output: group, n, ``name``."""
    group = list(group)
    # null, NaN and the infinities have no place between others
    rows = df.select(*group, F.col(col).cast("double").alias("_v")).where(F.abs("_v") < float("inf"))
    spark = df.sparkSession
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
    state = {}  # (group, which of the two) -> [lo, hi, rank within]
    for t in totals:
        k = int(math.floor(q * (t["n"] - 1)))
        for j, rank in enumerate((k, min(k + 1, t["n"] - 1))):
            state[(*(t[g] for g in group), j)] = [t["lo"], t["hi"], rank]
    kinds = [df.schema[g].dataType.simpleString() for g in group]
    shape = ", ".join(f"{g} {k}" for g, k in zip(group, kinds, strict=True)) + ", _j int, _lo double, _hi double"
    while todo := {k: v for k, v in state.items() if v[0] < v[1]}:
        small = spark.createDataFrame([(*k, v[0], v[1]) for k, v in todo.items()], shape.lstrip(", "))
        held = rows.join(F.broadcast(small), group) if group else rows.join(F.broadcast(small), F.lit(True))
        inside = held.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        part = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets))
        found = {}
        for r in inside.groupBy(*group, "_j", part.cast("int").alias("b")).agg(
                F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
            found.setdefault((*(r[g] for g in group), r["_j"]), []).append((r["b"], r["n"], r["lo"], r["hi"]))
        for key, parts in found.items():
            rank = state[key][2]
            for _, n, lo, hi in sorted(parts):
                if rank < n:
                    state[key] = [lo, hi, rank]
                    break
                rank -= n
    out = []
    for t in totals:
        g, pos = tuple(t[x] for x in group), q * (t["n"] - 1)
        low, high = state[(*g, 0)][0], state[(*g, 1)][0]
        out.append((*g, t["n"], low + (high - low) * (pos - math.floor(pos))))
    shape = "".join(f"{g} {k}, " for g, k in zip(group, kinds, strict=True)) + f"n long, {name} double"
    return spark.createDataFrame(out, shape)


def hex_bins(df: DataFrame, x: str, y: str, extent: Column | tuple, group: Sequence[str] = (),
             gridsize: int = HEX_GRIDSIZE) -> DataFrame:
    """AG10: counts on a hexagonal lattice over ``extent`` = (xmin, xmax, ymin, ymax)
    (columns or numbers), bins with no point left out.

    The lattice is the usual two offset rectangular grids (nx = gridsize,
    ny = int(nx / sqrt(3))); a point goes to the nearer centre, in hex metric.
    Points outside the lattice range are dropped. Output: lattice (1 or 2), i, j,
    centre cx, cy, count."""
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    xmin, xmax, ymin, ymax = [c if isinstance(c, Column) else F.lit(float(c)) for c in extent]
    sx = (xmax - xmin) / F.lit(float(nx))
    sy = (ymax - ymin) / F.lit(float(ny))
    ix = (F.col(x) - xmin) / sx
    iy = (F.col(y) - ymin) / sy
    ix1, iy1 = F.bround(ix, 0), F.bround(iy, 0)
    ix2, iy2 = F.floor(ix), F.floor(iy)
    d1 = F.pow(ix - ix1, 2) + F.lit(3.0) * F.pow(iy - iy1, 2)
    d2 = F.pow(ix - ix2 - 0.5, 2) + F.lit(3.0) * F.pow(iy - iy2 - 0.5, 2)
    first = d1 < d2
    in1 = (ix1 >= 0) & (ix1 < nx + 1) & (iy1 >= 0) & (iy1 < ny + 1)
    in2 = (ix2 >= 0) & (ix2 < nx) & (iy2 >= 0) & (iy2 < ny)
    binned = (df.select(
        *group, F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("lattice"),
        F.when(first, ix1).otherwise(ix2).cast("long").alias("i"),
        F.when(first, iy1).otherwise(iy2).cast("long").alias("j"),
        F.when(first, in1).otherwise(in2).alias("_in"),
        sx.alias("_sx"), sy.alias("_sy"), xmin.alias("_x0"), ymin.alias("_y0"))
        .filter(F.col("_in")))
    off = F.when(F.col("lattice") == 1, F.lit(0.0)).otherwise(F.lit(0.5))
    return (binned.groupBy(*group, "lattice", "i", "j", "_sx", "_sy", "_x0", "_y0")
                  .agg(F.count(F.lit(1)).alias("count"))
                  .select(*group, "lattice", "i", "j",
                          F.round(F.col("_x0") + (F.col("i") + off) * F.col("_sx"), 4).alias("cx"),
                          F.round(F.col("_y0") + (F.col("j") + off) * F.col("_sy"), 4).alias("cy"),
                          "count"))


def calibration(fit_on: DataFrame, measure_on: DataFrame, group: Sequence[str], abs_err: str, q: float = 0.9,
                digits: int = 6) -> DataFrame:
    """AG14: per group (e.g. distance bin) the ``q`` quantile of the absolute residual on one
    set of rows, and the coverage that quantile achieves on another. A residual equal to the
    quantile counts as covered (compared with a 1e-9 tolerance, since the quantile's
    interpolation arithmetic can land one ulp off a data value)."""
    qs = F.broadcast(exact_quantiles(fit_on, group, abs_err, q, "q_err"))  # a few groups
    joined = measure_on.join(qs, list(group), "inner")
    return (joined.groupBy(*group, "q_err", "n")
                  .agg(F.count(F.lit(1)).alias("n_measured"),
                       F.avg(F.when(F.col(abs_err) <= F.col("q_err") + F.lit(1e-9), 1.0).otherwise(0.0)).alias("coverage"))
                  .select(*group, "n", "n_measured", F.round("q_err", digits).alias("q_err"),
                          F.round("coverage", digits).alias("coverage")))


def psi_many(df: DataFrame, recent: str, specs: dict[str, tuple[str, Sequence[float]]],
             group: Sequence[str] = (), eps: float = 1e-6, digits: int = 6) -> DataFrame:
    """AG15 for several columns in one pass: ``recent`` is a boolean column splitting
    the reference rows from the current ones; ``specs`` maps an output name to
    (column, bucket edges). One scan, one aggregate of bucket counts, then only the
    small count table is reshaped. Output: group, ``psi_<name>`` per spec."""
    group = list(group)

    def bucket(col, edges):
        b = None
        for i, e in enumerate(edges):
            b = F.when(F.col(col) < e, F.lit(i)) if b is None else b.when(F.col(col) < e, F.lit(i))
        return F.when(F.col(col).isNotNull(), b.otherwise(F.lit(len(edges))))

    items = F.array(*[F.struct(F.lit(n).alias("var"), bucket(c, e).alias("bucket")) for n, (c, e) in specs.items()])
    counts = (df.select(*group, F.col(recent).alias("_recent"), F.explode(items).alias("_it"))
                .filter(F.col("_it.bucket").isNotNull())
                .groupBy(*group, "_recent", F.col("_it.var").alias("var"), F.col("_it.bucket").alias("bucket"))
                .agg(F.count(F.lit(1)).alias("n")))
    tot = counts.groupBy(*group, "_recent", "var").agg(F.sum("n").alias("tot"))
    p = counts.join(tot, [*group, "_recent", "var"]).withColumn("p", F.col("n") / F.col("tot"))
    ref = p.filter(~F.col("_recent")).select(*group, "var", "bucket", F.col("p").alias("p_ref"))
    cur = p.filter(F.col("_recent")).select(*group, "var", "bucket", F.col("p").alias("p_cur"))
    j = ref.join(cur, [*group, "var", "bucket"], "full_outer").fillna(0.0, subset=["p_ref", "p_cur"])
    pr = F.greatest(F.col("p_ref"), F.lit(eps))
    pc = F.greatest(F.col("p_cur"), F.lit(eps))
    per = j.groupBy(*group, "var").agg(F.round(F.sum((pc - pr) * F.ln(pc / pr)), digits).alias("psi"))
    names = list(specs)
    wide = per.groupBy(*group).pivot("var", names).agg(F.first("psi"))
    return wide.select(*group, *[F.col(n).alias(f"psi_{n}") for n in names])
