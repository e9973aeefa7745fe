"""Display and classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
VERIFIED_KM = 25.0
# ramp ceiling per pollutant, ug/m3
VMAX = {"pm25": 30.0, "no2": 60.0}
# colour stops (position, (r, g, b)): predicted = warm ramp, measured = violet ramp
PRED_STOPS = [(0.0, (254, 249, 195)), (0.3, (251, 191, 36)), (0.55, (249, 115, 22)),
              (0.8, (220, 38, 38)), (1.0, (127, 29, 29))]
MEAS_STOPS = [(0.0, (243, 232, 255)), (0.3, (192, 132, 252)), (0.55, (147, 51, 234)),
              (0.8, (107, 33, 168)), (1.0, (59, 7, 100))]
# distance bins, right-closed: (0,10], (10,25], (25,50], (50,100], (100,1e6]
DIST_EDGES = [0.0, 10.0, 25.0, 50.0, 100.0, 1e6]
DIST_LABELS = ["<10", "10-25", "25-50", "50-100", ">100"]
KMH_PER_MS = 3.6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp0(p) -> Column:
    """predictions are never negative."""
    return F.greatest(_c(p), F.lit(0.0))


def trust_class(dist_km) -> Column:
    """sensor-verified within 25 km, unmonitored beyond."""
    return (F.when(_c(dist_km) <= VERIFIED_KM, F.lit("sensor-verified"))
            .when(_c(dist_km) > VERIFIED_KM, F.lit("unmonitored")))


def distance_bin(dist_km, edges=DIST_EDGES, labels=DIST_LABELS) -> Column:
    """F16: right-closed bins open at the first edge; outside -> NULL (trap T4)."""
    d = _c(dist_km)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (d > lo) & (d <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def js_round(x) -> Column:
    """Round half towards +infinity (``Math.round``)."""
    return F.floor(_c(x) + F.lit(0.5)).cast("int")


def ramp(t, stops) -> Column:
    """piecewise-linear colour ramp; returns struct(r, g, b)."""
    tc = F.least(F.greatest(_c(t), F.lit(0.0)), F.lit(1.0))
    chans = []
    for j, name in enumerate(("r", "g", "b")):
        expr = None
        for (a0, a), (b0, b) in zip(stops[:-1], stops[1:]):
            k = (tc - F.lit(a0)) / F.lit(b0 - a0)
            val = js_round(F.lit(float(a[j])) + F.lit(float(b[j] - a[j])) * k)
            expr = F.when(tc <= b0, val) if expr is None else expr.when(tc <= b0, val)
        chans.append(expr.otherwise(F.lit(stops[-1][1][j])).alias(name))
    return F.struct(*chans)


def fade(dist_km) -> Column:
    """Fade with distance: 1 within 50 km, then linear down to 0.3."""
    d = F.coalesce(_c(dist_km), F.lit(9e9))
    return F.when(d <= 50, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), F.lit(1.0) - (d - 50) / 260))


def opacity(t, dist_km) -> Column:
    """``(0.62 + 0.36*sqrt(t)) * fade``."""
    return (F.lit(0.62) + F.lit(0.36) * F.sqrt(_c(t))) * fade(dist_km)


def kmh_to_ms(v) -> Column:
    """explicit wind-unit conversion."""
    return _c(v) / F.lit(KMH_PER_MS)
