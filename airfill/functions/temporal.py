"""Time features as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods of the cyclic encodings
HOURS_PER_DAY = 24.0
DAYS_PER_YEAR = 365.25


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cyclic(value, period: float) -> tuple[Column, Column]:
    """sin / cos of ``2*pi*value/period``."""
    ang = _c(value) * F.lit(2 * math.pi / period)
    return F.sin(ang), F.cos(ang)


def rounded(column: Column, digits: int) -> Column:
    """``column`` rounded; "+ 0.0" turns a rounded -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def cyclic_table(value, period: float, values: int, digits: int) -> tuple[Column, Column]:
    """``cyclic`` rounded, for a whole ``value`` from 0 to ``values`` - 1: looked up in constants, because rounding a
    double is slow."""
    sides = zip(*[cyclic(F.lit(float(v)), period) for v in range(values)], strict=True)
    return tuple(F.get(F.array(*[rounded(c, digits) for c in side]), _c(value)) for side in sides)


def temporal_columns(ts, with_minutes: bool = False, digits: int | None = None) -> dict[str, Column]:
    """F3 + F4: hour_sin, hour_cos, doy_sin, doy_cos, is_weekend, rounded if ``digits`` is given.

    ``with_minutes`` uses hour + minute/60 (extended contract); training uses the whole
    hour."""
    t = _c(ts)
    if digits is not None and not with_minutes:
        hs, hc = cyclic_table(F.hour(t), HOURS_PER_DAY, 24, digits)
        ds, dc = cyclic_table(F.dayofyear(t), DAYS_PER_YEAR, 367, digits)
        return {"hour_sin": hs, "hour_cos": hc, "doy_sin": ds, "doy_cos": dc, "is_weekend": is_weekend(t)}
    hour = F.hour(t).cast("double")
    if with_minutes:
        hour = hour + F.minute(t) / F.lit(60.0)
    hs, hc = cyclic(hour, HOURS_PER_DAY)
    ds, dc = cyclic(F.dayofyear(t).cast("double"), DAYS_PER_YEAR)
    cols = {
        "hour_sin": hs,
        "hour_cos": hc,
        "doy_sin": ds,
        "doy_cos": dc,
        "is_weekend": is_weekend(t),
    }
    return cols if digits is None else {k: rounded(v, digits) for k, v in cols.items()}


def is_weekend(ts) -> Column:
    """Saturday or Sunday as 0.0 / 1.0 (``weekday`` is 0 on Monday)."""
    return F.when(F.weekday(_c(ts)) >= 5, F.lit(1.0)).otherwise(F.lit(0.0))


def iso_hour(ts) -> Column:
    """``YYYY-MM-DDTHH:00`` text of the hour holding ``ts``."""
    return F.date_format(F.date_trunc("HOUR", _c(ts)), "yyyy-MM-dd'T'HH:00")


def hour_offset(now, ts) -> Column:
    """Whole hours from ``now`` to ``ts`` (negative in the past)."""
    return F.timestamp_diff("HOUR", _c(now), _c(ts))


def wind_vector(direction) -> tuple[Column, Column]:
    """sine and cosine of a wind direction in degrees."""
    rad = F.radians(_c(direction))
    return F.sin(rad), F.cos(rad)
