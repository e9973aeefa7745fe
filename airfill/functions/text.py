"""Text expressions: codes, numbers in text, plain-word sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
# station code = text after the last '/', starting 'SPO-', up to the first '_'
STATION_PREFIX = "SPO-"
# digits with an optional fraction: read as they stand
DIGITS_PATTERN = r"^[0-9]+(?:[.][0-9]*)?$"
# a plain decimal number (optional sign, digits, optional fraction and exponent)
NUMBER_PATTERN = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
UNMONITORED_KM = 25.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def station_code(sampling_point) -> Column:
    """``LU/SPO-LU0104A_00008_100`` -> ``LU0104A``; anything else -> NULL."""
    last = F.substring_index(_c(sampling_point), "/", -1)
    code = F.substring_index(F.substr(last, F.lit(len(STATION_PREFIX) + 1)), "_", 1)
    return F.nullif(F.when(F.startswith(last, F.lit(STATION_PREFIX)), code), F.lit(""))


def country_code(station_eoi) -> Column:
    """first two letters of the station code."""
    return F.substring(_c(station_eoi), 1, 2)


def to_number(text) -> Column:
    """Text -> double; bad text, NaN and infinities -> NULL.

    A regex guard keeps ANSI mode from throwing and rejects forms like ``1.5d``
    that ``try_cast`` would accept."""
    return F.get(numbers(text), F.lit(0))


def numbers(text) -> Column:
    """The number of ``to_number`` in an array, empty without one."""
    return F.filter(F.array(read_number(text)), finite)


def read_number(text) -> Column:
    """The number a text reads as, which may be infinite; NULL for other text. Bare digits, as most readings are,
    need no group of a pattern cut out."""
    t = _c(text)
    return F.when(t.rlike(DIGITS_PATTERN), t.try_cast("double")).otherwise(F.regexp_extract(t, NUMBER_PATTERN, 1).try_cast("double"))


def finite(v: Column) -> Column:
    # NaN sorts above every number in Spark, so one range test drops NaN and +-inf
    big = 1.7976931348623157e308
    return v.between(F.lit(-big), F.lit(big))


def whole(x) -> Column:
    """Integer nearest to ``x``, ties to even (how ``{:.0f}`` prints a number)."""
    return F.bround(_c(x), 0).cast("long")


def hotspot_sentence(value, lat, lon, dist_km) -> Column:
    """``"<v> ug/m3 at <lat>N <lon>E, <d> km from the nearest sensor"``."""
    return F.format_string("%d ug/m3 at %.2fN %.2fE, %d km from the nearest sensor",
                           whole(value), _c(lat), _c(lon), whole(dist_km))


def reasons(has_model, pm25_value, pm25_prior, no2_value, no2_prior, near_eoi, near_km) -> Column:
    """plain-word reasons for a point estimate, as an array of sentences."""
    def adjust(pol: str, value, prior):
        dv = _c(value) - _c(prior)
        return F.when(
            _c(has_model) & (F.abs(dv) >= 1),
            F.format_string(f"model adjusts CAMS {pol} %s by %d ug/m3 from local weather + context",
                            F.when(dv > 0, F.lit("up")).otherwise(F.lit("down")), whole(F.abs(dv))))

    items = [
        adjust("pm25", pm25_value, pm25_prior),
        adjust("no2", no2_value, no2_prior),
        F.when(~_c(has_model), F.lit("raw CAMS prior (model not registered yet)")),
        F.when(_c(near_eoi).isNotNull(),
               F.format_string("nearest sensor %s is %d km away", _c(near_eoi), whole(near_km))),
        F.when(_c(near_km) > UNMONITORED_KM, F.lit("this point is effectively unmonitored")),
    ]
    # model adjustments (or the prior notice) first, then the nearest sensor
    return F.array_compact(F.array(*items))
