"""Column expressions shared by the operators: times in microseconds, distances, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import KM_PER_DEGREE


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (the session zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def origin_time(tp_us: Column, ts_us: Column, vp: float, vs: float) -> Column:
    """tp less the P travel time that the S-P time implies, in microseconds (floored)."""
    ratio = (1 / vp) / (1 / vs - 1 / vp)
    return tp_us - F.floor((ts_us - tp_us) * F.lit(ratio)).cast("long")


def cos_degrees(x: Column) -> Column:
    return F.cos(x * F.lit(3.141592653589793 / 180))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat_ref: Column) -> Column:
    """Flat-earth distance; longitude is scaled at lat_ref."""
    dy, dx = KM_PER_DEGREE * (lat1 - lat2), KM_PER_DEGREE * (lon1 - lon2) * cos_degrees(lat_ref)
    return F.sqrt(dx * dx + dy * dy)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or the quotient no number."""
    return F.coalesce(F.nanvl(F.try_divide(a, b), F.lit(0.0)), F.lit(0.0))


def compact_name(us: Column) -> Column:
    """YYYYMMDDhhmmss.cc of a time."""
    t = F.timestamp_micros(us)
    return F.concat(F.date_format(t, "yyyyMMddHHmmss"), F.lit("."), F.lpad(F.floor(F.pmod(us, F.lit(1_000_000)) / 10_000).cast("string"), 2, "0"))


def iso_text(us: Column) -> Column:
    """YYYY-MM-DDThh:mm:ss.ffffffZ of a time."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def parse_time(s: Column) -> Column:
    """Microseconds of an ISO text (with or without Z), YYYYMMDD or compact digits; null where it is none of them or -1."""
    iso = F.try_to_timestamp(F.regexp_replace(s, "Z$", ""))
    compact = F.try_to_timestamp(F.substring(F.rpad(s, 14, "0"), 1, 14), F.lit("yyyyMMddHHmmss"))
    return F.when(s.rlike(r"^\d{8,14}(\.\d+)?$"), F.unix_micros(compact)).when(s.rlike(r"^\d{4}-\d\d?-\d\d?"), F.unix_micros(iso))
