"""Column builders: times, geography, numbers in text, traffic measures.

All are expressions of built-in functions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
WALK_KMH = 4.8
#: 256**i mod 100 for i = 0, 1, 2, ...: 1, then these by turns.
_BYTE_WEIGHTS = (56, 36, 16, 96, 76)


def gtfs_seconds(text: Column) -> Column:
    """``HH:MM:SS`` since the service day's start; hours are unbounded.  Raises on anything else but null."""
    parts = F.split(F.trim(text), ":")
    valid = F.trim(text).rlike(r"^\d+:[0-5]?\d:[0-5]?\d$")
    value = parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int")
    return F.when(text.isNull(), F.lit(None).cast("int")).when(valid, value).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("int"))


def time_label(seconds: Column) -> Column:
    """``HH:MM``."""
    return F.format_string("%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_KM * 2 * F.asin(F.sqrt(h))


def mesh_centre(code: Column) -> tuple[Column, Column]:
    """(lat, lon) of the centre of a 100 m cell of the ten-digit Japanese mesh; null for other codes."""
    valid = F.trim(code).rlike(r"^\d{10}$")
    digit = lambda at, n=1: F.substring(F.trim(code), at, n).cast("int")
    lat = digit(1, 2) * 2.0 / 3.0 + digit(5) / 12.0 + digit(7) / 120.0 + (digit(9) + 0.5) / 1200.0
    lon = digit(3, 2) + 100.0 + digit(6) / 8.0 + digit(8) / 80.0 + (digit(10) + 0.5) / 800.0
    return F.when(valid, lat), F.when(valid, lon)


def node_key(lat: Column, lon: Column, prefix: str = "n") -> Column:
    """Identity of a graph node: both coordinates at seven decimals."""
    return F.format_string(f"{prefix}:%.7f:%.7f", lat, lon)


def first_number(text: Column, default: float) -> Column:
    """The first unsigned number in free text; unit and sign are not looked at."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double"), F.lit(float(default)))


def tolerant_number(text: Column) -> Column:
    """A number with thousands separators; anything else is 0."""
    return F.coalesce(F.regexp_replace(F.trim(text), ",", "").try_cast("double"), F.lit(0.0))


def walk_minutes(km: Column, speed_kmh: Column | float = WALK_KMH) -> Column:
    return km / speed_kmh * 60.0


def rescaled_walk(minutes: Column, speed_kmh: Column | float) -> Column:
    """Minutes at the standard speed as minutes at another."""
    return minutes * WALK_KMH / speed_kmh


def bpr_minutes(free: Column, volume: Column, capacity: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    """Congested link time; without capacity infinite once there is volume."""
    positive = F.greatest(volume, F.lit(0.0))
    load = F.try_divide(positive, capacity)
    return F.when(capacity > 0, free * (1 + alpha * F.pow(load, F.lit(beta)))).when(positive > 0, F.lit(float("inf"))).otherwise(free)


def free_flow_minutes(length_km: Column, speed_kmh: Column) -> Column:
    return F.when(speed_kmh > 0, length_km / speed_kmh * 60.0).otherwise(F.raise_error(F.lit("speed must be positive")).cast("double"))


def geh(model: Column, observed: Column) -> Column:
    """The GEH statistic; 0 where both are 0."""
    return F.coalesce(F.sqrt(F.try_divide(2 * F.pow(model - observed, 2), model + observed)), F.lit(0.0))


def hash_bucket(key: Column) -> Column:
    """The key's UTF-8 bytes as a little-endian number, modulo 100: a split that never depends on order."""
    codes = F.hex(F.encode(key, "UTF-8"))
    at = F.sequence(F.lit(0), F.octet_length(key) - 1)
    weights = F.array(*[F.lit(w) for w in _BYTE_WEIGHTS])
    weight = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.element_at(weights, ((i - 1) % 5 + 1).cast("int")))
    byte = lambda i: F.conv(F.substring(codes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(F.octet_length(key) == 0, F.lit(0)).otherwise(F.aggregate(at, F.lit(0), lambda s, i: (s + byte(i) * weight(i)) % 100))


def direction(value: Column, epsilon: float = 0.0005) -> Column:
    return F.when(value.isNull(), "unknown").when(value > epsilon, "positive").when(value < -epsilon, "negative").otherwise("neutral")


def shown_minutes(minutes: Column) -> Column:
    """Two decimals, null unless finite."""
    return F.when(~F.isnan(minutes) & (F.abs(minutes) < float("inf")), F.round(minutes, 2))


def grid_corner(degrees: Column) -> Column:
    return F.floor(degrees * 10) / 10


def minutes_band(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "unreachable").when(minutes <= 30, "30").when(minutes <= 60, "60").when(minutes <= 90, "90").otherwise("over")


def increase_band(delta: Column) -> Column:
    return F.when(delta > 10, "10").when(delta > 5, "5").when(delta > 1, "1").when(delta > 0, "0").otherwise("none")


def deterrence(impedance: Column, beta: float, structural_zero: Column | None = None) -> Column:
    """exp(-beta * impedance); 0 for structural zeros; raises if an impedance is missing or negative."""
    zero = F.lit(False) if structural_zero is None else F.coalesce(structural_zero, F.lit(False))
    bad = impedance.isNull() | (impedance < 0)
    return F.when(zero, F.lit(0.0)).when(bad, F.raise_error(F.lit("impedance is missing or negative")).cast("double")).otherwise(F.exp(-beta * impedance))


def nested_ages(total: Column, over65: Column, over75: Column, over85: Column) -> list[Column]:
    """Age weights clipped so that none is negative or exceeds the wider group."""
    wide = [F.greatest(F.lit(0.0), total)]
    for part in (over65, over75, over85):
        wide.append(F.least(wide[-1], F.greatest(F.lit(0.0), part)))
    return wide
