"""Places out of map elements and registries, and age context out of regional tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tolerant_number

# Column names of the registry and of the age table, the pattern of age bands, parts of an address.
REGISTRY = {"official_id": "機関コード", "name": "正式名称", "short_name": "略称", "emergency": "救急告示医療機関"}
REGISTRY_KIND, REGISTRY_STATE, REGISTRY_LAT, REGISTRY_LON = "機関区分", "活動区分", "所在地座標（緯度）", "所在地座標（経度）"
AGE_CODE, AGE_TOTAL = "地域コード", "総人口"
AGE_BAND = r"^(\d+)(?:-\d+)?歳(?:以上)?の(?:男性|女性)$"
ADDRESS_PARTS = ("addr:province", "addr:city", "addr:suburb", "addr:quarter", "addr:street", "addr:housenumber")
AMENITIES = ("hospital", "clinic", "townhall")


def vertex_mean(points: Column, field: str) -> Column:
    """Mean over the vertices of a shape; a closing vertex counts as any other.  Null without vertices."""
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p[field])
    return F.when(F.size(points) > 0, total / F.size(points))


def _location(elements: DataFrame, field: str, centre: bool) -> Column:
    own = F.when(F.col("type") == "node", F.col(field))
    middle = [F.col("center")[field]] if centre and "center" in elements.columns else []
    return F.coalesce(own, *middle, vertex_mean(F.col("geometry"), field))


def _name() -> Column:
    return F.coalesce(F.nullif(F.col("tags")["name"], F.lit("")), F.nullif(F.col("tags")["name:ja"], F.lit("")))


def facilities(elements: DataFrame, amenities: tuple[str, ...] = AMENITIES) -> DataFrame:
    """(place_id, name, amenity, lat, lon) of elements of the given kinds; those without a location are left out."""
    kind = F.col("tags")["amenity"]
    found = elements.filter(kind.isin(*amenities)).select(F.concat_ws(":", F.lit("osm"), "type", "id").alias("place_id"), F.coalesce(_name(), kind).alias("name"), kind.alias("amenity"), _location(elements, "lat", False).alias("lat"), _location(elements, "lon", False).alias("lon"))
    return found.filter("lat is not null and lon is not null")


def named_places(elements: DataFrame) -> DataFrame:
    """(place_id, name, address, lat, lon) of named elements that may be a public building, each id once."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    public = (tag("amenity") != "") | (tag("leisure") != "") | (tag("building") != "") | (tag("office") == "government") | (tag("tourism") != "")
    address = F.coalesce(F.nullif(tag("addr:full"), F.lit("")), F.concat(*map(tag, ADDRESS_PARTS)))
    found = elements.filter(public).select(F.concat_ws(":", F.lit("osm"), "type", "id").alias("place_id"), _name().alias("name"), address.alias("address"), _location(elements, "lat", True).alias("lat"), _location(elements, "lon", True).alias("lon"))
    return found.filter("name is not null and lat is not null and lon is not null").dropDuplicates(["place_id"])


def active_hospitals(cells: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Active hospitals of a registry (a map of cells a row) within bounds, which are included."""
    cell = lambda k: F.col("cells")[k]
    lat, lon = cell(REGISTRY_LAT).try_cast("double"), cell(REGISTRY_LON).try_cast("double")
    rows = cells.filter((cell(REGISTRY_KIND) == "1") & (cell(REGISTRY_STATE) == "活動中"))
    return rows.select(*[F.coalesce(cell(c), F.lit("")).alias(k) for k, c in REGISTRY.items()], lat.alias("lat"), lon.alias("lon")).filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def age_bands(columns: list[str]) -> dict[str, int]:
    """Columns that count an age band, and the band's lowest age."""
    return {c: int(m[1]) for c in columns if (m := re.match(AGE_BAND, c.strip()))}


def age_context(rows: DataFrame) -> DataFrame:
    """One row: regions, population, and people and shares from 65, 75 and 85 on.  Raises without age columns."""
    bands = age_bands(rows.columns)
    if not bands or not {AGE_CODE, AGE_TOTAL} <= set(rows.columns):
        raise ValueError("columns of the age table are missing")
    count = lambda c: F.greatest(F.lit(0.0), tolerant_number(F.col(f"`{c}`")))
    kept = rows.filter(F.trim(F.coalesce(AGE_CODE, F.lit(""))) != "")
    from_age = {t: sum((count(c) for c, low in bands.items() if low >= t), F.lit(0.0)) for t in (65, 75, 85)}
    total = F.sum(count(AGE_TOTAL))
    people = [F.round(F.sum(x), 4).alias(f"population_{t}plus") for t, x in from_age.items()]
    shares = [F.round(F.try_divide(100 * F.sum(x), total), 3).alias(f"share_{t}plus_pct") for t, x in from_age.items()]
    return kept.agg(F.count("*").alias("regions"), F.round(total, 4).alias("population"), *people, *shares)
