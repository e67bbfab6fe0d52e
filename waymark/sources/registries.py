"""Registries in published layouts: shelter workbooks, meshes of future population, road censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_integer
from . import files

# Sheets and their kinds, what the header's first cells hold, the columns of each layout, and the mark of a hazard.
SHEETS = {"指定緊急避難場所": "emergency", "指定一般避難所": "general", "指定福祉避難所": "welfare"}
HEADER = ("№", "施設名", "住所")
LAYOUT = {
    "emergency": {"flood": 4, "landslide": 5, "storm_surge": 6, "earthquake": 7, "tsunami": 8, "large_fire": 9, "capacity": 10},
    "general": {"phone": 4, "capacity": 5},
    "welfare": {"target_users": 4, "phone": 5, "capacity": 6},
}
HAZARDS = ("flood", "landslide", "storm_surge", "earthquake", "tsunami", "large_fire")
MARKED = "●"
SHELTER_CLASS = "A attributes + B geometry"
# Columns of meshes, and of the road census.
MESH = {"population_2020": "PTN_2020", "population_2025": "PTN_2025", "elderly_65plus_2025": "PTC_2025"}
CENSUS_KIND, CENSUS_SECTION, CENSUS_WAY, CENSUS_VOLUME = "車種区分", "交通量調査単位区間番号", "上り・下りの別", "２４時間自動車類交通量（台）"
CENSUS = {"road_type": "道路種別", "route_number": "路線番号", "observed_flag": "令和３年度調査交通量観測・非観測の別"}


def _chosen(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def shelters(cells: DataFrame) -> DataFrame:
    """(official_id, kind, number, name, address, capacity, phone, target_users, hazards) of the sheets that list shelters.

    ``cells``: path, member (the sheet), row, and cells by number of the column,
    as :func:`files.sheets` gives them.  The header is the first row whose first
    cells hold its labels; rows before it, and those without a number or a name,
    are left out.  Each layout is a table of columns.  Raises if a sheet of a
    known name has no header.
    """
    at = lambda k: F.coalesce(F.col("cells")[F.lit(k)], F.lit(""))
    known = cells.withColumn("kind", _chosen(SHEETS, F.trim("member"))).filter("kind is not null")
    titled = (F.trim(at(1)) == HEADER[0]) & at(2).contains(HEADER[1]) & at(3).contains(HEADER[2])
    heads = known.groupBy("path", "member").agg(F.min(F.when(titled, F.col("row"))).alias("head"))
    if missing := [r.member for r in heads.filter("head is null").limit(3).collect()]:
        raise ValueError(f"no header in {', '.join(missing)}")
    rows = known.join(heads, ["path", "member"]).filter("row > head").withColumn("number", clean_integer(at(1)))
    layout = lambda field: F.coalesce(F.col("cells")[_chosen({k: v[field] for k, v in LAYOUT.items() if field in v}, F.col("kind"))], F.lit(""))
    only = lambda kinds, value: F.when(F.col("kind").isin(*kinds), value)
    hazards = F.create_map(*[x for h in HAZARDS for x in (F.lit(h), layout(h) == MARKED)])
    name = F.trim(at(2))
    found = rows.filter(F.col("number").isNotNull() & (name != ""))
    return found.select(
        F.concat_ws(":", "kind", "number").alias("official_id"), "kind", "number", name.alias("name"), F.trim(at(3)).alias("address"), clean_integer(layout("capacity")).alias("capacity"),
        only(("general", "welfare"), F.trim(layout("phone"))).alias("phone"), only(("welfare",), F.trim(layout("target_users"))).alias("target_users"), only(("emergency",), hazards).alias("hazards"),
    )


def shelter_features(matched: DataFrame) -> DataFrame:
    """(id, feature): a JSON point feature of each matched shelter; hazards stand only with emergency places, target users only with welfare shelters.

    ``matched``: columns of :func:`shelters`, lat, lon, and what the match tells
    (location_source, location_match_method, location_match_quality,
    location_match_score, osm_name, snap_km; null where they are missing).
    """
    labels = {kind: sheet for sheet, kind in SHEETS.items()}
    told = lambda c: F.col(c) if c in matched.columns else F.lit(None).cast("string")
    base = {"shelter_id": F.col("official_id"), "kind": F.col("kind"), "kind_label": _chosen(labels, F.col("kind")), "name": F.col("name"), "address": F.coalesce("address", F.lit("")), "capacity": F.col("capacity")}
    base |= {c: told(c) for c in ("location_source", "location_match_method", "location_match_quality", "location_match_score", "osm_name", "snap_km")}
    base["classification"] = F.lit(SHELTER_CLASS)
    extra = {"emergency": {"hazards": F.coalesce("hazards", F.create_map().cast("map<string,boolean>"))}, "general": {}, "welfare": {"target_users": F.coalesce("target_users", F.lit(""))}}
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))

    def feature(own: dict) -> Column:
        properties = F.struct(*[c.alias(n) for n, c in (base | own).items()])
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("official_id").alias("id"), properties.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"})

    chosen = F.lit(None).cast("string")
    for kind, own in extra.items():
        chosen = F.when(F.col("kind") == kind, feature(own)).otherwise(chosen)
    return matched.select(F.col("official_id").alias("id"), chosen.alias("feature")).filter("feature is not null")


def meshes(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, population_2020, population_2025, elderly_65plus_2025) of each mesh of a collection of polygons, at the mean of its ring's points."""
    own = ", ".join(f"{c}:double" for c in MESH.values())
    rows = spark.read.schema(f"features array<struct<properties:struct<{own}>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = F.coalesce(F.try_element_at("f.geometry.coordinates", F.lit(1)), F.array().cast("array<array<double>>"))
    mean = lambda k: F.coalesce(F.try_divide(F.aggregate(F.transform(ring, lambda p: p[k]), F.lit(0.0), lambda a, x: a + x), F.size(ring).cast("double")), F.lit(0.0))
    return rows.select(mean(0).alias("lon"), mean(1).alias("lat"), *[F.col(f"f.properties.{c}").alias(k) for k, c in MESH.items()])


def mesh_grid(found: DataFrame) -> DataFrame:
    """(zone_id, lon, lat, population_2020, population_2025, elderly_65plus_2025, mesh_count): meshes summed to cells of a tenth of a degree that have people."""
    corner = lambda c: (F.floor(F.col(c) * 10) / 10).alias(c)
    sums = found.groupBy(corner("lon"), corner("lat")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in MESH], F.count("*").alias("mesh_count"))
    kept = sums.filter("population_2025 > 0 or population_2020 > 0")
    return kept.select(F.format_string("grid-%.1f-%.1f", "lon", "lat").alias("zone_id"), "lon", "lat", *[F.round(c, 4).alias(c) for c in MESH], "mesh_count")


def road_census(spark: SparkSession, path: str) -> DataFrame:
    """(section_id, road_type, route_number, observed_flag, observed_24h_total): all motor vehicles in both directions of each section."""
    return census_sections(files.csv_files(spark, path))


def census_sections(cells: DataFrame) -> DataFrame:
    """The same of rows (row, cells): attributes of a section's first row, of each direction the last volume, blank ones 0."""
    at = lambda c: F.coalesce(F.col("cells")[c], F.lit(""))
    rows = cells.filter((at(CENSUS_KIND) == "1") & (at(CENSUS_SECTION) != ""))
    rows = rows.select("row", at(CENSUS_SECTION).alias("section_id"), at(CENSUS_WAY).alias("way"), F.coalesce(F.nullif(F.trim(at(CENSUS_VOLUME)), F.lit("")).cast("double"), F.lit(0.0)).alias("volume"), *[F.col("cells")[c].alias(k) for k, c in CENSUS.items()])
    ways = rows.groupBy("section_id", "way").agg(F.max(F.struct("row", "volume"))["volume"].alias("volume"), F.min(F.struct("row", *CENSUS)).alias("first"))
    found = ways.groupBy("section_id").agg(F.min("first").alias("first"), F.round(F.sum("volume"), 2).alias("observed_24h_total"))
    return found.select("section_id", *[F.col(f"first.{k}").alias(k) for k in CENSUS], "observed_24h_total")
