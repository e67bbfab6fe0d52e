"""Features, provenance and versions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import shown_minutes

CLASSES = ("A", "B", "C", "D")


def point_features(rows: DataFrame, key: str, *properties: str) -> DataFrame:
    """(id, feature): a JSON point feature of each row; write them as text, a line each."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).cast("string").alias("id"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("feature"))


def change_features(rows: DataFrame, key: str) -> DataFrame:
    """(id, feature): points with before, after and delta minutes at two decimals, null where not finite."""
    shown = [F.round(shown_minutes(F.col("before")), 2).alias("before"), F.round(shown_minutes(F.col("after")), 2).alias("after"), shown_minutes(F.col("after") - F.col("before")).alias("delta")]
    return point_features(rows.select(F.col(key), "lat", "lon", *shown), key, "before", "after", "delta")


def json_lines(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """(value): each row as JSON, compact or indented; ``write.text`` makes the artifact."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": str(pretty).lower()}).alias("value"))


def line_features(stop_times: DataFrame, stops: DataFrame, shapes: DataFrame, trips: DataFrame) -> DataFrame:
    """(route_id, trip_id, source, points): each route along its first trip's shape, else its stops, else nothing."""
    first = trips.groupBy("route_id").agg(F.min(F.struct("trip_id", "shape_id")).alias("t")).select("route_id", "t.*")
    ordered = lambda df, key, seq, lat, lon: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).cast("int").alias("n"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")))), lambda p: F.array(p["lon"], p["lat"])).alias("points"))
    drawn = ordered(shapes, "shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon").withColumnRenamed("points", "drawn")
    visited = ordered(stop_times.join(stops, "stop_id"), "trip_id", "stop_sequence", "stop_lat", "stop_lon").withColumnRenamed("points", "visited")
    met = first.join(drawn, "shape_id", "left").join(visited, "trip_id", "left")
    two = lambda c: F.coalesce(F.size(c) >= 2, F.lit(False))
    source = F.when(two("drawn"), "official_shape").when(two("visited"), "stop_polyline").otherwise("none")
    return met.select("route_id", "trip_id", source.alias("source"), F.when(two("drawn"), F.col("drawn")).when(two("visited"), F.col("visited")).alias("points"))


def stable_id(*columns: str) -> Column:
    """The first 16 digits of the SHA-256 of the named values as JSON, keys in order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def provenance_errors(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False)))


def manifest(artifacts: DataFrame, git_sha: str | None = None) -> DataFrame:
    """Provenance of each artifact (artifact_id, classification, model_version, parameters); what else it does not have is empty.

    Another classification than those known is an error when the rows are read.
    """
    none = {
        "input_data_versions": F.expr("cast(array() as array<map<string,string>>)"), "scenario_id": F.lit(None).cast("string"),
        "random_seed": F.lit(None).cast("long"), "limitations": F.expr("cast(array() as array<string>)"),
    }
    own = lambda c: F.coalesce(F.col(c), none[c]) if c in artifacts.columns else none[c]
    right = F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False))
    return artifacts.select(
        F.lit("1.0.0").alias("schema_version"), "artifact_id",
        F.when(right, F.col("classification")).otherwise(F.raise_error(F.lit("classification must be A, B, C, or D"))).alias("classification"),
        own("input_data_versions").alias("input_data_versions"), "model_version", own("scenario_id").alias("scenario_id"), "parameters",
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("generated_at_utc"),
        F.lit(git_sha).cast("string").alias("git_sha"), own("random_seed").alias("random_seed"), own("limitations").alias("limitations"),
    )


def ordered_union(a: Column, b: Column) -> Column:
    """``a`` followed by what else is in ``b``, in its order; null is empty."""
    some = F.coalesce(a, F.filter(b, lambda _: F.lit(False)))
    return F.coalesce(F.concat(some, F.array_except(b, some)), some)


def merged_manifests(manifests: DataFrame, result_stage: str, ui_release_stage: str, capabilities: Column, artifacts: Column) -> DataFrame:
    """``manifests`` with capabilities and artifacts added and both stages stated; one that is at another result stage is an error when the rows are read."""
    same = F.col("result_stage").eqNullSafe(F.lit(result_stage))
    changed = F.raise_error(F.concat(F.lit(f"manifest result stage changed: expected {result_stage}, got "), F.coalesce("result_stage", F.lit("none"))))
    return manifests.withColumns({
        "ui_capabilities": ordered_union(F.col("ui_capabilities"), capabilities),
        "artifacts": ordered_union(F.col("artifacts"), artifacts),
        "analysis_result_stage": F.when(same, F.lit(result_stage)).otherwise(changed),
        "ui_release_stage": F.lit(ui_release_stage),
    })


def approved(versions: DataFrame, version_id: str) -> DataFrame:
    """The version becomes active and its dataset's active one archived; raises unless its validation passed."""
    own = versions.filter(F.col("version_id") == version_id).select("dataset_id", "validation_status").first()
    if own is None or own.validation_status != "passed":
        raise ValueError(f"{version_id} is unknown or did not pass")
    peer = (F.col("dataset_id") == own.dataset_id) & (F.col("status") == "active")
    return versions.withColumn("status", F.when(F.col("version_id") == version_id, "active").when(peer, "archived").otherwise(F.col("status")))


def rolled_back(versions: DataFrame, version_id: str) -> DataFrame:
    """The version becomes active; every other one of its dataset is archived.  Raises unless its validation passed."""
    own = versions.filter(F.col("version_id") == version_id).select("dataset_id", "validation_status").first()
    if own is None or own.validation_status != "passed":
        raise ValueError(f"{version_id} is unknown or did not pass")
    return versions.withColumn("status", F.when(F.col("version_id") == version_id, "active").when(F.col("dataset_id") == own.dataset_id, "archived").otherwise(F.col("status")))
