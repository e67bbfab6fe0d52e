"""Versions of datasets: files staged by content, and a log of decisions replayed at once.

A version is a dataset with the content of a file, so its name follows from the
digest and so does whether it passes.  The log holds, in order of ``at``, what
was done with versions: ``stage``, ``approve`` or ``rollback``.  What the log
comes to needs no replay: a version's state follows from the last times of few
things, which are maxima.  So one version or one dataset may hold any part of
the log.

Cases: an approval or a rollback of a version that was not staged before, or
that did not pass, is refused and changes nothing; a version staged again is new
again, whatever it was; where stagings of one version do not agree on whether it
passes, the last counts; rows of equal ``at`` in one dataset are an error of the
log, and those of one version are taken as repeated; rows without an action,
dataset, version or time are passed over; an empty log has no versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PASSED, FAILED = "passed", "failed"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, checksum): the SHA-256 of each file below ``path``; Spark plans no read of empty files, which get no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"))


def staged(files: DataFrame, passes: Column) -> DataFrame:
    """``files`` (dataset_id, content) with checksum, version_id, validation_status and status instead of the content.

    ``passes`` says whether a row is valid; null counts as not.  Files of one
    dataset with equal contents are one version, as rows they stay.
    """
    checksum = F.sha2(F.col("content").cast("binary"), 256)
    passed = F.coalesce(passes, F.lit(False))
    return files.withColumns({
        "checksum": checksum,
        "version_id": F.concat_ws("-", "dataset_id", F.substring(checksum, 1, 12)),
        "validation_status": F.when(passed, PASSED).otherwise(FAILED),
        "status": F.when(passed, "validated").otherwise("candidate"),
    }).drop("content")


def _versions(log: DataFrame) -> DataFrame:
    """Of each version: when it was first and last staged, whether it passed, when it was last approved and rolled back to with effect."""
    last = lambda action: F.max(F.when(F.col("action") == action, F.col("at")))
    stage = F.col("action") == "stage"
    known = log.dropna(subset=["action", "dataset_id", "version_id", "at"]).groupBy("dataset_id", "version_id").agg(
        F.min(F.when(stage, F.col("at"))).alias("first"), last("stage").alias("staged_at"),
        F.max(F.when(stage, F.struct("at", F.coalesce(F.col("validation_status") == PASSED, F.lit(False)).alias("passed")))).getField("passed").alias("passed"),
        last("approve").alias("approved"), last("rollback").alias("rolled"),
    )
    # The last decision is after the first staging, or none is.
    valid = lambda c: F.when(F.col("passed") & (F.col(c) > F.col("first")), F.col(c))
    rolled = valid("rolled")
    return known.withColumns({"activated": F.greatest(valid("approved"), rolled), "rolled": rolled})


def lifecycle(log: DataFrame) -> DataFrame:
    """(dataset_id, version_id, staged_at, validation_status, status) of each staged version once the log is through; in order of ``staged_at``, a dataset's rows are its list."""
    versions = _versions(log).filter(F.col("staged_at").isNotNull())
    newest = versions.groupBy("dataset_id").agg(F.max("activated").alias("newest"), F.max("rolled").alias("last_rollback"))
    # A rollback that comes after all that happened to a version is another version's.
    status = (
        F.when(F.col("activated") > F.col("staged_at"), F.when(F.col("activated") == F.col("newest"), "active").otherwise("archived"))
        .when(F.col("last_rollback") > F.col("staged_at"), "archived")
        .when(F.col("passed"), "validated")
        .otherwise("candidate")
    )
    told = F.when(F.col("passed"), PASSED).otherwise(FAILED)
    return versions.join(newest, "dataset_id").select("dataset_id", "version_id", "staged_at", told.alias("validation_status"), status.alias("status"))


def refused(log: DataFrame) -> DataFrame:
    """The log's decisions without effect, with the reason: ``unknown`` versions, and those that did ``not passed``."""
    known = _versions(log).select("dataset_id", "version_id", "first", "passed")
    asked = log.filter(F.col("action").isin("approve", "rollback")).dropna(subset=["dataset_id", "version_id", "at"])
    late = F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    reason = F.when(~late, "unknown").when(~F.col("passed"), "not passed")
    return asked.join(known, ["dataset_id", "version_id"]).withColumn("reason", reason).filter("reason IS NOT NULL").select("dataset_id", "version_id", "at", "action", "reason")
