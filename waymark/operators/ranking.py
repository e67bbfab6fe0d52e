"""Critical services: ranks, peaks and how stable both are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Dense 1..n: most people affected, then largest mean change, then id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("affected"), F.desc("mean_change"), "id")))


def material(affected: Column, loss30: Column, loss60: Column, mean_change: Column, epsilon: float = 1e-6) -> Column:
    return F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in (affected, loss30, loss60, mean_change)]) > epsilon


def day_ranking(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each id by its worst slot (ties: the earliest), then ranked."""
    worst = F.max(F.struct("affected", "mean_change", (-F.col("seconds")).alias("s"))).alias("w")
    best = rows.filter("evaluated").groupBy(*by, "id").agg(worst)
    return ranked(best.select(*by, "id", F.col("w.affected").alias("affected"), F.col("w.mean_change").alias("mean_change"), (-F.col("w.s")).alias("peak_seconds")), by)


def peak_event(rows: DataFrame, by: list[str]) -> DataFrame:
    """The single worst material event; ties to the smaller id, then the earlier slot."""
    order = F.struct((-F.col("affected")).alias("a"), (-F.col("mean_change")).alias("m"), "id", "seconds")
    found = rows.filter("material").groupBy(*by).agg(F.min(order).alias("p"))
    return found.select(*by, F.col("p.id").alias("id"), F.col("p.seconds").alias("seconds"), (-F.col("p.a")).alias("affected"), (-F.col("p.m")).alias("mean_change"))


def first_material(rows: DataFrame, by: list[str]) -> DataFrame:
    """The material id of the lowest rank in each slot; null if there is none."""
    return rows.groupBy(*by).agg(F.min(F.when(F.col("material"), F.struct("rank", "id")))["id"].alias("id"))


def top_changes(tops: DataFrame, by: list[str]) -> DataFrame:
    """How often the top id changes from slot to slot, slots without one left out."""
    before = F.lag("id").over(Window.partitionBy(*by).orderBy("seconds"))
    return tops.filter("id is not null").withColumn("changed", before.isNotNull() & (before != F.col("id"))).groupBy(*by).agg(F.count(F.when(F.col("changed"), 1)).alias("changes"))


def stability(ranks: DataFrame, reference: str, top: int = 3) -> DataFrame:
    """Whether the reference case's first id stays first, or among the ``top``, in other cases."""
    first = ranks.filter((F.col("case_id") == reference) & (F.col("rank") == 1)).select(F.col("id").alias("reference_id"))
    cases = ranks.select("case_id").distinct().join(F.broadcast(first))
    found = cases.join(ranks.select("case_id", F.col("id").alias("reference_id"), "rank"), ["case_id", "reference_id"], "left")
    outside = F.col("rank").isNull() | (F.col("rank") > top)
    return found.groupBy("reference_id").agg(
        F.count("*").alias("cases"), F.count(F.when(F.col("rank") == 1, 1)).alias("top1"), F.count(F.when(~outside, 1)).alias("top_k"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.coalesce(F.col("rank") != 1, F.lit(True)), F.col("case_id")))), ",").alias("changed"),
        F.array_join(F.sort_array(F.collect_list(F.when(outside, F.col("case_id")))), ",").alias("outside"),
    )
