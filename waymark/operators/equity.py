"""Access compared between age groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = ("all", "65plus", "75plus", "85plus")


def unpivoted(rows: DataFrame, keep: list[str], weights: dict[str, str]) -> DataFrame:
    """One row for each group, with its weight, negative ones as 0."""
    groups = F.array(*[F.struct(F.lit(g).alias("group"), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))).alias("weight")) for g, c in weights.items()])
    return rows.select(*keep, F.explode(groups).alias("g")).select(*keep, "g.group", "g.weight")


def group_access(rows: DataFrame, by: list[str]) -> DataFrame:
    """Twelve measures of each group; ``rows`` have group, weight, before, after."""
    w, b, a = F.col("weight"), F.col("before"), F.col("after")
    total = F.sum(w)
    summed = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    mean = lambda c: F.try_divide(F.sum(w * c), F.sum(F.when(c.isNotNull(), w)))
    measures = [F.round(total, 4).alias("population"), F.round(summed(b <= 30), 4).alias("reachable_30"), F.round(summed(b <= 60), 4).alias("reachable_60")]
    for m in (1, 5, 10):
        measures += [F.round(summed(a - b > m), 4).alias(f"affected_{m}"), F.round(F.try_divide(100 * summed(a - b > m), total), 3).alias(f"affected_{m}_pct")]
    measures += [F.round(mean(b), 3).alias("mean_before"), F.round(mean(a), 3).alias("mean_after"), F.round(mean(a) - mean(b), 3).alias("mean_change")]
    return rows.groupBy(*by, "group").agg(*measures)


def gaps(groups: DataFrame, by: list[str]) -> DataFrame:
    """Each group against all people, on rounded measures; positive is the larger burden."""
    overall = groups.filter(F.col("group") == "all").select(*by, F.col("affected_1_pct").alias("_share"), F.col("mean_change").alias("_change"))
    others = groups.filter(F.col("group") != "all").join(overall, by)
    return others.select(*by, "group", F.round(F.col("affected_1_pct") - F.col("_share"), 3).alias("share_gap"), F.round(F.col("mean_change") - F.col("_change"), 3).alias("change_gap"))
