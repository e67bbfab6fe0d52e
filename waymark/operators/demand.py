"""Trip matrices and measures of fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import geh
from .tables import sent_if_small, settled


class Factors:
    """Cells of a matrix that are never rewritten, and a factor for each row, column and group.

    A cell's value is its seed times its factors.  Scaling one side to its
    targets needs the sums of the cells under the other factors only, which are
    added up in parts, so a large row is spread over tasks like any other.
    """

    def __init__(self, seed: DataFrame, rows: DataFrame, columns: DataFrame, groups: DataFrame | None = None):
        self.sides = {"origin": rows.select("origin", F.col("row_target").alias("target")), "destination": columns.select("destination", F.col("column_target").alias("target"))}
        if groups is not None:
            self.sides["group"] = groups.select("group", "target")
        kept = seed.join(rows.select("origin"), "origin", "left_semi").join(columns.select("destination"), "destination", "left_semi")
        self.cells = settled(kept.select("origin", "destination", "value", *(["group"] if groups is not None else [])))
        self.sides = {k: settled(t) for k, t in self.sides.items()}
        self.found = {k: sent_if_small(settled(t.select(k, F.lit(1.0).alias("factor")))) for k, t in self.sides.items()}

    def values(self, *but: str) -> DataFrame:
        """The cells with their values under all factors but those of the named sides; a cell of no such side keeps its value."""
        out, product = self.cells, F.col("value")
        for k in self.sides:
            if k not in but:
                out = out.join(self.found[k].withColumnRenamed("factor", f"factor_{k}"), k, "left")
                product = product * F.coalesce(f"factor_{k}", F.lit(1.0))
        return out.withColumn("value", product).select(*self.cells.columns)

    def scale(self, key: str) -> None:
        """Scales one side to its targets; where there is nothing to scale its factor is 0."""
        sums = self.values(key).groupBy(key).agg(F.sum("value").alias("sum"))
        found = self.sides[key].join(sums, key, "left").select(key, F.coalesce(F.try_divide(F.col("target"), F.col("sum")), F.lit(0.0)).alias("factor"))
        # With two sides the plan of a turn names the one before once; with three it would name it again and again.
        self.found[key] = sent_if_small(settled(found)) if len(self.sides) > 2 else found

    def settle(self) -> None:
        """Writes the factors, so that the next turns begin with tables."""
        if len(self.sides) > 2:
            return
        self.found = {k: sent_if_small(settled(t)) for k, t in self.found.items()}

    def error(self) -> float:
        """The largest difference between a row's or column's sum and its target."""
        values, off = settled(self.values()), []
        for k in ("origin", "destination"):
            sums = values.groupBy(k).agg(F.sum("value").alias("sum"))
            off.append(self.sides[k].join(sums, k, "inner").select(F.abs(F.col("sum") - F.col("target")).alias("e")))
        return off[0].unionAll(off[1]).agg(F.max("e")).first()[0] or 0.0


def balanced(seed: DataFrame, rows: DataFrame, columns: DataFrame, groups: DataFrame | None = None, iterations: int = 5000, tolerance: float = 1e-10, every: int = 5) -> DataFrame:
    """(origin, destination, value) scaled by turns to row and column totals (and group-pair totals).

    ``seed``: origin, destination, value (and group, where ``groups`` has
    group, target); ``rows``: origin, row_target; ``columns``: destination,
    column_target.  ``every`` so many turns, one plan, the factors are written
    and the sums looked at.  Raises if totals disagree or it does not converge.
    """
    sums = rows.agg(F.sum("row_target")).first()[0], columns.agg(F.sum("column_target")).first()[0]
    if abs((sums[0] or 0.0) - (sums[1] or 0.0)) > 1e-9 * max(1.0, abs(sums[0] or 0.0)):
        raise ValueError(f"row and column totals differ: {sums}")
    state = Factors(seed, rows, columns, groups)
    for n in range(1, iterations + 1):
        for key in state.sides:
            state.scale(key)
        if n % every == 0 or n == iterations:
            state.settle()
            if state.error() <= tolerance:
                return state.values().select("origin", "destination", "value")
    raise ValueError("balancing did not converge")


def balanced_rounds(seed: DataFrame, rows: DataFrame, columns: DataFrame, rounds: int) -> DataFrame:
    """A stated number of turns of the same scaling, as one plan."""
    state = Factors(seed, rows, columns)
    for _ in range(rounds):
        for key in state.sides:
            state.scale(key)
    return state.values().select("origin", "destination", "value")


def fit_measures(pairs: DataFrame) -> DataFrame:
    """MAPE, RMSE, WAPE and the share of GEH below 5 of ``model`` against ``observed``; NaN where undefined."""
    m, o = F.col("model"), F.col("observed")
    nan = F.lit(float("nan"))
    return pairs.agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg(F.when(F.abs(o) > 0, F.abs((m - o) / F.nullif(o, F.lit(0.0))))) * 100, nan), 6).alias("mape"),
        F.round(F.coalesce(F.sqrt(F.avg(F.pow(m - o, 2))), nan), 6).alias("rmse"),
        F.round(F.coalesce(F.try_divide(F.sum(F.abs(m - o)), F.sum(F.abs(o))) * 100, nan), 6).alias("wape"),
        F.round(F.coalesce(F.avg((geh(m, o) < 5).cast("double")) * 100, nan), 6).alias("geh_below_5_pct"),
    )


def screenline(links: DataFrame, model: DataFrame, observed: DataFrame) -> DataFrame:
    """Totals over the stated links (repeats count again, missing ones as 0) and the error."""
    met = links.join(model, "edge_id", "left").join(observed, "edge_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return met.agg(F.round(total("model"), 4).alias("model"), F.round(total("observed"), 4).alias("observed"), F.round(F.coalesce(F.try_divide(total("model") - total("observed"), total("observed")) * 100, F.lit(float("nan"))), 4).alias("error_pct"))


def vehicle_km(volumes: DataFrame, lengths: DataFrame) -> DataFrame:
    return volumes.join(lengths, "edge_id", "left").agg(F.round(F.coalesce(F.sum(F.col("volume") * F.coalesce("length_km", F.lit(0.0))), F.lit(0.0)), 4).alias("vkt"))


def purposes(records: DataFrame) -> DataFrame:
    """(purpose, records, demand): the records of each purpose summed; as a partitioned table, write them by purpose."""
    return records.groupBy("purpose").agg(F.count("*").alias("records"), F.sum("demand").alias("demand"))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two series of one length, joined by their key; raises where lengths or keys differ."""
    n, m = left.count(), right.count()
    met = left.join(right, key)
    if n != m or met.count() != n:
        raise ValueError(f"series differ: {n} and {m} values")
    return met
