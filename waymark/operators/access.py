"""Accessibility: earliest arrivals over a timetable, and what populations reach.

Unreachable is null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WALK_KMH, rescaled_walk
from . import scan
from .scan import NEVER
from .tables import sent_if_small, settled


def scan_fold(connections: Column, start: Column) -> Column:
    """Labels after all rides: an ordered fold over an array, made of built-in functions.

    ``connections`` is an array of (dep, arr, from_stop, to_stop) in scanning
    order, ``start`` a map from stop to seconds.  Without transfers.
    """
    def ride(labels, c):
        boarded = F.coalesce(F.element_at(labels, c["from_stop"]), F.lit(NEVER)) <= c["dep"]
        better = boarded & (c["arr"] < F.coalesce(F.element_at(labels, c["to_stop"]), F.lit(NEVER)))
        return F.when(better, F.map_concat(F.map_filter(labels, lambda k, _: k != c["to_stop"]), F.create_map(c["to_stop"], c["arr"]))).otherwise(labels)

    return F.aggregate(connections, start, ride)


def labelled(access: DataFrame, most_walk: float) -> DataFrame:
    """(scenario, start, zone_id, stop_id, label): the stops that each zone can walk to, and when one is there."""
    near = access.filter(F.col("walk_minutes") <= most_walk)
    return near.select("scenario", "start", "zone_id", "stop_id", (F.col("start") + F.bround(F.col("walk_minutes") * 60).cast("long")).alias("label"))


def _seconds(transfers: DataFrame) -> DataFrame:
    return transfers.select("scenario", "from_stop", "to_stop", F.bround(F.col("transfer_minutes") * 60).cast("long").alias("seconds"))


def earliest_arrivals(access: DataFrame, rides: DataFrame, transfers: DataFrame | None = None, most_walk: float = 20.0) -> DataFrame:
    """(scenario, zone_id, stop_id, seconds): when each zone's people can be at each stop.

    ``access``: scenario, start (seconds), zone_id, stop_id, walk_minutes;
    ``rides``: scenario, seq, dep, arr, from_stop, to_stop, those of withdrawn
    services left out; ``transfers``: from_stop, to_stop, transfer_minutes, and
    scenario where they differ.
    """
    near = labelled(access, most_walk)
    if transfers is not None:
        transfers = _seconds(transfers if "scenario" in transfers.columns else transfers.crossJoin(near.select("scenario").distinct()))
    return scan.arrivals(near, rides, transfers)


def leave_one_out(access: DataFrame, rides: DataFrame, transfers: DataFrame | None, egress: DataFrame) -> DataFrame:
    """(scenario, zone_id, destination, kind, id, ride) as :func:`scan.without_each` tells: the least minutes to ride, and without each route and trip where they differ.

    ``rides`` have route_id and trip_id too; ``egress``: scenario, stop_id, destination, minutes.
    """
    return scan.without_each(labelled(access, float("inf")), rides, None if transfers is None else _seconds(transfers), egress)


def best_minutes(zones: DataFrame, direct: DataFrame, arrivals: DataFrame, egress: DataFrame, starts: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(scenario, zone_id, minutes): the better of walking all the way and of riding.

    ``direct``: zone_id, minutes; ``egress``: stop_id, minutes to the facility;
    ``starts``: scenario, start, and speed_kmh where walking differs from the
    standard.  Both walks are rescaled to it.  With a column destination in
    ``direct`` and ``egress``, one row for each destination.  ``profiles``:
    zone_id and the zone, profile, whose arrivals it has, where not its own.
    """
    to = ["destination"] if "destination" in egress.columns else []
    speed = F.col("speed_kmh") if "speed_kmh" in starts.columns else F.lit(WALK_KMH)
    ride = arrivals.withColumnRenamed("zone_id", "profile").join(egress, "stop_id").join(starts, "scenario")
    ride = ride.groupBy("scenario", "profile", *to).agg(F.min((F.col("seconds") - F.col("start")) / 60.0 + rescaled_walk(F.col("minutes"), speed)).alias("ride"))
    every = zones.select("zone_id")
    every = every.crossJoin(egress.select(*to).distinct()) if to else every
    # Tables of zones are merged: sizes of derived tables are underestimated, and a driver that sends them to all tasks runs out of memory.
    every = every.join(direct.hint("merge"), ["zone_id", *to], "left")
    every = every.withColumn("profile", F.col("zone_id")) if profiles is None else every.join(profiles.hint("merge"), "zone_id", "left")
    met = every.crossJoin(starts.drop("start")).join(sent_if_small(settled(ride)), ["scenario", "profile", *to], "left")  # every zone has a row in every scenario
    return met.select("scenario", "zone_id", *to, F.least(rescaled_walk(F.col("minutes"), speed), F.col("ride")).alias("minutes"))


def population_access(rows: DataFrame, by: list[str], thresholds: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Population within each threshold, its share, and the weighted mean over those who reach at all."""
    reach = lambda t: F.coalesce(F.sum(F.when(F.col("minutes") <= t, F.col("population"))), F.lit(0.0))
    total, known = F.sum("population"), F.when(F.col("minutes").isNotNull(), F.col("population"))
    measures = [F.round(total, 4).alias("population"), F.count("*").alias("zones")]
    for t in thresholds:
        measures += [F.round(reach(t), 4).alias(f"reachable_{t}min"), F.coalesce(F.round(F.try_divide(reach(t), total) * 100, 3), F.lit(0.0)).alias(f"reachable_{t}min_pct")]
    measures.append(F.round(F.try_divide(F.sum(F.col("population") * F.col("minutes")), F.sum(known)), 3).alias("mean_minutes"))
    return rows.groupBy(*by).agg(*measures) if by else rows.agg(*measures)


def impact(pairs: DataFrame, by: list[str]) -> DataFrame:
    """What a disruption does: ``pairs`` have population, before and after.

    Increases count where both are known; losses and means each over their own zones.
    """
    delta = F.col("after") - F.col("before")
    more = lambda m: F.round(F.coalesce(F.sum(F.when(delta > m, F.col("population"))), F.lit(0.0)), 4)
    reach = lambda c, t: F.round(F.coalesce(F.sum(F.when(F.col(c) <= t, F.col("population"))), F.lit(0.0)), 4)
    mean = lambda c: F.round(F.try_divide(F.sum(F.col("population") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("population")))), 3)
    return pairs.groupBy(*by).agg(
        more(1).alias("affected_1"), more(5).alias("affected_5"), more(10).alias("affected_10"),
        F.round(reach("before", 30) - reach("after", 30), 4).alias("loss_30"), F.round(reach("before", 60) - reach("after", 60), 4).alias("loss_60"),
        F.round(mean("after") - mean("before"), 3).alias("mean_change"),
    )


def threshold_losses(pairs: DataFrame, by: list[str], thresholds: tuple[int, ...] = (30, 45, 60, 90)) -> DataFrame:
    """(by, threshold, loss): population that falls out of each threshold, net."""
    reach = lambda c: F.coalesce(F.sum(F.when(F.col(c) <= F.col("threshold"), F.col("population"))), F.lit(0.0))
    each = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return each.groupBy(*by, "threshold").agg(F.round(reach("before") - reach("after"), 4).alias("loss"))


def monotonic_violations(pairs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows that a withdrawal improves: faster than before, or reachable only after."""
    return pairs.filter((F.col("after") < F.col("before") - tolerance) | (F.col("before").isNull() & F.col("after").isNotNull()))


def transfer_effect(pairs: DataFrame, by: list[str], least: float = 0.01) -> DataFrame:
    """What transfers add: ``before`` without, ``after`` with them."""
    gain = F.col("before") - F.col("after")
    better = (gain > least) | (F.col("before").isNull() & F.col("after").isNotNull())
    return pairs.groupBy(*by).agg(
        F.count(F.when(better, 1)).alias("improved_zones"), F.round(F.coalesce(F.sum(F.when(better, F.col("population"))), F.lit(0.0)), 4).alias("improved_population"),
        F.count(F.when(F.col("before").isNull() & F.col("after").isNotNull(), 1)).alias("newly_reachable"), F.round(F.max(gain), 4).alias("largest_gain"),
    )


def weighted_cdf(rows: DataFrame, by: list[str], step: int = 5, last: int = 120) -> DataFrame:
    """(by, minute, share): population share within each multiple of ``step``.

    Rows are first counted into steps, so the running sum is over few rows a group.
    """
    slot = F.when(F.col("minutes") <= last, F.greatest(F.ceil(F.col("minutes") / step), F.lit(0)) * step)
    sums = rows.groupBy(*by, slot.alias("slot")).agg(F.sum("population").alias("population"))
    total = sums.groupBy(*by).agg(F.sum("population").alias("total")).withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(step))))
    met = total.join(sums, by).groupBy(*by, "minute", "total").agg(F.sum(F.when(F.col("slot") <= F.col("minute"), F.col("population"))).alias("within"))
    return met.select(*by, "minute", F.round(F.coalesce(F.try_divide(F.coalesce("within", F.lit(0.0)), F.col("total")), F.lit(0.0)), 6).alias("share"))


def reachable_population(rows: DataFrame, by: list[str], thresholds: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Population in all and within each threshold, unrounded; null minutes are never within."""
    within = [F.coalesce(F.sum(F.when(F.col("minutes") <= t, F.col("population"))), F.lit(0.0)).alias(f"reachable_{t}_min") for t in thresholds]
    return rows.groupBy(*by).agg(F.coalesce(F.sum("population"), F.lit(0.0)).alias("total_population"), *within)


def accessibility_loss(before: DataFrame, after: DataFrame, by: list[str], thresholds: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """What is lost between two results of :func:`reachable_population`, and in percent of before; 0 percent of nothing."""
    met = before.alias("b").join(after.alias("a"), by, "left")
    out = []
    for t in thresholds:
        b, a = F.col(f"b.reachable_{t}_min"), F.coalesce(F.col(f"a.reachable_{t}_min"), F.lit(0.0))
        out += [(b - a).alias(f"loss_{t}_min"), F.coalesce(F.try_divide(b - a, b) * 100, F.lit(0.0)).alias(f"loss_pct_{t}_min")]
    return met.select(*by, *out)


def affected_from(pairs: DataFrame, by: list[str], thresholds: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(by, threshold, affected): population whose time grows by a threshold or more."""
    each = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    grown = F.sum(F.when(F.col("after") - F.col("before") >= F.col("threshold"), F.col("population")))
    return each.groupBy(*by, "threshold").agg(F.round(F.coalesce(grown, F.lit(0.0)), 4).alias("affected"))


def road_access(pairs: DataFrame, by: list[str], least: float = 1e-9) -> DataFrame:
    """Zones and people that a road closure sets back or cuts off, the plain mean change, and who still reaches within an hour."""
    worse = (F.col("after") > F.col("before") + least) | (F.col("before").isNotNull() & F.col("after").isNull())
    people = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("population"))), F.lit(0.0)), 4)
    return pairs.groupBy(*by).agg(F.count(F.when(worse, 1)).alias("worse"), people(worse).alias("worse_population"), F.round(F.avg(F.col("after") - F.col("before")), 6).alias("mean_change"), people(F.col("after") <= 60).alias("reach_60"))


def both_reachable(nodes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, before, after, delta) of the nodes that are reached both times; ``before`` and ``after``: node_id, minutes.  Raises without nodes."""
    if nodes.isEmpty():
        raise ValueError("no freight nodes")
    side = lambda df, name: df.select("node_id", F.col("minutes").alias(name))
    met = nodes.join(side(before, "before"), "node_id", "left").join(side(after, "after"), "node_id", "left").filter("before is not null and after is not null")
    return met.select("node_id", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def relief_status(hubs: DataFrame, shelters: DataFrame, times: DataFrame, most: float = 180.0) -> DataFrame:
    """(hub, shelter, minutes, status) of every hub with every shelter; hubs are a stated, short list."""
    met = hubs.crossJoin(shelters).join(times, ["hub", "shelter"], "left")
    status = F.when(F.col("minutes").isNull(), "unreachable_under_network").when(F.col("minutes") <= most, "reachable_under_network").otherwise("over_threshold")
    return met.select("hub", "shelter", "minutes", status.alias("status"))


def zone_contract(zones: DataFrame, other: DataFrame, nested: tuple[str, ...] = ()) -> DataFrame:
    """``zones`` with the columns of ``other``, one row a zone_id in both; raises where a zone is missing, twice, or its ``nested`` columns grow."""
    met = zones.join(other.withColumn("_met", F.lit(1)), "zone_id", "left")
    wider = [F.col(a) < F.col(b) for a, b in zip(nested, nested[1:], strict=False)]
    told = F.when(F.col("_met").isNull(), "zone without a partner: ").when(F.count("*").over(Window.partitionBy("zone_id")) > 1, "zone with several partners: ")
    for bad in wider:
        told = told.when(bad, "narrower group is larger: ")
    error = F.when(told.isNotNull(), F.raise_error(F.concat(told, F.col("zone_id").cast("string"))).cast("int")).otherwise(F.lit(0))
    return met.withColumn("_ok", error).filter("_ok = 0").drop("_met", "_ok")


def zone_contract_errors(zones: DataFrame, other: DataFrame, nested: tuple[str, ...] = ()) -> DataFrame:
    """(missing, repeated, not_nested): how many zones break the same contract."""
    counts = other.groupBy("zone_id").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in nested if c in other.columns])
    met = zones.join(counts, "zone_id", "left")
    larger = F.lit(False)
    for a, b in zip(nested, nested[1:], strict=False):
        larger = larger | (F.col(a) < F.col(b))
    some = lambda c: F.count(F.when(c, 1))
    return met.agg(some(F.col("n").isNull()).alias("missing"), some(F.col("n") > 1).alias("repeated"), some(larger).alias("not_nested"))


def coverage(rows: DataFrame, by: list[str], known: Column, least: float = 0.9) -> DataFrame:
    """(by, covered_pct, enough): the share of rows for which ``known`` holds."""
    share = F.avg(known.cast("double"))
    return rows.groupBy(*by).agg(F.round(share * 100, 4).alias("covered_pct"), (share >= least).alias("enough"))


def differences(actual: DataFrame, golden: DataFrame, by: list[str], tolerance: float = 1e-3) -> DataFrame:
    """(by, actual, golden) where they differ by more than the tolerance, or only one of both is there."""
    met = actual.join(golden, by, "full")
    off = (F.abs(F.col("actual") - F.col("golden")) > tolerance) | F.col("actual").isNull() | F.col("golden").isNull()
    return met.filter(off).select(*by, "actual", "golden")


def unlike(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right): keys that only one of both has."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"))


def count_errors(rows: DataFrame, kind: str, known: DataFrame) -> DataFrame:
    """(kind, expected, found) where a kind has not the number of rows that ``known`` (kind, expected) states."""
    found = known.join(rows.groupBy(kind).agg(F.count("*").alias("found")), kind, "left")
    return found.select(kind, "expected", F.coalesce("found", F.lit(0)).alias("found")).filter("expected <> found")
