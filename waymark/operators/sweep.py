"""Sweeps: cases of walking, departure times, and withdrawn routes or trips as the rows of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rescaled_walk
from . import access, ranking
from .tables import sent_if_small, settled

BUFFER_MINUTES = 1.0


def _services(rides: DataFrame, *keep: str) -> DataFrame:
    """(kind, id, keep) of each ride's route and trip."""
    both = F.array(F.struct(F.lit("route").alias("kind"), F.col("route_id").alias("id")), F.struct(F.lit("trip").alias("kind"), F.col("trip_id").alias("id")))
    return rides.select(*keep, F.explode(both).alias("x")).select("x.kind", "x.id", *keep)


def remaining(rides: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, kind, id): the routes and trips that still have a ride to board at each start."""
    last = rides.groupBy("route_id", "trip_id").agg(F.max("dep").alias("dep"))
    last = _services(last, "dep").groupBy("kind", "id").agg(F.max("dep").alias("dep"))
    return last.join(starts, F.col("dep") >= F.col("start")).select("start", "kind", "id")


def skipped(rides: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, kind, id, evaluated) of every service at every start: whether it still has a ride to board."""
    every = starts.select("start").distinct().crossJoin(_services(rides).distinct())
    still = remaining(rides, starts.select("start").distinct()).withColumn("still", F.lit(True))
    return every.join(still, ["start", "kind", "id"], "left").select("start", "kind", "id", F.coalesce("still", F.lit(False)).alias("evaluated"))


def lattice(cases: DataFrame, starts: DataFrame, rides: DataFrame) -> DataFrame:
    """(scenario, case_id, walk_speed_kmh, most_access_minutes, most_transfer_minutes, start, kind, id): every case at every start, as it is and without each service that still runs.

    Cases, starts and services of a day are short, stated lists; their product is the list of scenarios.
    """
    out = remaining(rides, starts).unionByName(starts.select("start", F.lit("baseline").alias("kind"), F.lit("").alias("id")))
    met = cases.drop("changed").crossJoin(out)
    return met.withColumn("scenario", F.concat_ws("|", "case_id", "start", "kind", "id"))


def _walked(scenarios: DataFrame, walks: DataFrame, transfers: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Walks to stops and between stops of each scenario, at its speed and within its limits."""
    speed = F.col("walk_speed_kmh")
    near = walks.crossJoin(scenarios.select("scenario", "start", "walk_speed_kmh", "most_access_minutes")).withColumn("walk_minutes", rescaled_walk(F.col("walk_minutes"), speed))
    near = near.filter(F.col("walk_minutes") <= F.col("most_access_minutes"))
    if transfers is None:
        return near, None
    changes = transfers.crossJoin(scenarios.select("scenario", "walk_speed_kmh", "most_transfer_minutes")).withColumn("walk_minutes", rescaled_walk(F.col("walk_minutes"), speed))
    return near, changes.filter(F.col("walk_minutes") <= F.col("most_transfer_minutes")).withColumn("transfer_minutes", F.col("walk_minutes") + BUFFER_MINUTES)


def evaluated(scenarios: DataFrame, zones: DataFrame, walks: DataFrame, transfers: DataFrame | None, rides: DataFrame, direct: DataFrame, egress: DataFrame) -> DataFrame:
    """(scenario, zone_id, minutes) of all scenarios of a :func:`lattice`, each scanned on its own.

    ``walks``: zone_id, stop_id, walk_minutes; ``transfers``: from_stop,
    to_stop, walk_minutes, both at the standard speed; ``rides``: seq, dep, arr,
    from_stop, to_stop, route_id, trip_id; ``direct`` and ``egress`` as
    :func:`access.best_minutes` takes them.  Zones that are :func:`alike` are
    scanned once.
    """
    scenarios, profiles = settled(scenarios), settled(alike(walks))
    near, changes = _walked(scenarios, walks.join(profiles.select(F.col("profile").alias("zone_id")).distinct(), "zone_id", "left_semi"), transfers)
    gone = ((F.col("kind") == "route") & (F.col("id") == F.col("route_id"))) | ((F.col("kind") == "trip") & (F.col("id") == F.col("trip_id")))
    told = scenarios.select("scenario", "start", "kind", "id", *(["day"] if "day" in scenarios.columns else []))
    own = (rides.join(told, "day") if "day" in scenarios.columns else rides.crossJoin(told)).filter(~gone & (F.col("dep") >= F.col("start")))
    labels = access.earliest_arrivals(near, own, changes, most_walk=float("inf"))
    return access.best_minutes(zones, direct, labels, egress, scenarios.select("scenario", "start", F.col("walk_speed_kmh").alias("speed_kmh")), profiles)


def settings(cases: DataFrame, starts: DataFrame) -> DataFrame:
    """(scenario, case_id, start, walk_speed_kmh, most_access_minutes, most_transfer_minutes): every case at every start."""
    return cases.drop("changed").crossJoin(starts).withColumn("scenario", F.concat_ws("|", "case_id", "start"))


def alike(walks: DataFrame) -> DataFrame:
    """(zone_id, profile): zones that can walk to the same stops in the same time have one scan; the profile is the least of them."""
    list_ = F.to_json(F.sort_array(F.collect_list(F.struct("stop_id", "walk_minutes"))))
    own = settled(walks.groupBy("zone_id").agg(F.sha2(list_, 256).alias("list")))
    first = sent_if_small(settled(own.groupBy("list").agg(F.min("zone_id").alias("profile"))))
    return own.join(first, "list").select("zone_id", "profile")


def withdrawn_each(settings: DataFrame, zones: DataFrame, walks: DataFrame, transfers: DataFrame | None, rides: DataFrame, direct: DataFrame, egress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What :func:`evaluated` tells of a whole :func:`lattice`, as two tables: all settings as they are, and what each withdrawal changes.

    The first: scenario, zone_id, minutes of every zone; the second: scenario,
    kind, id, zone_id, before, after, only where they differ.  All other
    services and zones keep what they had.  Arguments as for ``evaluated``, with
    ``settings`` in place of scenarios; one destination.
    """
    profiles = settled(alike(walks))
    near, changes = _walked(settings, walks.join(profiles.select(F.col("profile").alias("zone_id")).distinct(), "zone_id", "left_semi"), transfers)
    own = rides.crossJoin(settings.select("scenario", "start")).filter(F.col("dep") >= F.col("start"))
    speed = F.col("walk_speed_kmh")
    leave = egress.crossJoin(settings.select("scenario", "walk_speed_kmh")).select("scenario", "stop_id", F.lit(None).cast("int").alias("destination"), rescaled_walk(F.col("minutes"), speed).alias("minutes"))
    found = settled(access.leave_one_out(near, own, changes, leave)).withColumnRenamed("zone_id", "profile")
    every = zones.select("zone_id").crossJoin(settings.select("scenario", "walk_speed_kmh")).join(direct, "zone_id", "left").join(profiles, "zone_id", "left")
    every = every.withColumn("walk", rescaled_walk(F.col("minutes"), speed)).select("scenario", "zone_id", "profile", "walk")
    base = every.join(found.filter("kind = 'baseline'").select("scenario", "profile", "ride"), ["scenario", "profile"], "left").withColumn("minutes", F.least("walk", "ride"))
    base = settled(base.select("scenario", "zone_id", "profile", "walk", "minutes"))
    changed = base.join(found.filter("kind <> 'baseline'").select("scenario", "profile", "kind", "id", "ride"), ["scenario", "profile"])
    changed = changed.select("scenario", "kind", "id", "zone_id", F.col("minutes").alias("before"), F.least("walk", "ride").alias("after")).filter("not (before <=> after)")
    return base.select("scenario", "zone_id", "minutes"), changed


def impacts_of_changes(settings: DataFrame, base: DataFrame, changed: DataFrame, zones: DataFrame, rides: DataFrame) -> DataFrame:
    """:func:`ranked_impacts` from the two tables of :func:`withdrawn_each`: sums over all zones once a setting, and over changed zones for each withdrawal."""
    p, people = F.col("population"), zones.select("zone_id", "population")
    within = lambda c, t: F.coalesce(F.when(F.col(c) <= t, p), F.lit(0.0))
    known = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), p), F.lit(0.0))
    spent = lambda c: F.coalesce(p * F.col(c), F.lit(0.0))
    total = base.join(people, "zone_id").groupBy("scenario").agg(*[F.sum(within("minutes", t)).alias(f"within_{t}") for t in (30, 60)], F.sum(known("minutes")).alias("known"), F.sum(spent("minutes")).alias("spent"))
    delta = F.col("after") - F.col("before")
    sums = [F.sum(F.when(delta > m, p).otherwise(0.0)).alias(f"affected_{m}") for m in (1, 5, 10)]
    sums += [F.sum(within("after", t) - within("before", t)).alias(f"more_{t}") for t in (30, 60)]
    sums += [F.sum(known("after") - known("before")).alias("more_known"), F.sum(spent("after") - spent("before")).alias("more_spent")]
    met = changed.join(people, "zone_id").groupBy("scenario", "kind", "id").agg(*sums)
    names = [c for c in met.columns if c not in ("scenario", "kind", "id")]
    every = settings.select("scenario", "case_id", "start").join(skipped(rides, settings.select("start").distinct()), "start")
    every = every.join(total, "scenario").join(met, ["scenario", "kind", "id"], "left").select("case_id", "start", "kind", "id", "evaluated", "within_30", "within_60", "known", "spent", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    lost = lambda t: F.round(F.round(f"within_{t}", 4) - F.round(F.col(f"within_{t}") + F.col(f"more_{t}"), 4), 4).alias(f"loss_{t}")
    mean = F.round(F.round(F.try_divide(F.col("spent") + F.col("more_spent"), F.col("known") + F.col("more_known")), 3) - F.round(F.try_divide("spent", "known"), 3), 3)
    told = every.select("case_id", "start", "kind", "id", "evaluated", *[F.round(f"affected_{m}", 4).alias(f"affected_{m}") for m in (1, 5, 10)], lost(30), lost(60), F.coalesce(mean, F.lit(0.0)).alias("mean_change"))
    return ranking.ranked(told.withColumn("affected", F.col("affected_1")), ["case_id", "start", "kind"]).drop("affected")


def ranked_impacts(scenarios: DataFrame, minutes: DataFrame, zones: DataFrame, rides: DataFrame) -> DataFrame:
    """(case_id, start, kind, id, evaluated, impact columns, rank): what each withdrawal does; services that no longer run do nothing and are not evaluated."""
    told = minutes.join(scenarios.select("scenario", "case_id", "start", "kind", "id"), "scenario").join(zones.select("zone_id", "population"), "zone_id")
    base = told.filter("kind = 'baseline'").select("case_id", "start", "zone_id", F.col("minutes").alias("before"))
    pairs = told.filter("kind <> 'baseline'").withColumnRenamed("minutes", "after").join(base, ["case_id", "start", "zone_id"])
    impacts = access.impact(pairs, ["case_id", "start", "kind", "id"])
    every = scenarios.select("case_id").distinct().crossJoin(skipped(rides, scenarios.select("start").distinct()))
    measures = [c for c in impacts.columns if c not in ("case_id", "start", "kind", "id")]
    met = every.join(impacts, ["case_id", "start", "kind", "id"], "left")
    filled = met.select("case_id", "start", "kind", "id", "evaluated", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in measures])
    return ranking.ranked(filled.withColumn("affected", F.col("affected_1")), ["case_id", "start", "kind"]).drop("affected")


def violations(scenarios: DataFrame, minutes: DataFrame) -> DataFrame:
    """(scenario, zone_id, before, after) where a withdrawal would be an improvement; there must be none."""
    told = minutes.join(scenarios.select("scenario", "case_id", "start", "kind"), "scenario")
    base = told.filter("kind = 'baseline'").select("case_id", "start", "zone_id", F.col("minutes").alias("before"))
    pairs = told.filter("kind <> 'baseline'").withColumnRenamed("minutes", "after").join(base.hint("merge"), ["case_id", "start", "zone_id"])
    return access.monotonic_violations(pairs).select("scenario", "zone_id", "before", "after")
