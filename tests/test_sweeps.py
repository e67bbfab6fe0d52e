"""Leave-one-out scans against the full lattice, and scans that stream."""

import random

import pytest

from waymark.operators import access, scan, scenarios, sweep

KINDS = {
    "rides": "seq long, dep long, arr long, from_stop string, to_stop string, route_id string, trip_id string", "walks": "zone_id long, stop_id string, walk_minutes double",
    "transfers": "from_stop string, to_stop string, walk_minutes double", "direct": "zone_id long, minutes double", "egress": "stop_id string, minutes double", "zones": "zone_id long, population double",
}


def city(seed: int, zones: int = 12, legs: int = 60, stops: str = "PQRSTUVW") -> dict:
    """A small day: trips of a few legs, walks, transfers; some zones walk to the same stops in the same time."""
    r = random.Random(seed)
    rides = []
    for trip in range(legs // 4):
        at, here = r.randrange(27000, 36000), r.choice(stops)
        for k in range(4):
            there = r.choice([s for s in stops if s != here])
            rides.append((trip * 10 + k, at, at + r.randrange(0, 900), here, there, f"r{trip % 5}", f"t{trip}"))
            at, here = rides[-1][2] + r.randrange(0, 120), there
    walks = [(z, s, float(r.randrange(1, 35))) for z in range(zones) for s in r.sample(stops, 2)]
    walks += [(zones + z, s, m) for z, s, m in walks if z % 3 == 0]
    return {
        "rides": rides, "walks": walks, "transfers": [(a, b, float(r.randrange(1, 18))) for a in stops for b in r.sample(stops, 2) if a != b],
        "direct": [(z, float(r.randrange(20, 90)) if z % 4 else None) for z in range(2 * zones)], "egress": [(s, float(r.randrange(0, 30))) for s in stops[::2]], "zones": [(z, float(10 + z)) for z in range(2 * zones)],
    }


def frames(spark, tables: dict) -> dict:
    return {k: spark.createDataFrame(v, KINDS[k]) for k, v in tables.items()}


def both(spark, df: dict, cases, starts):
    """Minutes of every scenario of the lattice, by full scans and from what changes; and both rankings."""
    cases, starts = spark.createDataFrame(list(cases), scenarios.CASE_SCHEMA), spark.createDataFrame([(x,) for x in starts], "start long")
    lattice = sweep.lattice(cases, starts, df["rides"])
    full = sweep.evaluated(lattice, **df)
    rows = sweep.settings(cases, starts)
    base, changed = sweep.withdrawn_each(rows, **df)
    told = {(r.scenario, r.zone_id): r.minutes for r in base.collect()}
    after = {(r.scenario, r.kind, r.id, r.zone_id): r.after for r in changed.collect()}
    want = {(r.case_id, r.start, r.kind, r.id, r.zone_id): r.minutes for r in full.join(lattice, "scenario").collect()}
    got = {k: after.get((f"{k[0]}|{k[1]}", *k[2:]), told[f"{k[0]}|{k[1]}", k[4]]) for k in want}
    impacts = lambda x: sorted(map(tuple, x.collect()), key=str)
    return want, got, impacts(sweep.ranked_impacts(lattice, full, df["zones"], df["rides"])), impacts(sweep.impacts_of_changes(rows, base, changed, df["zones"], df["rides"])), len(after)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_the_full_lattice(spark, seed):
    want, got, ranked, from_changes, changes = both(spark, frames(spark, city(seed, zones=6, legs=32)), scenarios.CASES[:: 3 if seed == 1 else 6], [28000])
    assert got == want and from_changes == ranked
    assert 0 < changes < len(want) / 3


def test_a_withdrawal_that_improves(spark):
    """Without leg A the transfer from Y to Z is made: Z is reached only then."""
    tables = {
        "rides": [(1, 60, 300, "P", "X", "ra", "A"), (2, 360, 720, "P", "Y", "rb", "B")], "walks": [(1, "P", 0.0)], "transfers": [("X", "Y", 4.0), ("Y", "Z", 4.0)],
        "direct": [(1, None)], "egress": [("Z", 0.0)], "zones": [(1, 5.0)],
    }
    df = frames(spark, tables)
    rows = sweep.settings(spark.createDataFrame([scenarios.STANDARD], scenarios.CASE_SCHEMA), spark.createDataFrame([(0,)], "start long"))
    base, changed = sweep.withdrawn_each(rows, **df)
    assert [r.minutes for r in base.collect()] == [None]
    assert {(r.kind, r.id, r.before, r.after) for r in changed.collect()} == {("trip", "A", None, 17.0), ("route", "ra", None, 17.0)}
    assert access.monotonic_violations(changed).count() == 2


def test_zones_without_walks_or_rides(spark):
    """A zone that reaches no stop keeps its direct walk; a day without rides changes nothing."""
    tables = city(5, zones=2, legs=4) | {"rides": [(1, 30000, 30300, "P", "Q", "r", "t")], "walks": [(0, "P", 3.0)]}
    df = frames(spark, tables)
    want, got, ranked, from_changes, _ = both(spark, df, scenarios.CASES[:1], [29000])
    assert got == want and ranked == from_changes
    none = df | {"rides": df["rides"].limit(0)}
    want, got, ranked, from_changes, changes = both(spark, none, scenarios.CASES[:1], [29000])
    assert got == want and ranked == from_changes == [] and changes == 0


def test_blocks_and_batches_do_not_matter(spark, monkeypatch):
    """Many blocks of few labels, and rides that come in batches of seven, give the same arrivals."""
    df = frames(spark, city(3, zones=40, legs=200))
    rows = sweep.settings(spark.createDataFrame(list(scenarios.CASES[:2]), scenarios.CASE_SCHEMA), spark.createDataFrame([(27000,)], "start long"))
    told = lambda: [sorted(map(tuple, x.collect()), key=str) for x in sweep.withdrawn_each(rows, **df)]
    want = told()
    monkeypatch.setattr(scan, "BLOCK_LABELS", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert told() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_day_streams(spark):
    """A day of 300,000 rides through one block; the labels equal a plain loop's."""
    n = 100_000
    legs = spark.range(n).selectExpr("'s' AS scenario", "id AS seq", "20000 + id div 10 AS dep", "20000 + id div 10 + 60 + id % 97 AS arr", "id * 7919 % 211 AS from_stop", "id * 104729 % 199 AS to_stop")
    near = spark.createDataFrame([("s", 20000, z, z * 3 % 211, float(z % 7)) for z in range(5)], "scenario string, start long, zone_id long, stop_id long, walk_minutes double")
    walks = spark.createDataFrame([(s, (s + 5) % 199, 2.0) for s in range(0, 199, 3)], "from_stop long, to_stop long, transfer_minutes double")
    got = {(r.zone_id, r.stop_id): r.seconds for r in access.earliest_arrivals(near, legs, walks).collect()}
    after = {s: (s + 5) % 199 for s in range(0, 199, 3)}
    want = {}
    for z in range(5):
        label = {z * 3 % 211: 20000 + z % 7 * 60}
        for k in sorted(range(n), key=lambda k: (20000 + k // 10, k % 97, k)):
            dep, a, b = 20000 + k // 10, k * 7919 % 211, k * 104729 % 199
            arr = dep + 60 + k % 97
            if label.get(a, 10**12) <= dep and arr < label.get(b, 10**12):
                label[b] = arr
                if b in after:
                    label[after[b]] = min(label.get(after[b], 10**12), arr + 120)
        want |= {(z, s): t for s, t in label.items()}
    assert got == want and len(want) > 900


def test_zones_alike_are_scanned_once(spark, monkeypatch):
    """Zones that walk to the same stops in the same time have one scan between them, and each its own row."""
    df = frames(spark, city(4, zones=6, legs=24))
    scanned, plain = [], scan.arrivals
    monkeypatch.setattr(scan, "arrivals", lambda near, *rest: scanned.append(near.select("zone_id").distinct().count()) or plain(near, *rest))
    cases, starts = spark.createDataFrame([scenarios.STANDARD], scenarios.CASE_SCHEMA), spark.createDataFrame([(28000,)], "start long")
    lattice = sweep.lattice(cases, starts, df["rides"]).filter("kind = 'baseline'")
    found = {r.zone_id: r.minutes for r in sweep.evaluated(lattice, **df).collect()}
    assert len(found) == 12 and scanned[0] <= 6
    base, _ = sweep.withdrawn_each(sweep.settings(cases, starts), **df)
    assert found == {r.zone_id: r.minutes for r in base.collect()}


def test_zones_are_not_sent_to_all_tasks(spark):
    """Sizes of derived tables are underestimated; a driver that collects all zones to send them runs out of memory."""
    zones, direct = spark.range(50).selectExpr("id AS zone_id", "1.0D AS population"), spark.range(50).selectExpr("id AS zone_id", "9.0D AS minutes")
    labels = spark.createDataFrame([("s", 3, "P", 60)], "scenario string, zone_id long, stop_id string, seconds long")
    found = access.best_minutes(zones, direct, labels, spark.createDataFrame([("P", 1.0)], "stop_id string, minutes double"), spark.createDataFrame([("s", 0)], "scenario string, start long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [zone_id" not in plan and "SortMergeJoin [zone_id" in plan
    assert {r.zone_id: r.minutes for r in found.collect()} == {z: 2.0 if z == 3 else 9.0 for z in range(50)}
