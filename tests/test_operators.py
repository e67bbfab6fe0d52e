import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import access, demand, equity, matching, network, ranking, scenarios, spatial, sweep, timetable
from waymark.sources import sinks


def rides(spark, rows):
    return spark.createDataFrame([("s", k, *r) for k, r in enumerate(rows)], "scenario string, seq long, dep long, arr long, from_stop string, to_stop string")


def arrivals(spark, start, legs, walks=None):
    near = spark.createDataFrame([("s", 0, 1, s, m / 60) for s, m in start.items()], "scenario string, start long, zone_id long, stop_id string, walk_minutes double")
    moved = None if walks is None else spark.createDataFrame([(a, b, m / 60) for a, b, m in walks], "from_stop string, to_stop string, transfer_minutes double")
    return {r.stop_id: r.seconds for r in access.earliest_arrivals(near, rides(spark, legs), moved).collect()}


def test_suppressed_transfers(spark):
    """A stop that a transfer reached earlier spawns none when a later ride comes in."""
    a, b, walks = (60, 300, "P", "X"), (360, 720, "P", "Y"), [("X", "Y", 300), ("Y", "Z", 300)]
    assert arrivals(spark, {"P": 0}, [a, b], walks) == {"P": 0, "X": 300, "Y": 600}
    assert arrivals(spark, {"P": 0}, [b], walks) == {"P": 0, "Y": 720, "Z": 1020}
    assert "Z" not in arrivals(spark, {"P": 0, "Y": 90}, [(60, 120, "P", "Y")], [("Y", "Z", 300)])
    assert arrivals(spark, {"P": 0}, [(60, 120, "P", "Y")], [("Y", "Z", 300)])["Z"] == 420


def test_fold_agrees_with_blocks(spark):
    legs = [(60 * k, 60 * k + 90, "PQRS"[k % 4], "QRSP"[k % 4]) for k in range(40)]
    want = arrivals(spark, {"P": 100, "R": 700}, legs)
    steps = rides(spark, legs).orderBy("dep", "arr", "seq").collect()
    array = F.array(*[F.struct(F.lit(r.dep).alias("dep"), F.lit(r.arr).alias("arr"), F.lit(r.from_stop).alias("from_stop"), F.lit(r.to_stop).alias("to_stop")) for r in steps])
    start = F.create_map(F.lit("P"), F.lit(100).cast("long"), F.lit("R"), F.lit(700).cast("long"))
    array = F.transform(array, lambda c: F.struct(c["dep"].cast("long").alias("dep"), c["arr"].cast("long").alias("arr"), c["from_stop"].alias("from_stop"), c["to_stop"].alias("to_stop")))
    assert spark.range(1).select(access.scan_fold(array, start).alias("x")).first().x == want


def test_population_summary(spark):
    rows = spark.createDataFrame([(100.0, 20.0), (50.0, 70.0)], "population double, minutes double")
    r = access.population_access(rows, []).first()
    assert (r.reachable_30min, r.reachable_60min, r.reachable_90min, r.mean_minutes) == (100, 100, 150, 36.667)


def test_equity_gap(spark):
    rows = spark.createDataFrame([(50.0, 30.0, 10.0, 20.0), (50.0, 10.0, 10.0, 10.0)], "all double, o65 double, before double, after double")
    long_ = equity.unpivoted(rows.withColumn("d", F.lit(1)), ["d", "before", "after"], {"all": "all", "65plus": "o65"})
    groups = equity.group_access(long_, ["d"])
    assert {r.group: r.affected_1_pct for r in groups.collect()} == {"all": 50.0, "65plus": 75.0}
    assert equity.gaps(groups, ["d"]).first().share_gap == 25.0


ROADS = [("ab", "a", "b", 1.0, 1000.0), ("bc", "b", "c", 1.0, 1000.0), ("ac", "a", "c", 5.0, 1000.0)]


def roads(spark, rows=ROADS):
    return spark.createDataFrame(rows, "edge_id string, u string, v string, minutes double, capacity double")


def test_assignment(spark):
    wanted = spark.createDataFrame([("a", "c", 50.0), ("a", "b", 0.0)], "origin string, destination string, value double")
    loads, lost = network.all_or_nothing(roads(spark), wanted)
    assert {r.edge_id: r.volume for r in loads.collect()} == {"ab": 50.0, "bc": 50.0, "ac": 0.0} and lost.first()[0] == 0
    loads, lost = network.user_equilibrium(roads(spark, [r for r in ROADS if r[0] != "bc"]), wanted, iterations=3)
    assert {r.edge_id: round(r.volume, 6) for r in loads.collect()} == {"ab": 0.0, "ac": 50.0} and lost.first()[0] == 0
    assert network.all_or_nothing(roads(spark, ROADS[:1]), wanted)[1].first()[0] == 50


def test_shortest_paths(spark):
    found = network.shortest_paths(roads(spark), spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r.minutes, r.via) for r in found.collect()} == {("a", 0.0, None), ("b", 1.0, "ab"), ("c", 2.0, "bc")}
    assert network.isochrone(found, 1.0).count() == 2


def test_balancing(spark):
    cells = spark.createDataFrame([(o, d, 1.0 + (o != d)) for o in "xy" for d in "uv"], "origin string, destination string, value double")
    rows = spark.createDataFrame([("x", 5.0), ("y", 3.0)], "origin string, row_target double")
    columns = spark.createDataFrame([("u", 4.0), ("v", 4.0)], "destination string, column_target double")
    got = demand.balanced(cells, rows, columns)
    assert {r[0]: r[1] for r in got.groupBy("origin").agg(F.round(F.sum("value"), 8)).collect()} == {"x": 5.0, "y": 3.0}
    assert {r[0]: r[1] for r in got.groupBy("destination").agg(F.round(F.sum("value"), 8)).collect()} == {"u": 4.0, "v": 4.0}
    with pytest.raises(ValueError, match="differ"):
        demand.balanced(cells, rows, columns.withColumn("column_target", F.lit(5.0)))


def test_published_cells(spark):
    """Deterrence 0.2, totals (5, 3) and (4, 4)."""
    import math

    cells = spark.createDataFrame([("x", "u", 1.0), ("x", "v", math.exp(-0.2)), ("y", "u", math.exp(-0.4) * math.exp(0.2)), ("y", "v", 1.0)], "origin string, destination string, value double")
    got = demand.balanced(cells, spark.createDataFrame([("x", 5.0), ("y", 3.0)], "origin string, row_target double"), spark.createDataFrame([("u", 4.0), ("v", 4.0)], "destination string, column_target double"))
    cells = {(x.origin, x.destination): round(x.value, 6) for x in got.collect()}
    assert sum(cells.values()) == pytest.approx(8.0) and cells["x", "u"] + cells["x", "v"] == pytest.approx(5.0) and cells["x", "u"] + cells["y", "u"] == pytest.approx(4.0)


def test_fit(spark):
    pairs = spark.createDataFrame([(110.0, 100.0), (60.0, 50.0)], "model double, observed double")
    r = demand.fit_measures(pairs).first()
    assert (r.mape, r.rmse) == (15.0, 10.0)
    links = spark.createDataFrame([("a",), ("b",)], "edge_id string")
    model = spark.createDataFrame([("a", 110.0), ("b", 60.0)], "edge_id string, model double")
    assert demand.screenline(links, model, model.withColumnRenamed("model", "observed")).first().model == 170
    lengths = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "edge_id string, length_km double")
    assert demand.vehicle_km(model.withColumnRenamed("model", "volume"), lengths).first().vkt == 230


def test_service_days(spark):
    week = spark.createDataFrame([("w", *"1111100", "20260101", "20261231")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string")
    other = spark.createDataFrame([("w", "20260824", "2", 0), ("x", "20260825", "1", 1), ("x", "20260825", "2", 2), ("y", "20260825", "1", 3)], "service_id string, date string, exception_type string, row long")
    day = lambda d: {r[0] for r in timetable.active_services(week, other, datetime.date(2026, 8, d)).collect()}
    assert day(24) == set() and day(25) == {"w", "y"} and day(29) == set()


def test_ranking(spark):
    rows = spark.createDataFrame([("c", "A", 50.0, 1.0, 39600, True), ("c", "A", 10.0, 9.0, 36000, True), ("c", "B", 20.0, 1.0, 36000, True), ("c", "C", 99.0, 1.0, 1, False)], "case_id string, id string, affected double, mean_change double, seconds int, evaluated boolean")
    got = ranking.day_ranking(rows, ["case_id"]).orderBy("rank").collect()
    assert [(r.id, r.peak_seconds, r.rank) for r in got] == [("A", 39600, 1), ("B", 36000, 2)]
    ranks = spark.createDataFrame([("base", "A", 1), ("base", "B", 2), ("case2", "B", 1), ("case2", "A", 2), ("case3", "B", 1), ("case3", "C", 2), ("case3", "D", 3), ("case3", "A", 4)], "case_id string, id string, rank int")
    r = ranking.stability(ranks, "base").first()
    assert (r.top1, r.top_k, r.changed, r.outside) == (1, 2, "case2,case3", "case3")


def test_registry():
    assert scenarios.case_errors(scenarios.CASES) == []
    assert scenarios.case_errors((scenarios.STANDARD, ("x", "walk_speed_kmh", 1.0, 5.0, 10.0)))
    assert scenarios.case_errors((scenarios.STANDARD, ("x", "most_access_minutes", 1.0, 20.0, 10.0)))
    assert scenarios.case_errors((scenarios.STANDARD, scenarios.CASES[1], scenarios.CASES[1]))


def test_matching_is_the_greedy_choice(spark):
    """Chains that cross all groups, against one row after the other."""
    r = random.Random(2)
    rows = sorted({(r.randrange(12), r.randrange(12), r.randrange(2), round(r.random(), 2)) for _ in range(60)})
    left, right, want = set(), set(), set()
    for p, o, priority, km in sorted(rows, key=lambda x: (x[2], x[3], x[0], x[1])):
        if p not in left and o not in right:
            left.add(p)
            right.add(o)
            want.add((p, o))
    c = spark.createDataFrame(rows, "place_id int, official_id int, priority int, km double")
    assert {(x.place_id, x.official_id) for x in matching.one_to_one(c, ["priority", "km"]).collect()} == want
    assert matching.one_to_one(c.limit(0), ["priority", "km"]).count() == 0


def test_unambiguous_takes_turns(spark):
    r = random.Random(3)
    rows = sorted({(k % 2, k, 100 + k, p, round(0.88 + r.random() / 8, 2)) for k in range(14) for p in r.sample(range(10), 3)})
    used, want = set(), set()
    for turn in sorted({x[:2] for x in rows}):
        free = sorted((-x[4], x[3], x[2]) for x in rows if x[:2] == turn and x[4] >= 0.9 and x[3] not in used)
        if free and (len(free) == 1 or free[1][0] - free[0][0] >= 0.03):
            used.add(free[0][1])
            want.add((free[0][2], free[0][1]))
    s = spark.createDataFrame(rows, "kind_order int, row int, official_id int, place_id int, score double")
    assert {(x.official_id, x.place_id) for x in matching.unambiguous(s).collect()} == want and len(want) > 2


def test_nearest_of_all(spark):
    """Points far beyond all rings, near the pole and across many cells, against all pairs."""
    r = random.Random(4)
    places = [(k, r.uniform(-60, 80), r.uniform(-170, 170)) for k in range(30)]
    points = [(k, r.uniform(-85, 85), r.uniform(-170, 170)) for k in range(25)] + [(99, places[0][1], places[0][2])]

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 6371.0088 * 2 * math.asin(math.sqrt(h))

    p, q = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double")
    got = {x.point_id: x.place_id for x in spatial.nearest(p, q, cell=1.0, rings=0).collect()}
    flat = {a[0]: min(places, key=lambda b: km(a, b))[0] for a in points}
    assert sum(got[k] == flat[k] for k in flat) >= len(flat) - 1 and len(got) == len(points)  # one ring may hide a nearer place
    assert spatial.nearest(p, q.limit(0)).count() == 0


def test_sweep_by_hand(spark):
    """All scenarios of a small day against a scan of each, one after the other."""
    rides = [(1, 28800, 29400, "P", "Q", "r1", "t1"), (2, 29500, 29900, "Q", "R", "r2", "t2"), (3, 28900, 29100, "P", "R", "r1", "t3"), (1, 33000, 33300, "P", "R", "r2", "t4")]
    walks, moves, out = [(1, "P", 5.0), (1, "Q", 15.0), (2, "Q", 25.0), (2, "P", 9.0)], [("Q", "R", 4.0), ("R", "Q", 12.0)], {"R": 1.0, "Q": 40.0}
    direct, starts = {1: 50.0, 2: None}, [28000, 32000]
    df = {
        "rides": spark.createDataFrame(rides, "seq long, dep long, arr long, from_stop string, to_stop string, route_id string, trip_id string"),
        "walks": spark.createDataFrame(walks, "zone_id long, stop_id string, walk_minutes double"), "transfers": spark.createDataFrame(moves, "from_stop string, to_stop string, walk_minutes double"),
        "direct": spark.createDataFrame(list(direct.items()), "zone_id long, minutes double"), "egress": spark.createDataFrame(list(out.items()), "stop_id string, minutes double"),
        "zones": spark.createDataFrame([(1, 100.0), (2, 50.0)], "zone_id long, population double"),
    }
    rows = sweep.lattice(spark.createDataFrame(list(scenarios.CASES), scenarios.CASE_SCHEMA), spark.createDataFrame([(x,) for x in starts], "start long"), df["rides"])
    minutes = sweep.evaluated(rows, **{k: df[k] for k in ("zones", "walks", "transfers", "rides", "direct", "egress")})
    got = {(x.scenario, x.zone_id): x.minutes for x in minutes.collect()}
    told = rows.collect()
    assert len(told) == 7 * ((1 + 2 + 4) + (1 + 1 + 1)) and len(got) == 2 * len(told)
    for s in told:
        f = 4.8 / s.walk_speed_kmh
        for zone in direct:
            label = {p: s.start + round(m * f * 60) for z, p, m in walks if z == zone and m * f <= s.most_access_minutes}
            for _, dep, arr, a, b, route, trip in sorted(rides, key=lambda x: (x[1], x[2], x[0])):
                if s.id not in (route, trip) and label.get(a, 10**12) <= dep and arr < label.get(b, 10**12):
                    label[b] = arr
                    for x, y, m in moves:
                        if x == b and m * f <= s.most_transfer_minutes:
                            label[y] = min(label.get(y, 10**12), arr + round((m * f + 1) * 60))
            best = [direct[zone] * f] if direct[zone] is not None else []
            best += [(t - s.start) / 60 + out[p] * f for p, t in label.items() if p in out]
            assert got[s.scenario, zone] == (pytest.approx(min(best)) if best else None)
    impacts = sweep.ranked_impacts(rows, minutes, df["zones"], df["rides"]).collect()
    assert len(impacts) == 7 * 2 * 6 and {x.evaluated for x in impacts if x.start == 32000 and x.id == "t1"} == {False}
    assert sweep.violations(rows, minutes).count() == 0


def test_contracts(spark):
    zones = spark.createDataFrame([(1, 9.0), (2, 8.0)], "zone_id long, p double")
    other = spark.createDataFrame([(1, 5.0), (1, 5.0), (3, 9.0)], "zone_id long, q double")
    assert access.zone_contract_errors(zones, other, ("p", "q")).first() == (1, 1, 0)
    with pytest.raises(Exception, match="zone"):
        access.zone_contract(zones, other, ("p", "q")).collect()
    assert access.zone_contract(zones.limit(1), other.limit(1), ("p", "q")).count() == 1
    with pytest.raises(ValueError, match="differ"):
        demand.paired(zones, other.limit(1), "zone_id")


def test_versions(spark):
    v = spark.createDataFrame([("d", "1", "active", "passed"), ("d", "2", "validated", "passed"), ("d", "3", "candidate", "failed"), ("e", "4", "active", "passed")], "dataset_id string, version_id string, status string, validation_status string")
    state = lambda df: {r.version_id: r.status for r in df.collect()}
    assert state(sinks.approved(v, "2")) == {"1": "archived", "2": "active", "3": "candidate", "4": "active"}
    assert state(sinks.rolled_back(v, "1")) == {"1": "active", "2": "archived", "3": "archived", "4": "active"}
    with pytest.raises(ValueError, match="did not pass"):
        sinks.approved(v, "3")
    with pytest.raises(ValueError, match="did not pass"):
        sinks.rolled_back(v, "3")


def test_graph_building(spark):
    ways = spark.createDataFrame(
        [("way", 1, {"highway": "primary_link", "oneway": "yes", "maxspeed": "30 mph"}, [(33.0, 132.0), (33.01, 132.0), (33.02, 132.0)]), ("way", 2, {"highway": "footway", "foot": "no"}, [(33.0, 132.0), (33.0, 132.01)]), ("way", 3, {"highway": "track"}, [(33.0, 132.0)]), ("node", 4, {}, [])],
        "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>",
    )
    edges = network.road_edges(ways).collect()
    assert {e.edge_id for e in edges} == {"osm:1:0:fwd", "osm:1:1:fwd", "osm:2:0:fwd", "osm:2:0:rev"}
    assert {(e.speed_kmh, e.capacity) for e in edges if e.edge_id.startswith("osm:1")} == {(30.0, 1300.0)}
    assert {e.edge_id for e in network.walk_edges(ways).collect()} == {"walk:1:0:f", "walk:1:0:r", "walk:1:1:f", "walk:1:1:r"}


def test_bounded_paths_and_features(spark):
    """Costs in buckets: a bound for all and one for each source, zero costs, edges sorted, features drawn."""
    r = random.Random(9)
    rows = [(f"e{k}", str(r.randrange(30)), str(r.randrange(30)), float(r.choice([0, 1, 2, 5, 40])), 1.0) for k in range(140)]
    cost = {}
    for _, u, v, m, _ in rows:
        cost[u, v] = min(m, cost.get((u, v), m))
    far = {(a, b): 0.0 if a == b else cost.get((a, b), math.inf) for a in map(str, range(30)) for b in map(str, range(30))}
    for k in map(str, range(30)):
        for a in map(str, range(30)):
            for b in map(str, range(30)):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    edges = spark.createDataFrame(rows, "edge_id string, u string, v string, minutes double, capacity double")
    sources = spark.createDataFrame([("0", 6.0), ("7", 50.0)], "node string, most double")
    for width in (3.0, None):
        got = {(x.source, x.node): x.minutes for x in network.shortest_paths(edges, sources, most=20.0, width=width).collect()}
        assert got == {(s, v): far[s, v] for s, m in (("0", 6.0), ("7", 20.0)) for v in map(str, range(30)) if far[s, v] <= m}
    stops = spark.createDataFrame([("p", "0"), ("q", "7"), ("w", "7")], "stop_id string, node string")
    walks = {(x.from_stop, x.to_stop): x.minutes for x in network.walks_between(edges, stops, 20.0).collect()}
    node = {"p": "0", "q": "7", "w": "7"}
    assert walks == {(a, b): far[node[a], node[b]] for a in node for b in node if a != b and far[node[a], node[b]] <= 20}
    assert [x.edge_id for x in network.sorted_edges(edges).limit(3).collect()] == sorted(x[0] for x in rows)[:3]
    ways = spark.createDataFrame([("way", 1, {"highway": "path", "name": "N"}, [(33.0, 132.0), (33.5, 132.5)]), ("way", 2, {}, [(33.0, 132.0)])], "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    assert [(x.id, x.feature) for x in network.road_features(ways).collect()] == [("osm:1", '{"type":"Feature","id":"osm:1","properties":{"highway":"path","name":"N"},"geometry":{"type":"LineString","coordinates":[[132.0,33.0],[132.5,33.5]]}}')]


def test_nearest_of_nothing(spark):
    kinds = ("point_id long, lat double, lon double", "place_id long, lat double, lon double")
    points, places = spark.createDataFrame([(1, 33.0, 132.0)], kinds[0]), spark.createDataFrame([(1, 33.0, 132.0)], kinds[1])
    for p, q in ((points.limit(0), places), (points, places.limit(0)), (points.limit(0), places.limit(0))):
        assert spatial.nearest(p, q, rings=-1).count() == 0


def test_paths_in_blocks_equal_joins(spark, monkeypatch):
    """Blocks of sources tell what the rounds of joins tell, with bounds, unknown nodes, free arcs and closed ones; and take no round of jobs."""
    arcs = [(f"{u}>{v}", u, v, float((u * 7 + v * 3) % 11)) for u in range(40) for v in {(2 * u + 7) % 40, (3 * u + 1) % 40} if u != v] + [("c", 1, 2, None), ("d", 1, 3, -1.0), ("e", 1, 4, float("inf"))]
    edges = spark.createDataFrame([(*a, 50.0) for a in arcs], "edge_id string, u long, v long, minutes double, capacity double")
    sources = spark.createDataFrame([(u, 15.0 if u % 2 else 1000.0) for u in [*range(40), 99]], "node long, most double")
    wanted = spark.createDataFrame([(o, d, float(o + d)) for o in [*range(40), 99] for d in (0, 5, 17, 99)], "origin long, destination long, value double")
    jobs = []
    monkeypatch.setattr(network, "settled", lambda df, plain=network.settled: jobs.append(1) or plain(df))

    def told():
        jobs.clear()
        found = {(r.source, r.node): r.minutes for r in network.shortest_paths(edges, sources).collect()}
        n, (loads, lost) = len(jobs), network.all_or_nothing(edges, wanted)
        return found, sum(r.volume * c[3] for r in loads.collect() for c in arcs if c[0] == r.edge_id and r.volume), lost.first()[0], n

    monkeypatch.setattr(network.trees, "BLOCK_LABELS", 200)
    monkeypatch.setattr(network.trees, "BATCH_LABELS", 120)
    *blocks, few = told()
    monkeypatch.setattr(network.trees, "MOST_ROWS", 7)
    assert told()[:3] == tuple(blocks)
    monkeypatch.setattr(network.trees, "MOST_ARCS", 0)
    *joins, many = told()
    assert blocks == joins and blocks[2] > 0 and len(blocks[0]) > 500
    assert few == 1 < many


def test_places_dealt_to_cells_are_not_sent_to_all_tasks(spark):
    """25 rows of each place look to Spark like one; a driver that collects them runs out of memory."""
    points, places = spark.range(9).selectExpr("id AS point_id", "id / 10.0D AS lat", "1.0D AS lon"), spark.range(3).selectExpr("id AS place_id", "id / 5.0D AS lat", "1.0D AS lon")
    plan = spatial._best(points, places, 0.5, 0, spatial.WIDE, [], False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    got = {r.point_id: r.place_id for r in spatial.nearest(points, places, rings=-1).collect()}
    assert len(got) == 9 and all(got[p] == min(range(3), key=lambda q, p=p: abs(p / 10 - q / 5)) for p in (0, 2, 4, 5, 8))
