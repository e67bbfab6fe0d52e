"""One query for each operator over the driver's tables, and its SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import access, demand, equity, matching, network, ranking, scenarios, spatial, sweep, timetable
from ..operators.tables import new_folder
from ..sources import feeds, sinks
from . import inputs as I
from .inputs import FACILITIES, PAIRS, RIDES, SLOTS, ZONES, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# -- scalar functions ---------------------------------------------------------


@query("f1_gtfs_time", """SELECT o_orderkey, (o_orderkey % 30 * 3600 + o_orderkey % 60 * 60 + o_custkey % 60)::INT AS seconds,
  lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS label FROM orders""")
def f1(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws(":", two(F.col("o_orderkey") % 30), two(F.col("o_orderkey") % 60), two(F.col("o_custkey") % 60)).alias("t"))
    s = o.withColumn("seconds", S.gtfs_seconds(F.col("t")))
    return s.select("o_orderkey", "seconds", S.time_label(F.col("seconds")).alias("label"))


@query("f3_haversine", f"""WITH {ZONES}, {FACILITIES} SELECT DISTINCT zone_id, place_id,
  round(6371.0088::DOUBLE * 2 * asin(sqrt(pow(sin(radians(f.lat - z.lat) / 2), 2) + cos(radians(z.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - z.lon) / 2), 2))), 6) AS km
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN zones z ON o_custkey = zone_id JOIN facilities f ON l_suppkey = place_id""")
def f3(spark, d):
    z, f = I.zones(spark, d).alias("z"), I.facilities(spark, d).alias("f")
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("zone_id"), F.col("l_suppkey").alias("place_id")).distinct()
    met = bought.join(z, "zone_id").join(f, "place_id")
    return met.select("zone_id", "place_id", F.round(S.haversine_km(F.col("z.lat"), F.col("z.lon"), F.col("f.lat"), F.col("f.lon")), 6).alias("km"))


@query("f4_mesh_centre", f"WITH {ZONES} SELECT zone_id, mesh, round(lat, 9) AS lat, round(lon, 9) AS lon FROM zones")
def f4(spark, d):
    return I.zones(spark, d).select("zone_id", "mesh", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("f5_node_key", f"WITH {ZONES} SELECT zone_id, printf('n:%.7f:%.7f', lat, lon) AS node FROM zones")
def f5(spark, d):
    return I.zones(spark, d).select("zone_id", S.node_key(F.col("lat"), F.col("lon")).alias("node"))


@query("f6_first_number", """SELECT event_id, coalesce(nullif(regexp_extract(props, '\\d+(?:\\.\\d+)?'), '')::DOUBLE, -1) AS found,
  coalesce(try_cast(replace(trim(event_type), ',', '') AS DOUBLE), 0) AS tolerant FROM events""")
def f6(spark, d):
    return table(spark, d, "events").select("event_id", S.first_number(F.col("props"), -1).alias("found"), S.tolerant_number(F.col("event_type")).alias("tolerant"))


@query("f17_bpr", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linenumber % 5 > 0 THEN (1 + sqrt(l_extendedprice)) * (1 + 0.15::DOUBLE * pow(l_quantity / (l_linenumber % 5 * 10), 4))
  WHEN l_quantity > 0 THEN -1 ELSE (1 + sqrt(l_extendedprice)) END, 5) AS minutes FROM lineitem""")
def f17(spark, d):
    m = S.bpr_minutes(1 + F.sqrt("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber") % 5 * 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.when(m == float("inf"), -1.0).otherwise(m), 5).alias("minutes"))


@query("f18_free_flow", "SELECT p_partkey, round(p_retailprice / p_size * 60, 6) AS minutes FROM part WHERE p_size > 0")
def f18(spark, d):
    return table(spark, d, "part").filter("p_size > 0").select("p_partkey", F.round(S.free_flow_minutes(F.col("p_retailprice"), F.col("p_size")), 6).alias("minutes"))


_LINKS = "links AS (SELECT 'e' || (l_partkey % 500)::VARCHAR AS edge_id, sum(l_quantity) AS model, sum(l_quantity * (1 + (l_suppkey % 7)::DOUBLE / 20 - 0.15::DOUBLE)) AS observed, min(l_partkey) * 0.01::DOUBLE AS length_km FROM lineitem GROUP BY 1)"


def _links(spark, d):
    li = table(spark, d, "lineitem")
    own = F.col("l_quantity") * (1 + (F.col("l_suppkey") % 7).cast("double") / 20 - 0.15)
    return li.groupBy(F.concat(F.lit("e"), F.col("l_partkey") % 500).alias("edge_id")).agg(F.sum("l_quantity").alias("model"), F.sum(own).alias("observed"), (F.min("l_partkey") * 0.01).alias("length_km"))


@query("f19_geh", f"WITH {_LINKS} SELECT edge_id, round(sqrt(2 * pow(model - observed, 2) / (model + observed)), 4) AS geh FROM links")
def f19(spark, d):
    return _links(spark, d).select("edge_id", F.round(S.geh(F.col("model"), F.col("observed")), 4).alias("geh"))


@query("f20_deterrence", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0 ELSE round(exp(-0.2::DOUBLE * p_size), 9) END AS seed FROM part")
def f20(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.deterrence(F.col("p_size").cast("double"), 0.2, F.col("p_size") % 10 == 0), 9).alias("seed"))


@query("f21_hash_bucket", """WITH k AS (SELECT p_partkey, p_name || ':' || p_partkey::VARCHAR AS key FROM part),
  b AS (SELECT p_partkey, key, list_transform(range(0, length(key)), lambda i: (ascii(substr(key, i + 1, 1)) * CASE WHEN i = 0 THEN 1 ELSE [56, 36, 16, 96, 76][(i - 1) % 5 + 1] END)::BIGINT) AS v FROM k)
  SELECT p_partkey, (list_sum(v) % 100)::INT AS bucket, (list_sum(v) % 100) < 20 AS holdout FROM b""")
def f21(spark, d):
    b = table(spark, d, "part").select("p_partkey", S.hash_bucket(F.concat_ws(":", "p_name", F.col("p_partkey").cast("string"))).alias("bucket"))
    return b.select("p_partkey", "bucket", (F.col("bucket") < 20).alias("holdout"))


@query("f22_direction", """SELECT event_id, CASE WHEN v > 0.0005 THEN 'positive' WHEN v < -0.0005 THEN 'negative' WHEN v IS NULL THEN 'unknown' ELSE 'neutral' END AS direction
  FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN (event_id % 5 - 2)::DOUBLE / 2500 END AS v FROM events)""")
def f22(spark, d):
    v = F.when(F.col("event_id") % 11 > 0, (F.col("event_id") % 5 - 2).cast("double") / 2500)
    return table(spark, d, "events").select("event_id", S.direction(v).alias("direction"))


@query("f23_walk_rescale", f"WITH {PAIRS} SELECT zone_id, speed, round(before * 4.8::DOUBLE / speed, 6) AS minutes FROM pairs, (VALUES (1.8::DOUBLE), (2.4), (4.8), (6.0)) s(speed)")
def f23(spark, d):
    speeds = F.explode(F.array(*[F.lit(x) for x in (1.8, 2.4, 4.8, 6.0)]))
    return I.pairs(spark, d).select("zone_id", "before", speeds.alias("speed")).select("zone_id", "speed", F.round(S.rescaled_walk(F.col("before"), F.col("speed")), 6).alias("minutes"))


@query("f28_bands", f"""WITH {PAIRS} SELECT zone_id, CASE WHEN before IS NULL THEN 'unreachable' WHEN before <= 30 THEN '30' WHEN before <= 60 THEN '60' WHEN before <= 90 THEN '90' ELSE 'over' END AS band,
  CASE WHEN after - before > 10 THEN '10' WHEN after - before > 5 THEN '5' WHEN after - before > 1 THEN '1' WHEN after - before > 0 THEN '0' ELSE 'none' END AS increase, round(before, 2) AS shown FROM pairs""")
def f28(spark, d):
    return I.pairs(spark, d).select("zone_id", S.minutes_band(F.col("before")).alias("band"), S.increase_band(F.col("after") - F.col("before")).alias("increase"), S.shown_minutes(F.col("before")).alias("shown"))


# -- timetable ------------------------------------------------------------------

_DAY = datetime.date(1998, 10, 3)


def _calendar(spark, d):
    c = table(spark, d, "customer")
    flags = [(F.floor(F.col("c_custkey") / (1 << i)) % 2).cast("string").alias(w) for i, w in enumerate(timetable.WEEKDAYS)]
    return c.select(F.concat(F.lit("s"), F.col("c_custkey")).alias("service_id"), *flags, F.lit("19980101").alias("start_date"), F.when(F.col("c_custkey") % 3 == 0, "19980601").otherwise("19991231").alias("end_date"))


def _exceptions(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("s"), F.col("o_custkey")).alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), (F.col("o_orderkey") % 2 + 1).cast("string").alias("exception_type"), F.col("o_orderkey").alias("row"))


@query("u1_active_services", """WITH weekly AS (SELECT 's' || c_custkey::VARCHAR AS service_id FROM customer WHERE c_custkey // 32 % 2 = 1 AND c_custkey % 3 <> 0),
  last AS (SELECT 's' || o_custkey::VARCHAR AS service_id, arg_max(o_orderkey % 2 + 1, o_orderkey) AS kind FROM orders WHERE o_orderdate::DATE = DATE '1998-10-03' GROUP BY 1)
  (SELECT service_id FROM weekly UNION SELECT service_id FROM last WHERE kind = 1) EXCEPT SELECT service_id FROM last WHERE kind = 2""")
def u1(spark, d):
    return timetable.active_services(_calendar(spark, d), _exceptions(spark, d), _DAY)


@query("j1_active_stop_times", """SELECT trip_id, stop_id, seq FROM (SELECT user_id, user_id::VARCHAR || ':' || (ts::DATE)::VARCHAR AS trip_id, event_id % 20 AS stop_id,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INT AS seq FROM events) WHERE 's' || user_id::VARCHAR IN (SELECT 's' || c_custkey::VARCHAR FROM customer WHERE c_custkey // 32 % 2 = 1)""")
def j1(spark, d):
    active = _calendar(spark, d).filter("saturday = '1'").select("service_id")
    times = I.stop_times(spark, d).withColumn("service_id", F.concat(F.lit("s"), F.col("user_id")))
    return times.join(active, "service_id", "left_semi").select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("seq"))


@query("j3_connections", f"WITH {RIDES} SELECT trip_id, route_id, seq, from_stop, dep, to_stop, arr FROM rides")
def j3(spark, d):
    return timetable.connections(I.stop_times(spark, d), I.trips(spark, d))


@query("j5_without_route", f"WITH {RIDES} SELECT route_id, count(*) AS rides, min(dep) AS first_departure, count(DISTINCT trip_id) AS trips FROM rides WHERE route_id <> 'r2' GROUP BY 1")
def j5(spark, d):
    c = timetable.connections(I.stop_times(spark, d), I.trips(spark, d))
    out = spark.createDataFrame([("r2",)], "route_id string")
    return c.join(F.broadcast(out), "route_id", "left_anti").groupBy("route_id").agg(F.count("*").alias("rides"), F.min("dep").alias("first_departure"), F.countDistinct("trip_id").alias("trips"))


@query("w7_first_departures", f"WITH {RIDES} SELECT trip_id, route_id, min(dep) AS first_departure, max(arr) AS last_arrival, count(*) AS legs FROM rides GROUP BY ALL")
def w7(spark, d):
    return timetable.connections(I.stop_times(spark, d), I.trips(spark, d)).groupBy("trip_id", "route_id").agg(F.min("dep").alias("first_departure"), F.max("arr").alias("last_arrival"), F.count("*").alias("legs"))


@query("a20_remaining_candidates", f"WITH {RIDES} SELECT slot, count(DISTINCT route_id) AS routes, count(DISTINCT trip_id) AS trips FROM rides, (SELECT unnest(range(21600, 79200, 3600)) AS slot) s WHERE dep >= slot GROUP BY slot")
def a20(spark, d):
    c = timetable.connections(I.stop_times(spark, d), I.trips(spark, d))
    slots = F.explode(F.sequence(F.lit(21600), F.lit(75600), F.lit(3600))).alias("slot")
    last = c.groupBy("route_id", "trip_id").agg(F.max("dep").alias("dep")).select("route_id", "trip_id", "dep", slots).filter("dep >= slot")
    return last.groupBy(F.col("slot").cast("long").alias("slot")).agg(F.countDistinct("route_id").alias("routes"), F.countDistinct("trip_id").alias("trips"))


@query("q1_feed_errors", """WITH t AS (SELECT user_id::VARCHAR AS trip_id, 'r' || (user_id % 7)::VARCHAR AS route_id FROM events GROUP BY ALL)
  SELECT 'trip without route: ' || trip_id AS error FROM t WHERE route_id NOT IN (SELECT 'r' || n_nationkey::VARCHAR FROM nation WHERE n_nationkey < 5)
  UNION SELECT 'stop time without stop: ' || (event_id % 30)::VARCHAR FROM events WHERE event_id % 30 >= 25
  UNION SELECT 'stop out of range: ' || n_nationkey::VARCHAR FROM nation WHERE n_nationkey * 5 > 90
  UNION SELECT 'repeated stop time: ' || user_id::VARCHAR || '/' || (event_id % 50)::VARCHAR FROM events GROUP BY user_id, event_id % 50 HAVING count(*) > 1""")
def q1(spark, d):
    e, n = table(spark, d, "events"), table(spark, d, "nation")
    stops = n.select(F.col("n_nationkey").cast("string").alias("stop_id"), (F.col("n_nationkey") * 5).cast("string").alias("stop_lat"), F.lit("132.5").alias("stop_lon"))
    routes = n.filter("n_nationkey < 5").select(F.concat(F.lit("r"), "n_nationkey").alias("route_id"))
    trips = e.select(F.col("user_id").cast("string").alias("trip_id"), F.concat(F.lit("r"), F.col("user_id") % 7).alias("route_id")).distinct()
    times = e.select(F.col("user_id").cast("string").alias("trip_id"), (F.col("event_id") % 30).cast("string").alias("stop_id"), (F.col("event_id") % 50).cast("string").alias("stop_sequence"))
    return timetable.feed_errors(stops, trips, routes, times)


# -- earliest arrivals and scenarios ----------------------------------------------

_START = 8 * 3600
_CASE = ("base", 4.8, 20.0, 10.0)
_DESTINATIONS = 4


def _rides(spark, d, day=None):
    """Rides of one service day, or of all, in scanning order."""
    times, trips = I.stop_times(spark, d), I.trips(spark, d)
    if day is not None:
        times, trips = times.filter(F.col("day") == F.lit(day)), trips.filter(F.col("day") == F.lit(day))
    c = timetable.connections(times, trips).withColumn("day", F.split("trip_id", ":")[1])
    return network.settled(c.withColumn("seq", F.split("trip_id", ":")[0].cast("long") * 1000 + F.col("seq")))


def _scenarios(spark, rows):
    """Rows: scenario, kind, id, start, and the case's speed and limits."""
    kind = "scenario string, case_id string, kind string, id string, start long, walk_speed_kmh double, most_access_minutes double, most_transfer_minutes double"
    return spark.createDataFrame([(n, c[0], k, i, t, *c[1:]) for n, k, i, t, c in rows], kind)


def _city(spark, d, destinations=1):
    """What the scans need besides scenarios and rides: walks of zones, transfers, direct walks, and walks from stops."""
    zones = I.zones(spark, d).drop("destination")
    stops = F.sequence(F.lit(0).cast("long"), F.lit(I.STOPS - 1).cast("long"))
    walks = zones.select("zone_id", F.explode(stops).alias("stop_id")).withColumn("walk_minutes", (F.col("zone_id") * 31 + F.col("stop_id") * 17) % 600 / 10.0)
    pairs = spark.range(I.STOPS).select(F.col("id").alias("from_stop"), F.explode(stops).alias("to_stop")).filter("from_stop <> to_stop")
    transfers = pairs.withColumn("walk_minutes", (F.col("from_stop") * 7 + F.col("to_stop") * 11) % 240 / 10.0)
    to = F.explode(F.sequence(F.lit(0), F.lit(destinations - 1))).alias("destination")
    direct = zones.select("zone_id", to).withColumn("minutes", 30 + (F.col("zone_id") * 7 + F.col("destination") * 131) % 900 / 10.0)
    egress = spark.range(I.STOPS).select(F.col("id").alias("stop_id"), to).withColumn("minutes", ((F.col("stop_id") * 13 + F.col("destination") * 5) % 25 * 4 + 0.5).cast("double"))
    return {"zones": zones, "walks": walks, "transfers": transfers, "direct": direct, "egress": egress}


def _outcome(spark, d, rows, rides=None, destinations=1):
    """(scenario, destination, zone columns, minutes)."""
    city = _city(spark, d, destinations)
    found = sweep.evaluated(rows, rides=_rides(spark, d, I.first_day(spark, d)) if rides is None else rides, **city)
    return city["zones"].hint("merge").join(found, "zone_id")


def _withdrawn_each(spark, d, cases, starts, rides):
    """The settings, all of them as they are, and what each withdrawal changes."""
    city, rows = _city(spark, d), sweep.settings(_cases(spark, cases), starts)
    return rows, *sweep.withdrawn_each(rows, rides=rides, **city | {k: city[k].drop("destination") for k in ("direct", "egress")})


def _fold_sql(scenarios: str, destinations: int = 1) -> str:
    """A fold over rides in order, one step of recursion each; labels are lists.  Scenarios: scenario, day, start, kind, id, speed, near, far."""
    return f"""WITH RECURSIVE {ZONES}, {RIDES},
first AS (SELECT min(day) AS day FROM stop_times),
steps AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY dep, arr, user_id * 1000 + seq) AS n FROM rides WHERE arr >= dep),
scenarios(scenario, day, start, kind, id, speed, near, far) AS ({scenarios}),
tr AS (SELECT scenario, a, list(CASE WHEN a <> b AND (a * 7 + b * 11) % 240 / 10.0::DOUBLE * 4.8::DOUBLE / speed <= far THEN round_even(((a * 7 + b * 11) % 240 / 10.0::DOUBLE * 4.8::DOUBLE / speed + 1) * 60, 0)::BIGINT ELSE 1000000000000 END ORDER BY b) AS secs
  FROM scenarios, range(0, 20) x(a), range(0, 20) y(b) GROUP BY ALL),
begin AS (SELECT s.*, zone_id, list_transform(range(0, 20), lambda p: CASE WHEN (zone_id * 31 + p * 17) % 600 / 10.0::DOUBLE * 4.8::DOUBLE / speed <= near THEN start + round_even((zone_id * 31 + p * 17) % 600 / 10.0::DOUBLE * 4.8::DOUBLE / speed * 60, 0)::BIGINT ELSE 1000000000000 END) AS labels FROM zones, scenarios s),
fold AS (
  SELECT scenario, day, start, kind, id, speed, zone_id, 0::BIGINT AS n, labels FROM begin
  UNION ALL
  SELECT f.scenario, f.day, start, kind, id, speed, zone_id, s.n, CASE WHEN NOT (kind = 'route' AND id = route_id OR kind = 'trip' AND id = trip_id) AND labels[from_stop + 1] <= dep AND arr < labels[to_stop + 1]
    THEN list_transform(labels, lambda x, i: CASE WHEN i = to_stop + 1 THEN arr ELSE least(x, arr + secs[i]) END) ELSE labels END
  FROM fold f JOIN steps s ON s.day = f.day AND s.n = f.n + 1 JOIN tr ON tr.a = s.to_stop AND tr.scenario = f.scenario),
lasts AS (SELECT d.day, coalesce(max(n), 0) AS n FROM (SELECT DISTINCT day FROM scenarios) d LEFT JOIN steps USING (day) GROUP BY 1),
ended AS (SELECT fold.* FROM fold JOIN lasts ON fold.day = lasts.day AND fold.n = lasts.n),
outcome AS (SELECT scenario, dest, z.* EXCLUDE (destination), least((30 + (zone_id * 7 + dest * 131) % 900 / 10.0::DOUBLE) * 4.8::DOUBLE / speed,
    list_min(list_transform(range(0, 20), lambda p: CASE WHEN labels[p + 1] < 1000000000000 THEN (labels[p + 1] - start) / 60.0::DOUBLE + ((p * 13 + dest * 5) % 25 * 4 + 0.5::DOUBLE) * 4.8::DOUBLE / speed END))) AS minutes
  FROM ended JOIN zones z USING (zone_id), range(0, {destinations}) t(dest))
"""


def _values(rows: str) -> str:
    return f"SELECT scenario, day, start, kind, id, 4.8::DOUBLE, 20.0::DOUBLE, far FROM first, (VALUES {rows}) v(scenario, start, kind, id, far)"


_PLAIN = f"('base', {_START}, 'baseline', '', 10.0::DOUBLE)"
_OUTAGE = f"{_PLAIN}, ('out', {_START}, 'route', 'r0', 10.0::DOUBLE)"


def _outage(spark):
    return _scenarios(spark, [("base", "baseline", "", _START, _CASE), ("out", "route", "r0", _START, _CASE)])


@query("g11_connection_scan", _fold_sql(f"SELECT day::VARCHAR, day, {_START}, 'baseline', '', 4.8::DOUBLE, 20.0::DOUBLE, 10.0::DOUBLE FROM (SELECT DISTINCT day FROM stop_times)") + "SELECT scenario AS day, zone_id, round(minutes, 6) AS minutes FROM outcome")
def g11(spark, d):
    """Every service day of the table is a scenario of its own."""
    rides = _rides(spark, d)
    days = I.stop_times(spark, d).select(F.col("day").cast("string").alias("day")).distinct()
    own = days.join(_scenarios(spark, [("", "baseline", "", _START, _CASE)]).drop("scenario")).withColumn("scenario", F.col("day"))
    return _outcome(spark, d, own, rides).select(F.col("scenario").alias("day"), "zone_id", F.round("minutes", 6).alias("minutes"))


_ACCESS_SQL = """round(sum(population), 4) AS population, count(*) AS zones,
  round(coalesce(sum(population) FILTER (minutes <= 30), 0), 4) AS reachable_30min, round(coalesce(sum(population) FILTER (minutes <= 30), 0) / sum(population) * 100, 3) AS reachable_30min_pct,
  round(coalesce(sum(population) FILTER (minutes <= 60), 0), 4) AS reachable_60min, round(coalesce(sum(population) FILTER (minutes <= 60), 0) / sum(population) * 100, 3) AS reachable_60min_pct,
  round(coalesce(sum(population) FILTER (minutes <= 90), 0), 4) AS reachable_90min, round(coalesce(sum(population) FILTER (minutes <= 90), 0) / sum(population) * 100, 3) AS reachable_90min_pct,
  round(sum(population * minutes) / sum(population) FILTER (minutes IS NOT NULL), 3) AS mean_minutes"""
_BY_SCENARIO = f"SELECT scenario, {_ACCESS_SQL} FROM outcome GROUP BY scenario"


@query("x2_route_outage", _fold_sql(_values(_OUTAGE)) + _BY_SCENARIO)
def x2(spark, d):
    return access.population_access(_outcome(spark, d, _outage(spark)), ["scenario"])


@query("x3_transfer_effect", _fold_sql(_values(f"('with', {_START}, 'baseline', '', 10.0::DOUBLE), ('without', {_START}, 'baseline', '', -1.0)")) + """SELECT count(*) FILTER (b - a > 0.01 OR (b IS NULL AND a IS NOT NULL)) AS improved_zones, round(coalesce(sum(population) FILTER (b - a > 0.01 OR (b IS NULL AND a IS NOT NULL)), 0), 4) AS improved_population,
  count(*) FILTER (b IS NULL AND a IS NOT NULL) AS newly_reachable, round(max(b - a), 4) AS largest_gain FROM (SELECT w.population, o.minutes AS b, w.minutes AS a FROM outcome w JOIN outcome o ON w.zone_id = o.zone_id AND w.scenario = 'with' AND o.scenario = 'without')""")
def x3(spark, d):
    """The same day with transfers and without any, compared."""
    found = _outcome(spark, d, _scenarios(spark, [("with", "baseline", "", _START, _CASE), ("without", "baseline", "", _START, (*_CASE[:3], -1.0))]))
    side = lambda n, c: found.filter(F.col("scenario") == n).select("zone_id", "population", F.col("minutes").alias(c))
    return access.transfer_effect(side("without", "before").join(side("with", "after").drop("population").hint("merge"), "zone_id"), [])


_HOURS = {f"{h:02d}": h * 3600 for h in range(6, 22)}


@query("x4_hours_of_day", _fold_sql(_values(", ".join(f"('{k}', {v}, 'baseline', '', 10.0::DOUBLE)" for k, v in _HOURS.items()))) + _BY_SCENARIO)
def x4(spark, d):
    return access.population_access(_outcome(spark, d, _scenarios(spark, [(k, "baseline", "", v, _CASE) for k, v in _HOURS.items()])), ["scenario"])


_IMPACT_SQL = """round(coalesce(sum(population) FILTER (after - before > 1), 0), 4) AS affected_1, round(coalesce(sum(population) FILTER (after - before > 5), 0), 4) AS affected_5,
  round(coalesce(sum(population) FILTER (after - before > 10), 0), 4) AS affected_10,
  round(round(coalesce(sum(population) FILTER (before <= 30), 0), 4) - round(coalesce(sum(population) FILTER (after <= 30), 0), 4), 4) AS loss_30,
  round(round(coalesce(sum(population) FILTER (before <= 60), 0), 4) - round(coalesce(sum(population) FILTER (after <= 60), 0), 4), 4) AS loss_60,
  round(round(sum(population * after) / sum(population) FILTER (after IS NOT NULL), 3) - round(sum(population * before) / sum(population) FILTER (before IS NOT NULL), 3), 3) AS mean_change"""


@query("x5_leave_one_out", _fold_sql(f"""WITH own AS (SELECT rides.* FROM rides JOIN first USING (day)), still AS (SELECT 'route' AS kind, route_id AS id FROM own WHERE dep >= {_START} UNION SELECT 'trip', trip_id FROM own WHERE dep >= {_START} UNION SELECT 'baseline', '')
  SELECT kind || '|' || id, day, {_START}, kind, id, 4.8::DOUBLE, 20.0::DOUBLE, 10.0::DOUBLE FROM still, first""")
  + f""", pairs AS (SELECT split_part(a.scenario, '|', 1) AS kind, split_part(a.scenario, '|', 2) AS id, a.zone_id, a.population, b.minutes AS before, a.minutes AS after FROM outcome a JOIN outcome b ON a.zone_id = b.zone_id AND b.scenario = 'baseline|' WHERE a.scenario <> 'baseline|'),
  impacts AS (SELECT kind, id, {_IMPACT_SQL} FROM pairs GROUP BY ALL),
  named AS (SELECT DISTINCT 'route' AS kind, route_id AS id FROM rides JOIN first USING (day) UNION SELECT DISTINCT 'trip', trip_id FROM rides JOIN first USING (day)),
  filled AS (SELECT kind, id, i.id IS NOT NULL AS evaluated, coalesce(affected_1, 0) AS affected_1, coalesce(affected_5, 0) AS affected_5, coalesce(affected_10, 0) AS affected_10, coalesce(loss_30, 0) AS loss_30, coalesce(loss_60, 0) AS loss_60, coalesce(mean_change, 0) AS mean_change FROM named LEFT JOIN impacts i USING (kind, id))
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY affected_1 DESC, mean_change DESC, id)::INT AS rank FROM filled""")
def x5(spark, d):
    """Each route and each trip of the day withdrawn on its own."""
    rides = _rides(spark, d, I.first_day(spark, d))
    rows, base, changed = _withdrawn_each(spark, d, scenarios.CASES[:1], spark.createDataFrame([(_START,)], "start long"), rides)
    found = sweep.impacts_of_changes(rows, base, changed, I.zones(spark, d), rides)
    return found.drop("case_id", "start")


def _cases(spark, cases):
    return spark.createDataFrame(list(cases), scenarios.CASE_SCHEMA)


@query("x6_skipped_candidates", f"""WITH {RIDES}, own AS (SELECT * FROM rides WHERE day = (SELECT min(day) FROM stop_times)), slots AS (SELECT unnest(range(21600, 79200, 3600))::BIGINT AS start),
  last AS (SELECT 'route' AS kind, route_id AS id, max(dep) AS dep FROM own GROUP BY ALL UNION ALL SELECT 'trip', trip_id, max(dep) FROM own GROUP BY ALL) SELECT start, kind, id, dep >= start AS evaluated FROM last, slots""")
def x6(spark, d):
    starts = spark.range(6, 22).select((F.col("id") * 3600).alias("start"))
    return sweep.skipped(_rides(spark, d, I.first_day(spark, d)), starts)


@query("x7_monotonic", _fold_sql(_values(_OUTAGE)) + """SELECT a.zone_id, round(b.minutes, 6) AS before, round(a.minutes, 6) AS after FROM outcome a JOIN outcome b
  ON a.zone_id = b.zone_id AND b.scenario = 'out' AND a.scenario = 'base' WHERE a.minutes < b.minutes - 1e-6 OR (b.minutes IS NULL AND a.minutes IS NOT NULL)""")
def x7(spark, d):
    """The pair the wrong way round, the outage as the baseline: every zone that the route helps is a violation."""
    rows = _outage(spark)
    minutes = _outcome(spark, d, rows).select("scenario", "zone_id", "minutes")
    swapped = rows.withColumn("kind", F.when(F.col("kind") == "baseline", "route").otherwise("baseline"))
    return sweep.violations(swapped, minutes).select("zone_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("x8_destinations", _fold_sql(_values(_OUTAGE), _DESTINATIONS) + f"SELECT scenario, dest::INT AS destination, {_ACCESS_SQL} FROM outcome GROUP BY ALL")
def x8(spark, d):
    return access.population_access(_outcome(spark, d, _outage(spark), destinations=_DESTINATIONS), ["scenario", "destination"])


def _ages(rows):
    p = F.col("population")
    share = lambda k: p * (F.col("zone_id") % k).cast("double") / k
    return rows.withColumns(dict(zip(("w", "w65", "w75", "w85"), S.nested_ages(p, share(7) + 10, share(5), share(3) - 50), strict=True)))


_AGES_SQL = """a0 AS (SELECT *, population AS w, least(population, greatest(0, population * (zone_id % 7)::DOUBLE / 7 + 10)) AS w65 FROM pairs),
  a1 AS (SELECT *, least(w65, greatest(0, population * (zone_id % 5)::DOUBLE / 5)) AS w75 FROM a0), aged AS (SELECT *, least(w75, greatest(0, population * (zone_id % 3)::DOUBLE / 3 - 50)) AS w85 FROM a1)"""
_GROUPS_SQL = f"""g AS (SELECT destination, before, after, unnest(['all', '65plus', '75plus', '85plus']) AS "group", unnest([w, w65, w75, w85]) AS weight FROM aged),
  m AS (SELECT destination, "group", round(sum(weight), 4) AS population, round(coalesce(sum(weight) FILTER (before <= 30), 0), 4) AS reachable_30, round(coalesce(sum(weight) FILTER (before <= 60), 0), 4) AS reachable_60,
  {", ".join(f'round(coalesce(sum(weight) FILTER (after - before > {m}), 0), 4) AS affected_{m}, round(100 * coalesce(sum(weight) FILTER (after - before > {m}), 0) / sum(weight), 3) AS affected_{m}_pct' for m in (1, 5, 10))},
  round(sum(weight * before) / sum(weight) FILTER (before IS NOT NULL), 3) AS mean_before, round(sum(weight * after) / sum(weight) FILTER (after IS NOT NULL), 3) AS mean_after,
  round(sum(weight * after) / sum(weight) FILTER (after IS NOT NULL) - sum(weight * before) / sum(weight) FILTER (before IS NOT NULL), 3) AS mean_change FROM g GROUP BY ALL)"""


@query("x9_destination_equity", _fold_sql(_values(_OUTAGE), _DESTINATIONS) + f""", pairs AS (SELECT a.* EXCLUDE (scenario, dest, minutes), a.dest::INT AS destination, a.minutes AS before, b.minutes AS after FROM outcome a JOIN outcome b ON a.zone_id = b.zone_id AND a.dest = b.dest AND a.scenario = 'base' AND b.scenario = 'out'),
  {_AGES_SQL}, {_GROUPS_SQL} SELECT * FROM m""")
def x9(spark, d):
    """Four destinations by four age groups, before and after the outage."""
    found = _outcome(spark, d, _outage(spark), destinations=_DESTINATIONS)
    side = lambda n, c: found.filter(F.col("scenario") == n).withColumnRenamed("minutes", c).drop("scenario")
    rows = _ages(side("base", "before").join(side("out", "after").select("zone_id", "destination", "after").hint("merge"), ["zone_id", "destination"]))
    groups = dict(zip(equity.GROUPS, ("w", "w65", "w75", "w85"), strict=True))
    return equity.group_access(equity.unpivoted(rows, ["destination", "before", "after"], groups), ["destination"])


@query("x10_sensitivity_cases", _fold_sql("SELECT scenario, day, " + f"{_START}, 'baseline', '', speed, near, far FROM first, (VALUES " + ", ".join(f"('{c[0]}', {c[2]}::DOUBLE, {c[3]}::DOUBLE, {c[4]}::DOUBLE)" for c in scenarios.CASES) + ") v(scenario, speed, near, far)") + _BY_SCENARIO.replace("SELECT scenario", "SELECT scenario AS case_id"))
def x10(spark, d):
    """Each registered case with its own speed and limits, scanned."""
    rows = _scenarios(spark, [(c[0], "baseline", "", _START, (c[0], *c[2:])) for c in scenarios.CASES])
    return access.population_access(_outcome(spark, d, rows).withColumnRenamed("scenario", "case_id"), ["case_id"])


@query("x11_robustness_sweep")
def x11(spark, d):
    """Every case at every hour, as it is and without each service: who is hit worst over the day, and whether that holds in all cases."""
    rides = _rides(spark, d, I.first_day(spark, d))
    rows, base, changed = _withdrawn_each(spark, d, scenarios.CASES, spark.range(6, 22).select((F.col("id") * 3600).alias("start")), rides)
    impacts = network.settled(sweep.impacts_of_changes(rows, base, changed, I.zones(spark, d), rides))
    by_day = ranking.day_ranking(impacts.withColumns({"affected": F.col("affected_1"), "seconds": F.col("start")}), ["case_id", "kind"])
    routes = by_day.filter("kind = 'route'")
    return by_day.join(ranking.stability(routes.drop("kind"), "baseline").select(F.col("reference_id").alias("id"), F.lit("route").alias("kind"), "top1", "top_k"), ["kind", "id"], "left")


# -- populations --------------------------------------------------------------------


@query("a1_population_access", f"WITH {PAIRS}, p AS (SELECT destination, population, before AS minutes FROM pairs) SELECT destination, {_ACCESS_SQL} FROM p GROUP BY 1")
def a1(spark, d):
    return access.population_access(I.pairs(spark, d).withColumnRenamed("before", "minutes"), ["destination"])


@query("a4_impact", f"WITH {PAIRS} SELECT destination, {_IMPACT_SQL} FROM pairs GROUP BY 1")
def a4(spark, d):
    return access.impact(I.pairs(spark, d), ["destination"])


@query("a5_threshold_losses", f"""WITH {PAIRS} SELECT destination, threshold, round(coalesce(sum(population) FILTER (before <= threshold), 0) - coalesce(sum(population) FILTER (after <= threshold), 0), 4) AS loss
  FROM pairs, (VALUES (30), (45), (60), (90)) t(threshold) GROUP BY ALL""")
def a5(spark, d):
    return access.threshold_losses(I.pairs(spark, d), ["destination"])


def _aged(spark, d):
    rows = _ages(I.pairs(spark, d))
    return rows, equity.unpivoted(rows, ["destination", "before", "after"], dict(zip(equity.GROUPS, ("w", "w65", "w75", "w85"), strict=True)))


_AGED = f"{PAIRS}, {_AGES_SQL}"


@query("f31_age_weights", f"WITH {_AGED} SELECT zone_id, round(w, 6) AS w, round(w65, 6) AS w65, round(w75, 6) AS w75, round(w85, 6) AS w85 FROM aged")
def f31(spark, d):
    return _aged(spark, d)[0].select("zone_id", *[F.round(c, 6).alias(c) for c in ("w", "w65", "w75", "w85")])


_GROUPED = f"{_AGED}, {_GROUPS_SQL}"


@query("a6_group_access", f"WITH {_GROUPED} SELECT * FROM m")
def a6(spark, d):
    return equity.group_access(_aged(spark, d)[1], ["destination"])


@query("a7_equity_gaps", f"""WITH {_GROUPED} SELECT a.destination, a."group", round(a.affected_1_pct - b.affected_1_pct, 3) AS share_gap, round(a.mean_change - b.mean_change, 3) AS change_gap
  FROM m a JOIN m b ON a.destination = b.destination AND b."group" = 'all' WHERE a."group" <> 'all'""")
def a7(spark, d):
    return equity.gaps(equity.group_access(_aged(spark, d)[1], ["destination"]), ["destination"])


@query("a8_grid_population", f"WITH {ZONES} SELECT floor(lon * 10) / 10 AS lon, floor(lat * 10) / 10 AS lat, round(sum(population), 4) AS population, count(*) AS zones FROM zones GROUP BY 1, 2 HAVING round(sum(population), 4) > 0")
def a8(spark, d):
    return spatial.to_grid(I.zones(spark, d))


@query("a9_road_census", """WITH last AS (SELECT l_partkey % 200 AS section, l_returnflag AS direction, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber, l_quantity)) AS volume FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
  SELECT section, round(sum(volume), 4) AS volume, count(*) AS directions FROM last GROUP BY 1""")
def a9(spark, d):
    li = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select((F.col("l_partkey") % 200).alias("section"), F.col("l_returnflag").alias("direction"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_quantity")
    last = li.groupBy("section", "direction").agg(F.max(F.struct("row", "l_quantity"))["l_quantity"].alias("volume"))
    return last.groupBy("section").agg(F.round(F.sum("volume"), 4).alias("volume"), F.count("*").alias("directions"))


@query("a11_fit_measures", f"""WITH {_LINKS} SELECT count(*) AS n, round(avg(abs((model - observed) / observed)) FILTER (abs(observed) > 0) * 100, 6) AS mape, round(sqrt(avg(pow(model - observed, 2))), 6) AS rmse,
  round(sum(abs(model - observed)) / sum(abs(observed)) * 100, 6) AS wape, round(avg((sqrt(2 * pow(model - observed, 2) / (model + observed)) < 5)::INT::DOUBLE) * 100, 6) AS geh_below_5_pct FROM links""")
def a11(spark, d):
    return demand.fit_measures(_links(spark, d))


@query("a12_screenline", f"""WITH {_LINKS}, s AS (SELECT 'e' || (p_partkey % 600)::VARCHAR AS edge_id FROM part WHERE p_size = 7)
  SELECT round(coalesce(sum(model), 0), 4) AS model, round(coalesce(sum(observed), 0), 4) AS observed, round((coalesce(sum(model), 0) - sum(observed)) / sum(observed) * 100, 4) AS error_pct FROM s LEFT JOIN links USING (edge_id)""")
def a12(spark, d):
    links = _links(spark, d)
    chosen = table(spark, d, "part").filter("p_size = 7").select(F.concat(F.lit("e"), F.col("p_partkey") % 600).alias("edge_id"))
    return demand.screenline(chosen, links.select("edge_id", "model"), links.select("edge_id", "observed"))


@query("a13_vehicle_km", f"WITH {_LINKS} SELECT round(sum(model * length_km), 4) AS vkt FROM links")
def a13(spark, d):
    links = _links(spark, d)
    return demand.vehicle_km(links.select("edge_id", F.col("model").alias("volume")), links.select("edge_id", "length_km"))


@query("a16_transfer_effect", f"""WITH {PAIRS}, t AS (SELECT destination, population, after AS before, before AS after FROM pairs) SELECT destination,
  count(*) FILTER (before - after > 0.01 OR (before IS NULL AND after IS NOT NULL)) AS improved_zones, round(coalesce(sum(population) FILTER (before - after > 0.01 OR (before IS NULL AND after IS NOT NULL)), 0), 4) AS improved_population,
  count(*) FILTER (before IS NULL AND after IS NOT NULL) AS newly_reachable, round(max(before - after), 4) AS largest_gain FROM t GROUP BY 1""")
def a16(spark, d):
    p = I.pairs(spark, d).select("destination", "population", F.col("after").alias("b"), F.col("before").alias("a"))
    return access.transfer_effect(p.toDF("destination", "population", "before", "after"), ["destination"])


@query("a19_bounds", f"WITH {ZONES} SELECT round(min(lat) - 0.02::DOUBLE, 9) AS south, round(min(lon) - 0.02::DOUBLE, 9) AS west, round(max(lat) + 0.02::DOUBLE, 9) AS north, round(max(lon) + 0.02::DOUBLE, 9) AS east FROM zones")
def a19(spark, d):
    b = spatial.padded_bounds(I.zones(spark, d))
    return b.select(*[F.round(c, 9).alias(c) for c in b.columns])


@query("a25_weighted_cdf", f"""WITH {PAIRS}, t AS (SELECT destination, sum(population) AS total FROM pairs GROUP BY 1)
  SELECT destination, minute::INT AS minute, round(coalesce(sum(population) FILTER (before <= minute), 0) / any_value(total), 6) AS share FROM pairs JOIN t USING (destination), range(0, 125, 5) m(minute) GROUP BY ALL""")
def a25(spark, d):
    return access.weighted_cdf(I.pairs(spark, d).withColumnRenamed("before", "minutes"), ["destination"])


@query("j7_nearest_facility", f"""WITH {ZONES}, {FACILITIES}, met AS (SELECT zone_id, place_id, greatest(abs(floor(z.lat / 0.01::DOUBLE) - floor(f.lat / 0.01::DOUBLE)), abs(floor(z.lon / 0.01::DOUBLE) - floor(f.lon / 0.01::DOUBLE))) AS ring,
  6371.0088::DOUBLE * 2 * asin(sqrt(pow(sin(radians(f.lat - z.lat) / 2), 2) + cos(radians(z.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - z.lon) / 2), 2))) AS km FROM zones z, facilities f),
  best AS (SELECT zone_id, place_id, km, row_number() OVER (PARTITION BY zone_id ORDER BY least(ring, 3), km, place_id) AS r FROM met) SELECT zone_id, place_id, round(km, 6) AS km FROM best WHERE r = 1""")
def j7(spark, d):
    found = spatial.nearest(I.zones(spark, d).withColumnRenamed("zone_id", "point_id"), I.facilities(spark, d), cell=0.01, rings=2)
    return found.select(F.col("point_id").alias("zone_id"), "place_id", F.round("km", 6).alias("km"))


# -- ranking ------------------------------------------------------------------------


@query("w2_ranking", f"WITH {SLOTS} SELECT case_id, seconds, id, row_number() OVER (PARTITION BY case_id, seconds ORDER BY affected DESC, mean_change DESC, id)::INT AS rank FROM slots")
def w2(spark, d):
    return ranking.ranked(I.slots(spark, d), ["case_id", "seconds"]).select("case_id", "seconds", "id", "rank")


@query("w3_peak_event", f"WITH {SLOTS} SELECT case_id, id, seconds, affected, mean_change FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY affected DESC, mean_change DESC, id, seconds) AS r FROM slots WHERE material) WHERE r = 1")
def w3(spark, d):
    return ranking.peak_event(I.slots(spark, d), ["case_id"])


_DAY_RANKS = f"""{SLOTS}, worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, id ORDER BY affected DESC, mean_change DESC, seconds) AS r FROM slots WHERE evaluated) WHERE r = 1),
  ranks AS (SELECT case_id, id, affected, mean_change, seconds AS peak_seconds, row_number() OVER (PARTITION BY case_id ORDER BY affected DESC, mean_change DESC, id)::INT AS rank FROM worst)"""


@query("w4_day_ranking", f"WITH {_DAY_RANKS} SELECT * FROM ranks")
def w4(spark, d):
    return ranking.day_ranking(I.slots(spark, d), ["case_id"])


_FIRSTS = f"""{SLOTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, seconds ORDER BY affected DESC, mean_change DESC, id) AS rank FROM slots),
  firsts AS (SELECT case_id, seconds, arg_min(id, rank) FILTER (material) AS id FROM ranked GROUP BY ALL)"""


def _firsts(spark, d):
    return ranking.first_material(ranking.ranked(I.slots(spark, d), ["case_id", "seconds"]), ["case_id", "seconds"])


@query("w5_first_material", f"WITH {_FIRSTS} SELECT * FROM firsts")
def w5(spark, d):
    return _firsts(spark, d)


@query("w6_top_changes", f"WITH {_FIRSTS}, l AS (SELECT case_id, id, lag(id) OVER (PARTITION BY case_id ORDER BY seconds) AS b FROM firsts WHERE id IS NOT NULL) SELECT case_id, count(*) FILTER (b IS NOT NULL AND b <> id) AS changes FROM l GROUP BY 1")
def w6(spark, d):
    return ranking.top_changes(_firsts(spark, d), ["case_id"])


@query("w8_worst_slot", f"WITH {SLOTS}, t AS (SELECT case_id, seconds, round(sum(affected), 4) AS a FROM slots GROUP BY ALL) SELECT case_id, arg_max(seconds, (a, -seconds)) AS worst, arg_min(seconds, (a, seconds)) AS best FROM t GROUP BY 1")
def w8(spark, d):
    t = I.slots(spark, d).groupBy("case_id", "seconds").agg(F.round(F.sum("affected"), 4).alias("a"))
    return t.groupBy("case_id").agg((-F.max(F.struct("a", (-F.col("seconds")).alias("s")))["s"]).alias("worst"), F.min(F.struct("a", "seconds"))["seconds"].alias("best"))


@query("a21_material", f"WITH {SLOTS} SELECT case_id, seconds, id, greatest(affected, 0, mean_change) > 1e-6 AS material FROM slots")
def a21(spark, d):
    zero = F.lit(0.0)
    return I.slots(spark, d).select("case_id", "seconds", "id", ranking.material(F.col("affected"), zero, zero, F.col("mean_change")).alias("material"))


@query("a22_stability", f"""WITH {_DAY_RANKS}, f AS (SELECT id AS reference_id FROM ranks WHERE case_id = 'error' AND rank = 1), c AS (SELECT c.case_id, reference_id, r.rank FROM (SELECT DISTINCT case_id FROM ranks) c, f LEFT JOIN ranks r ON r.case_id = c.case_id AND r.id = reference_id)
  SELECT reference_id, count(*) AS cases, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 3) AS top_k, coalesce(string_agg(case_id, ',' ORDER BY case_id) FILTER (rank IS NULL OR rank <> 1), '') AS changed,
  coalesce(string_agg(case_id, ',' ORDER BY case_id) FILTER (rank IS NULL OR rank > 3), '') AS outside FROM c GROUP BY 1""")
def a22(spark, d):
    return ranking.stability(ranking.day_ranking(I.slots(spark, d), ["case_id"]), "error")


@query("t3_most_affected", f"WITH {PAIRS} SELECT zone_id, round(population * (after - before), 4) AS burden FROM pairs WHERE after > before ORDER BY burden DESC, zone_id LIMIT 5")
def t3(spark, d):
    p = I.pairs(spark, d).filter("after > before").select("zone_id", F.round(F.col("population") * (F.col("after") - F.col("before")), 4).alias("burden"))
    return p.orderBy(F.desc("burden"), "zone_id").limit(5)


# -- demand and networks ----------------------------------------------------------------

_OD = """od AS (SELECT c.c_nationkey AS origin, s.s_nationkey AS destination, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _od(spark, d):
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    lines = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination")).agg(F.sum("l_quantity").alias("value"))


_STEP = """SELECT origin, destination, value * target / nullif(sum(value) OVER (PARTITION BY {key}), 0) AS value FROM {before} JOIN (SELECT {key}, sum(value) * 1.5::DOUBLE AS target FROM od GROUP BY 1) USING ({key})"""


def _ipf_sql(rounds: int) -> str:
    parts, before = [_OD, "s0 AS (SELECT origin, destination, value * exp(-0.05::DOUBLE * abs(origin - destination)) AS value FROM od)"], "s0"
    for k in range(rounds):
        for n, key in enumerate(("origin", "destination")):
            name = f"s{k + 1}_{n}"
            parts.append(f"{name} AS ({_STEP.format(key=key, before=before)})")
            before = name
    return f"WITH {', '.join(parts)} SELECT origin, destination, round(value, 6) AS value FROM {before}"


@query("g7_balanced_rounds", _ipf_sql(4))
def g7(spark, d):
    od = _od(spark, d)
    seed = od.withColumn("value", F.col("value") * F.exp(-0.05 * F.abs(F.col("origin") - F.col("destination"))))
    rows = od.groupBy("origin").agg((F.sum("value") * 1.5).alias("row_target"))
    columns = od.groupBy("destination").agg((F.sum("value") * 1.5).alias("column_target"))
    return demand.balanced_rounds(seed, rows, columns, 4).select("origin", "destination", F.round("value", 6).alias("value"))


def _converged_sql(groups: bool) -> str:
    """Scaling by turns, 150 times: each turn is a step of recursion with a window for each side."""
    of = ", abs(origin - destination) % 3 AS grp" if groups else ""
    keys = ["origin", "destination", *(["grp"] if groups else [])]
    rows, inner = ", ".join(keys if groups else keys[:2]), "SELECT * FROM s"
    for key in keys:
        inner = f"SELECT n, {rows}, coalesce(value * target / nullif(sum(value) OVER (PARTITION BY {key}), 0), 0) AS value FROM ({inner}) JOIN t_{key} USING ({key})"
    target = "seed" if groups else "od"
    targets = ", ".join(f"t_{key} AS (SELECT {key}, sum(value) * 1.5::DOUBLE AS target FROM {target if key == 'grp' else 'od'} GROUP BY 1)" for key in keys[:2])
    if groups:  # what the balanced matrix without groups has in each
        return f"""WITH RECURSIVE {_OD}, seed AS (SELECT 0 AS n, origin, destination{of}, value * exp(-0.05::DOUBLE * abs(origin - destination)) AS value FROM od),
  whole AS (SELECT sum(value) * 1.5::DOUBLE AS v FROM od), {targets}, t_grp AS (SELECT grp, v * sum(value) / sum(sum(value)) OVER () AS target FROM (SELECT abs(origin - destination) % 3 AS grp, value FROM od), whole GROUP BY grp, v),
  s AS (SELECT * FROM seed UNION ALL SELECT n + 1, {rows}, value FROM ({inner}) WHERE n < 150) SELECT origin, destination, round(value, 4) AS value FROM s WHERE n = 150"""
    return f"""WITH RECURSIVE {_OD}, {targets}, s AS (SELECT 0 AS n, origin, destination, value * exp(-0.05::DOUBLE * abs(origin - destination)) AS value FROM od UNION ALL SELECT n + 1, {rows}, value FROM ({inner}) WHERE n < 150)
  SELECT origin, destination, round(value, 4) AS value FROM s WHERE n = 150"""


def _margins(spark, d):
    """Trips between nations, the seed that distance makes of them, and totals half as large again."""
    od = network.settled(_od(spark, d))
    seed = od.withColumn("value", F.col("value") * F.exp(-0.05 * F.abs(F.col("origin") - F.col("destination"))))
    return od, seed, od.groupBy("origin").agg((F.sum("value") * 1.5).alias("row_target")), od.groupBy("destination").agg((F.sum("value") * 1.5).alias("column_target"))


@query("g7_balanced", _converged_sql(False))
def g7_converged(spark, d):
    """Scaled by turns until rows and columns have their totals."""
    _, seed, rows, columns = _margins(spark, d)
    return demand.balanced(seed, rows, columns, tolerance=1e-6).select("origin", "destination", F.round("value", 4).alias("value"))


@query("g8_balanced_groups", _converged_sql(True))
def g8(spark, d):
    """The same with a total for each of three groups of pairs too."""
    od, seed, rows, columns = _margins(spark, d)
    group = (F.abs(F.col("origin") - F.col("destination")) % 3).alias("group")
    whole = od.agg(F.sum("value").alias("v"))
    targets = od.groupBy(group).agg(F.sum("value").alias("own")).crossJoin(whole).select("group", (F.col("v") * 1.5 * F.col("own") / F.col("v")).alias("target"))
    return demand.balanced(seed.select("*", group), rows, columns, targets, tolerance=1e-6).select("origin", "destination", F.round("value", 4).alias("value"))


@query("x15_freight_access", f"WITH {PAIRS} SELECT s_suppkey AS node_id, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM supplier JOIN pairs ON s_suppkey = zone_id WHERE before IS NOT NULL AND after IS NOT NULL")
def x15(spark, d):
    p = I.pairs(spark, d)
    side = lambda c: p.select(F.col("zone_id").alias("node_id"), F.col(c).alias("minutes"))
    found = access.both_reachable(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), side("before"), side("after"))
    return found.select("node_id", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query("x16_relief_status", """WITH m AS (SELECT n_nationkey AS hub, s_suppkey AS shelter, CASE WHEN (n_nationkey + s_suppkey) % 6 > 0 THEN (n_nationkey * 19 + s_suppkey * 7) % 300 END AS minutes FROM nation, supplier)
  SELECT hub, shelter, CASE WHEN minutes IS NULL THEN 'unreachable_under_network' WHEN minutes <= 180 THEN 'reachable_under_network' ELSE 'over_threshold' END AS status FROM m""")
def x16(spark, d):
    hubs, shelters = table(spark, d, "nation").select(F.col("n_nationkey").alias("hub")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("shelter"))
    times = hubs.crossJoin(shelters).filter((F.col("hub") + F.col("shelter")) % 6 > 0).withColumn("minutes", (F.col("hub") * 19 + F.col("shelter") * 7) % 300)
    return access.relief_status(hubs, shelters, times).select("hub", "shelter", "status")


# -- networks over nations -------------------------------------------------------------

# Each supplier has roads to three others, so there are circles; minutes differ enough to leave no ties.
_ROADS = """size AS (SELECT count(*) AS m FROM supplier),
  roads AS (SELECT u || '-' || v AS edge_id, u, v, (u * 7 + v * 3) % 11 + 1 + u / 64.0::DOUBLE + v / 4096.0::DOUBLE AS minutes FROM (SELECT DISTINCT s_suppkey AS u, (s_suppkey * (k + 1) + 7 * k) % m + (SELECT min(s_suppkey) FROM supplier) AS v FROM supplier, size, range(1, 4) t(k)) WHERE u <> v)"""


def _roads(spark, d):
    s = table(spark, d, "supplier")
    m, low = s.agg(F.count("*"), F.min("s_suppkey")).first()
    to = F.explode(F.array(*[(F.col("u") * (k + 1) + 7 * k) % m + low for k in (1, 2, 3)])).alias("v")
    ahead = s.select(F.col("s_suppkey").alias("u")).select("u", to).distinct().filter("u <> v")
    minutes = (F.col("u") * 7 + F.col("v") * 3) % 11 + 1 + F.col("u") / 64.0 + F.col("v") / 4096.0
    return ahead.select(F.concat_ws("-", "u", "v").alias("edge_id"), "u", "v", minutes.alias("minutes"), F.lit(500.0).alias("capacity"), F.lit(1.0).alias("length_km"), F.lit(30.0).alias("speed_kmh"))


def _all_nodes(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


_PATHS = f"""WITH RECURSIVE {_ROADS},
  best(source, node, minutes, path) USING KEY (source, node) AS (SELECT s_suppkey, s_suppkey, 0::DOUBLE, []::VARCHAR[] FROM supplier
    UNION SELECT b.source, r.v, min(b.minutes + r.minutes), arg_min(list_append(b.path, r.edge_id), b.minutes + r.minutes) FROM best b JOIN roads r ON r.u = b.node LEFT JOIN recurring.best o ON o.source = b.source AND o.node = r.v
    WHERE o.minutes IS NULL OR b.minutes + r.minutes < o.minutes - 1e-12 GROUP BY ALL)"""
_FLOWS = """flows AS (SELECT a.l_suppkey AS origin, b.l_suppkey AS destination, sum(a.l_quantity) AS value FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber GROUP BY ALL)"""


def _flows(spark, d):
    """What follows in one order goes from supplier to supplier."""
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("origin"), F.col("l_quantity").alias("value"))
    return a.join(li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("destination")), ["l_orderkey", "l_linenumber"]).groupBy("origin", "destination").agg(F.sum("value").alias("value"))


@query("g3_shortest_paths", _PATHS + " SELECT source, node, round(minutes, 6) AS minutes FROM best")
def g3(spark, d):
    return network.shortest_paths(_roads(spark, d), _all_nodes(spark, d)).select("source", "node", F.round("minutes", 6).alias("minutes"))


@query("g5_isochrone", _PATHS + " SELECT source, count(*) AS nodes FROM best WHERE minutes <= 20 GROUP BY 1")
def g5(spark, d):
    found = network.shortest_paths(_roads(spark, d), _all_nodes(spark, d), most=20.0)
    return found.groupBy("source").agg(F.count("*").alias("nodes"))


@query("g6_stop_walks", f"""WITH RECURSIVE {_ROADS}, stops AS (SELECT s_nationkey AS stop, min(s_suppkey) AS node FROM supplier GROUP BY 1),
  best(source, node, minutes) USING KEY (source, node) AS (SELECT node, node, 0::DOUBLE FROM stops
    UNION SELECT b.source, r.v, min(b.minutes + r.minutes) FROM best b JOIN roads r ON r.u = b.node LEFT JOIN recurring.best o ON o.source = b.source AND o.node = r.v
    WHERE b.minutes + r.minutes <= 25 AND (o.minutes IS NULL OR b.minutes + r.minutes < o.minutes - 1e-12) GROUP BY ALL)
  SELECT a.stop AS from_stop, b.stop AS to_stop, round(minutes, 6) AS minutes FROM best JOIN stops a ON a.node = source JOIN stops b ON b.node = best.node WHERE a.stop <> b.stop""")
def g6(spark, d):
    """Walks of 25 minutes at the most between the first suppliers of nations."""
    stops = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("stop_id")).agg(F.min("s_suppkey").alias("node"))
    return network.walks_between(_roads(spark, d), stops, 25.0).withColumn("minutes", F.round("minutes", 6))


def _equilibrium_sql(iterations: int) -> str:
    """Averages of loads on shortest paths, unrolled."""
    parts = [_ROADS, _FLOWS, "v0 AS (SELECT edge_id, 0::DOUBLE AS volume FROM roads)"]
    for n in range(1, iterations + 1):
        parts += [f"c{n} AS MATERIALIZED (SELECT r.edge_id, u, v, minutes * (1 + 0.15::DOUBLE * pow(volume / 20000.0::DOUBLE, 4)) AS cost FROM roads r JOIN v{n - 1} USING (edge_id))"]
        parts += [f"""b{n}(source, node, minutes, path) USING KEY (source, node) AS (SELECT s_suppkey, s_suppkey, 0::DOUBLE, []::VARCHAR[] FROM supplier
    UNION SELECT b.source, r.v, min(b.minutes + r.cost), arg_min(list_append(b.path, r.edge_id), b.minutes + r.cost) FROM b{n} b JOIN c{n} r ON r.u = b.node LEFT JOIN recurring.b{n} o ON o.source = b.source AND o.node = r.v
    WHERE o.minutes IS NULL OR b.minutes + r.cost < o.minutes - 1e-12 GROUP BY ALL)"""]
        parts += [f"l{n} AS (SELECT unnest(path) AS edge_id, value FROM flows JOIN b{n} ON origin = source AND destination = node)", f"w{n} AS (SELECT edge_id, sum(value) AS load FROM l{n} GROUP BY 1)"]
        parts += [f"v{n} AS MATERIALIZED (SELECT edge_id, volume + (coalesce(load, 0) - volume) / {n} AS volume FROM v{n - 1} LEFT JOIN w{n} USING (edge_id))"]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT edge_id, round(volume, 3) AS volume FROM v{iterations}"


@query("g10_user_equilibrium", _equilibrium_sql(2))
def g10(spark, d):
    """Two rounds of successive averages; roads hold 20000."""
    roads = _roads(spark, d).withColumn("capacity", F.lit(20000.0))
    return network.user_equilibrium(roads, _flows(spark, d), iterations=2)[0].select("edge_id", F.round("volume", 3).alias("volume"))


@query("g9_all_or_nothing", _PATHS + f""", {_FLOWS}, routed AS (SELECT unnest(path) AS edge_id, value FROM flows JOIN best ON origin = source AND destination = node)
  SELECT edge_id, round(coalesce(sum(value), 0), 4) AS volume FROM roads LEFT JOIN routed USING (edge_id) GROUP BY 1""")
def g9(spark, d):
    return network.all_or_nothing(_roads(spark, d), _flows(spark, d))[0].select("edge_id", F.round("volume", 4).alias("volume"))


@query("g12_graph_errors", f"WITH {_ROADS} SELECT 'end: ' || edge_id AS error FROM roads WHERE u % 10 = 7 OR v % 10 = 7 UNION SELECT 'length: ' || edge_id FROM roads WHERE u = 3")
def g12(spark, d):
    edges = _roads(spark, d).withColumn("length_km", F.when(F.col("u") == 3, 0.0).otherwise(F.col("length_km")))
    return network.graph_errors(edges, _all_nodes(spark, d).filter("node % 10 <> 7"))


@query("t4_longest_link", f"WITH {_ROADS}, w AS (SELECT *, u % 4 AS way FROM roads) SELECT edge_id, way FROM w WHERE way = (SELECT way FROM w ORDER BY minutes DESC, edge_id DESC LIMIT 1)")
def t4(spark, d):
    edges = _roads(spark, d).withColumn("way", F.col("u") % 4)
    longest = edges.agg(F.max(F.struct("minutes", "edge_id", "way"))["way"].alias("way"))
    return edges.join(longest, "way", "left_semi").select("edge_id", "way")


@query("k2_point_features", f"""WITH {ZONES} SELECT zone_id::VARCHAR AS id, '{{"type":"Feature","id":"' || zone_id::VARCHAR || '","properties":{{"zone_id":' || zone_id::VARCHAR || ',"mesh":"' || mesh || '"}}}}' AS feature,
  'Point' AS shape, round(lon, 9) AS lon, round(lat, 9) AS lat FROM zones""")
def k2(spark, d):
    """The text of each feature up to its geometry, and the geometry read back from it."""
    f = sinks.point_features(I.zones(spark, d), "zone_id", "zone_id", "mesh")
    at = lambda path: F.get_json_object("feature", f"$.geometry.{path}")
    told = F.concat(F.regexp_replace("feature", r',"geometry".*$', ""), F.lit("}"))
    return f.select("id", told.alias("feature"), at("type").alias("shape"), F.round(at("coordinates[0]").cast("double"), 9).alias("lon"), F.round(at("coordinates[1]").cast("double"), 9).alias("lat"))


@query("k8_stable_id", """SELECT p_partkey, substr(sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size::VARCHAR || '}'), 1, 16) AS id FROM part""")
def k8(spark, d):
    return table(spark, d, "part").select("p_partkey", sinks.stable_id("p_name", "p_brand", "p_size").alias("id"))


@query("k9_ordered_union", "SELECT n_nationkey, 'r' || n_regionkey::VARCHAR || ',x,n' || n_nationkey::VARCHAR || CASE WHEN n_nationkey = 2 THEN '' ELSE ',n2' END AS merged FROM nation")
def k9(spark, d):
    a = F.array(F.concat(F.lit("r"), "n_regionkey"), F.lit("x"), F.concat(F.lit("n"), "n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(sinks.ordered_union(a, F.array(F.lit("x"), F.lit("n2"))), ",").alias("merged"))


_VERSIONS = """v AS (SELECT 'd' || (o_custkey % 50)::VARCHAR AS dataset_id, 'v' || o_orderkey::VARCHAR AS version_id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'validated' ELSE 'candidate' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'passed' ELSE 'failed' END AS validation_status FROM orders)"""


def _versions(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "validated").otherwise("candidate")
    return table(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_custkey") % 50).alias("dataset_id"), F.concat(F.lit("v"), "o_orderkey").alias("version_id"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "passed").otherwise("failed").alias("validation_status"))


@query("q8_approved_version", f"WITH {_VERSIONS} SELECT dataset_id, version_id, CASE WHEN version_id = 'v3' THEN 'active' WHEN status = 'active' AND dataset_id = (SELECT dataset_id FROM v WHERE version_id = 'v3') THEN 'archived' ELSE status END AS status FROM v")
def q8(spark, d):
    return sinks.approved(_versions(spark, d), "v3").select("dataset_id", "version_id", "status")


@query("q8_rolled_back", f"WITH {_VERSIONS} SELECT dataset_id, version_id, CASE WHEN version_id = 'v6' THEN 'active' WHEN dataset_id = (SELECT dataset_id FROM v WHERE version_id = 'v6') THEN 'archived' ELSE status END AS status FROM v")
def q8b(spark, d):
    return sinks.rolled_back(_versions(spark, d), "v6").select("dataset_id", "version_id", "status")


@query("q9_classification", "SELECT n_nationkey, substr('ABCDE', n_nationkey % 5 + 1, 1) AS classification FROM nation WHERE n_nationkey % 5 = 4")
def q9(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.substring(F.lit("ABCDE"), F.col("n_nationkey") % 5 + 1, F.lit(1)).alias("classification"))
    return sinks.provenance_errors(rows)


_KM = "6371.0088::DOUBLE * 2 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query("j10_facility_matches", f"""WITH RECURSIVE a AS (SELECT s_suppkey AS place_id, 'clinic' || ltrim(replace(s_name, 'Supplier#', ''), '0') AS name, 33 + (s_suppkey % 400)::DOUBLE / 1000 AS lat, 132 + (s_suppkey % 400)::DOUBLE / 1000 AS lon FROM supplier),
  b AS (SELECT c_custkey AS official_id, 'clinic' || ltrim(replace(c_name, 'Customer#', ''), '0') AS name, 33 + (c_custkey % 400)::DOUBLE / 1000 AS lat, 132 + (c_custkey % 400)::DOUBLE / 1000 AS lon FROM customer),
  c AS (SELECT place_id, official_id, 0 AS priority, {_KM} AS km FROM a JOIN b ON contains(a.name, b.name) OR contains(b.name, a.name)), near AS (SELECT *, row_number() OVER (ORDER BY priority, km, place_id, official_id) AS n FROM c WHERE km <= 0.35),
  fold AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS places, []::BIGINT[] AS officials UNION ALL
    SELECT x.n, CASE WHEN list_contains(places, place_id) OR list_contains(officials, official_id) THEN places ELSE list_append(places, place_id) END, CASE WHEN list_contains(places, place_id) OR list_contains(officials, official_id) THEN officials ELSE list_append(officials, official_id) END FROM fold f JOIN near x ON x.n = f.n + 1),
  last AS (SELECT * FROM fold ORDER BY n DESC LIMIT 1), taken AS (SELECT unnest(places) AS place_id, unnest(officials) AS official_id FROM last)
  SELECT place_id, official_id, priority, round(km, 6) AS km FROM taken JOIN near USING (place_id, official_id)""")
def j10(spark, d):
    """Suppliers against customers of a compatible number, near each other; one to one over all."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("official_id"), F.regexp_replace("c_name", "Customer#0*", "Clinic ").alias("name"), F.lit("").alias("short_name"), (33 + F.col("c_custkey") % 400 / 1000.0).alias("lat"), (132 + F.col("c_custkey") % 400 / 1000.0).alias("lon"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.regexp_replace("s_name", "Supplier#0*", "Clinic ").alias("name"), (33 + F.col("s_suppkey") % 400 / 1000.0).alias("lat"), (132 + F.col("s_suppkey") % 400 / 1000.0).alias("lon"))
    return matching.one_to_one(matching.facility_candidates(s, c), ["priority", "km"]).select("place_id", "official_id", "priority", F.round("km", 6).alias("km"))


@query("a2_reachable_population", f"WITH {PAIRS} SELECT destination, round(sum(population), 4) AS total, round(coalesce(sum(population) FILTER (before <= 30), 0), 4) AS r30, round(coalesce(sum(population) FILTER (before <= 60), 0), 4) AS r60, round(coalesce(sum(population) FILTER (before <= 90), 0), 4) AS r90 FROM pairs GROUP BY 1")
def a2(spark, d):
    found = access.reachable_population(I.pairs(spark, d).withColumnRenamed("before", "minutes"), ["destination"])
    return found.select("destination", F.round("total_population", 4).alias("total"), *[F.round(f"reachable_{t}_min", 4).alias(f"r{t}") for t in (30, 60, 90)])


@query("a27_purposes", "SELECT o_orderpriority AS purpose, count(*) AS records, round(sum(o_totalprice), 4) AS demand FROM orders GROUP BY 1")
def a27(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderpriority").alias("purpose"), F.col("o_totalprice").alias("demand"))
    return demand.purposes(records).withColumn("demand", F.round("demand", 4))


@query("j15_paired_series", f"WITH {_LINKS} SELECT edge_id, round(model - observed, 4) AS difference FROM links")
def j15(spark, d):
    """Two series of one length, by link; other lengths are an error."""
    links = _links(spark, d)
    met = demand.paired(links.select("edge_id", "model"), links.select("edge_id", "observed"), "edge_id")
    return met.select("edge_id", F.round(F.col("model") - F.col("observed"), 4).alias("difference"))


@query("q3_registry_counts", "SELECT n_regionkey AS kind, 5 AS expected, count(*) AS found FROM nation WHERE n_nationkey <> 3 GROUP BY 1 HAVING count(*) <> 5")
def q3(spark, d):
    """Registries that do not have the number of rows that is known of them."""
    n = table(spark, d, "nation").filter("n_nationkey <> 3").select(F.col("n_regionkey").alias("kind"))
    known = table(spark, d, "region").select(F.col("r_regionkey").alias("kind"), F.lit(5).alias("expected"))
    return access.count_errors(n, "kind", known)


@query("j8_nearest_node", f"""WITH {ZONES}, {FACILITIES}, n AS (SELECT printf('n:%.7f:%.7f', lat, lon) AS node, printf('%.7f', lat)::DOUBLE AS lat, printf('%.7f', lon)::DOUBLE AS lon FROM facilities)
  SELECT zone_id, arg_min(node, (pow(z.lat - n.lat, 2) + pow(z.lon - n.lon, 2), node)) AS node FROM zones z, n GROUP BY 1""")
def j8(spark, d):
    nodes = I.facilities(spark, d).select(S.node_key(F.col("lat"), F.col("lon")).alias("node")).distinct()
    return spatial.nearest_by_degrees(I.zones(spark, d).withColumnRenamed("zone_id", "point_id"), nodes).select(F.col("point_id").alias("zone_id"), "node")


@query("k6_change_features", f"""WITH {PAIRS} SELECT zone_id::VARCHAR AS id, round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS delta, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pairs""")
def k6(spark, d):
    """Written as features and read back."""
    f = sinks.change_features(I.pairs(spark, d), "zone_id")
    kind = "properties struct<before:double,after:double,delta:double>, geometry struct<type:string,coordinates:array<double>>"
    f = f.select("id", F.from_json("feature", kind).alias("f"))
    return f.select("id", "f.properties.*", F.round(F.col("f.geometry.coordinates")[1], 6).alias("lat"), F.round(F.col("f.geometry.coordinates")[0], 6).alias("lon"))


@query("f29_route_names", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_name END, CASE WHEN n_nationkey % 2 > 0 THEN 'short' END, n_nationkey::VARCHAR) AS name FROM nation")
def f29(spark, d):
    n = table(spark, d, "nation")
    routes = n.select("n_nationkey", F.col("n_nationkey").cast("string").alias("route_id"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).otherwise("").alias("route_long_name"), F.when(F.col("n_nationkey") % 2 > 0, "short").alias("route_short_name"))
    return routes.select("n_nationkey", timetable.route_name(routes).alias("name"))


@query("f30_named_routes", "SELECT n_nationkey::VARCHAR AS route_id FROM nation WHERE contains(n_name, '1')")
def f30(spark, d):
    return timetable.named_routes(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("route_id"), F.col("n_name").alias("route_long_name")), "1")


@query("j11_registry_matches")
def j11(spark, d):
    """Parts as a registry of two kinds, and as places with names spelled another way: who is who, unless two places are too alike."""
    word = F.translate(F.md5((F.col("p_partkey") / 2).cast("long").cast("string")), "0123456789", "ghijklmnop")
    name, key = F.concat_ws(" ", F.substring(word, 1, 12), "p_name"), F.col("p_partkey")
    parts = table(spark, d, "part").select(key, name.alias("name"), F.concat_ws("-", "p_brand", "p_size").alias("address"))
    official = parts.select((key % 2).cast("int").alias("kind_order"), key.alias("row"), key.alias("official_id"), "name", "address")
    spelled = F.when(key % 5 == 1, F.upper("name")).when(key % 5 == 2, F.concat(F.lit("old "), "name")).when(key % 5 == 3, F.concat(F.substring("name", 1, 6), F.lit("x"), F.substring("name", 7, 99))).when(key % 5 == 4, F.expr("left(name, length(name) - 1)")).otherwise(F.col("name"))
    places = parts.select(key.alias("place_id"), spelled.alias("name"), "address")
    return matching.unambiguous(matching.registry_scores(official, places)).select("official_id", "place_id", F.round("score", 6).alias("score"), "quality")


@query("q1_feed_contract", f"""WITH {RIDES},
  st AS (SELECT day, trip_id, user_id, s.ts, e.event_id % 30 AS stop, (seq % 12) AS n, CASE WHEN e.event_id % 97 = 0 THEN '8h' ELSE 'ok' END AS clock FROM stop_times s JOIN events e USING (user_id, ts)),
  days AS (SELECT DISTINCT day FROM st), tr AS (SELECT DISTINCT day, trip_id, user_id FROM st WHERE user_id % 11 <> 0),
  found AS (
    SELECT day, 'stop out of range: ' || n_nationkey AS error FROM days, nation WHERE n_nationkey * 5 > 90 AND n_nationkey <> 7 UNION SELECT day, 'no coordinate: 7' FROM days WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7)
    UNION SELECT day, 'trip without route: ' || trip_id FROM tr WHERE user_id % 6 = 5 UNION SELECT day, 'stop time without trip: ' || trip_id FROM st WHERE user_id % 11 = 0
    UNION SELECT day, 'stop time without stop: ' || stop FROM st WHERE stop NOT IN (SELECT n_nationkey FROM nation)
    UNION SELECT day, 'stop time that does not parse: ' || trip_id || '/' || stop FROM st WHERE clock <> 'ok' UNION SELECT day, 'repeated stop time: ' || trip_id || '/' || n FROM st GROUP BY day, trip_id, n HAVING count(*) > 1
    UNION SELECT day, 'missing column: routes.txt/route_type' FROM days)
  SELECT day::VARCHAR AS feed, error FROM found""")
def q1_contract(spark, d):
    """A zipped feed for each service day, written from the tables, read back and checked."""
    e, n = table(spark, d, "events"), table(spark, d, "nation")
    rows = e.select(F.to_date("ts").cast("string").alias("feed"), "user_id", "event_id", "ts").withColumn("trip_id", F.concat_ws(":", "user_id", "feed"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("trip_id").orderBy("ts", "event_id")))
    clock = F.when(F.col("event_id") % 97 == 0, "8h").otherwise(F.date_format("ts", "HH:mm:ss"))
    days = rows.select("feed").distinct()
    tables = {
        "agency.txt": days.select("feed", F.lit("a").alias("agency_id")),
        "stops.txt": days.crossJoin(n).select("feed", F.col("n_nationkey").alias("stop_id"), F.col("n_name").alias("stop_name"), (F.col("n_nationkey") * 5).alias("stop_lat"), F.when(F.col("n_nationkey") == 7, "x").otherwise("132.5").alias("stop_lon")),
        "routes.txt": days.crossJoin(spark.range(5)).select("feed", F.concat(F.lit("r"), "id").alias("route_id"), F.lit("R").alias("route_short_name")),
        "trips.txt": rows.filter("user_id % 11 <> 0").select("feed", F.concat(F.lit("r"), F.col("user_id") % 6).alias("route_id"), F.lit("w").alias("service_id"), "trip_id").distinct(),
        "stop_times.txt": rows.select("feed", "trip_id", clock.alias("arrival_time"), clock.alias("departure_time"), (F.col("event_id") % 30).alias("stop_id"), (F.col("seq") % 12).alias("stop_sequence")),
    }
    path = new_folder(spark)
    feeds.write_feeds(path, tables)
    feed = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    cells = network.settled(feeds.read_feeds(spark, path, members=tuple(timetable.FEED_COLUMNS)))
    found = timetable.contract_errors(cells, cells.select("path").distinct())
    return found.select(feed.alias("feed"), "error")


# A way is an order, its points are the order's lines; tags follow from the order's key.
_WAYS_SQL = """pts AS (SELECT l_orderkey AS id, row_number() OVER w - 1 AS i, 33 + (l_suppkey * 37 % 1000) / 1000.0::DOUBLE AS lat, 132 + (l_partkey * 13 % 1000) / 1000.0::DOUBLE AS lon,
    lead(33 + (l_suppkey * 37 % 1000) / 1000.0::DOUBLE) OVER w AS lat2, lead(132 + (l_partkey * 13 % 1000) / 1000.0::DOUBLE) OVER w AS lon2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
  seg AS (SELECT *, greatest(0.001::DOUBLE, 6371.0088::DOUBLE * 2 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))) AS km FROM pts WHERE lat2 IS NOT NULL)"""


def _ways(spark, d):
    key, line = F.col("l_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", (33 + F.col("l_suppkey") * 37 % 1000 / 1000.0).alias("lat"), (132 + F.col("l_partkey") * 13 % 1000 / 1000.0).alias("lon"))
    rows = table(spark, d, "lineitem").groupBy(key.alias("id")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"))
    nth = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % n + 1).cast("int"))
    tags = {"highway": nth(5, "primary", "secondary_link", "residential", "track", "motorway"), "oneway": nth(6, "yes", "-1", "no", "", "x", "y"), "maxspeed": nth(4, "40 mph", "none", "", "-")}
    tags |= {"lanes": nth(3, "2; 3", "", "many"), "foot": nth(8, "no", *["yes"] * 7), "access": nth(9, "private", *["yes"] * 8)}
    return rows.select(F.lit("way").alias("type"), "id", F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]).alias("tags"), "geometry")


@query("g1_road_graph", f"""WITH {_WAYS_SQL}, tagged AS (SELECT *, CASE WHEN id % 4 = 0 THEN 40.0 ELSE [50.0, 40.0, 25.0, 40.0, 80.0][id % 5 + 1] END::DOUBLE AS speed_kmh, CASE WHEN id % 3 = 0 THEN 2.0 ELSE [2.0, 1.0, 1.0, 1.0, 2.0][id % 5 + 1] END::DOUBLE * 650 AS capacity FROM seg),
  ways AS (SELECT *, unnest(CASE id % 6 WHEN 0 THEN ['fwd'] WHEN 1 THEN ['rev'] ELSE ['fwd', 'rev'] END) AS way, printf('n:%.7f:%.7f', lat, lon) AS a, printf('n:%.7f:%.7f', lat2, lon2) AS b FROM tagged)
  SELECT 'osm:' || id || ':' || i || ':' || way AS edge_id, CASE way WHEN 'fwd' THEN a ELSE b END AS u, CASE way WHEN 'fwd' THEN b ELSE a END AS v, round(km, 6) AS length_km, speed_kmh, capacity, round(km / speed_kmh * 60, 6) AS minutes FROM ways""")
def g1(spark, d):
    return network.road_edges(_ways(spark, d)).withColumns({"length_km": F.round("length_km", 6), "minutes": F.round("minutes", 6)})


@query("g2_walk_graph", f"""WITH {_WAYS_SQL}, ways AS (SELECT *, unnest(['f', 'r']) AS way, printf('w:%.7f:%.7f', lat, lon) AS a, printf('w:%.7f:%.7f', lat2, lon2) AS b FROM seg WHERE id % 5 <> 4 AND id % 8 <> 0 AND id % 9 <> 0)
  SELECT 'walk:' || id || ':' || i || ':' || way AS edge_id, CASE way WHEN 'f' THEN a ELSE b END AS u, CASE way WHEN 'f' THEN b ELSE a END AS v, round(km, 6) AS length_km, round(km / 4.8::DOUBLE * 60, 6) AS minutes FROM ways""")
def g2(spark, d):
    return network.walk_edges(_ways(spark, d)).withColumns({"length_km": F.round("length_km", 6), "minutes": F.round("minutes", 6)})
