"""Further queries: contracts, closures, contexts, and what combines other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import access, network, ranking, spatial, timetable
from ..sources import places, sinks, versions
from ..streaming.events import per_window
from . import inputs as I
from .inputs import FACILITIES, PAIRS, RIDES, SLOTS, ZONES, table
from .queries import _DAY_RANKS, _LINKS, _ROADS, _links, _roads, query


@query("a3_accessibility_loss", f"""WITH {PAIRS}, r AS (SELECT destination, coalesce(sum(population) FILTER (before <= 60), 0) AS a, coalesce(sum(population) FILTER (after <= 60), 0) AS b FROM pairs GROUP BY 1)
  SELECT destination, round(a - b, 4) AS loss, round(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 6) AS loss_pct FROM r""")
def a3(spark, d):
    p = I.pairs(spark, d)
    reach = lambda c: access.reachable_population(p.withColumn("minutes", F.col(c)), ["destination"])
    found = access.accessibility_loss(reach("before"), reach("after"), ["destination"])
    return found.select("destination", F.round("loss_60_min", 4).alias("loss"), F.round("loss_pct_60_min", 6).alias("loss_pct"))


@query("a10_age_context", """WITH r AS (SELECT c_nationkey AS region, count(*) AS total, count(*) FILTER (c_custkey % 100 >= 65) AS a, count(*) FILTER (c_custkey % 100 >= 75) AS b, count(*) FILTER (c_custkey % 100 >= 85) AS c FROM customer GROUP BY 1)
  SELECT count(*) AS regions, sum(total)::DOUBLE AS population, sum(a)::DOUBLE AS population_65plus, sum(b)::DOUBLE AS population_75plus, sum(c)::DOUBLE AS population_85plus,
  round(100.0::DOUBLE * sum(a) / sum(total), 3) AS share_65plus_pct, round(100.0::DOUBLE * sum(b) / sum(total), 3) AS share_75plus_pct, round(100.0::DOUBLE * sum(c) / sum(total), 3) AS share_85plus_pct FROM r""")
def a10(spark, d):
    """Customers counted into age bands by region, as the official table has them: text, one column a band."""
    bands = {"0-64歳の男性": (0, 64), "65-74歳の女性": (65, 74), "75-84歳の男性": (75, 84), "85歳以上の女性": (85, 99)}
    c = table(spark, d, "customer").withColumn("age", F.col("c_custkey") % 100)
    counts = [F.format_number(F.count(F.when(F.col("age").between(*b), 1)), 0).alias(name) for name, b in bands.items()]
    rows = c.groupBy(F.col("c_nationkey").cast("string").alias(places.AGE_CODE)).agg(F.format_number(F.count("*"), 0).alias(places.AGE_TOTAL), *counts)
    return places.age_context(rows)


@query("a15_nearest_of_kind", f"""WITH {ZONES}, {FACILITIES} SELECT zone_id, kind, round(min(6371.0088::DOUBLE * 2 * asin(sqrt(pow(sin(radians(f.lat - z.lat) / 2), 2) + cos(radians(z.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - z.lon) / 2), 2))) / 4.8::DOUBLE * 60), 6) AS minutes
  FROM zones z, facilities f GROUP BY ALL""")
def a15(spark, d):
    """Each zone with every kind of facility; rings of no cells, so the nearest of all of that kind."""
    f = I.facilities(spark, d)
    z = I.zones(spark, d).select(F.col("zone_id").alias("point_id"), "lat", "lon").crossJoin(f.select("kind").distinct())
    found = spatial.nearest(z, f, rings=-1, by=("kind",))
    return found.select(F.col("point_id").alias("zone_id"), "kind", F.round(S.walk_minutes(F.col("km")), 6).alias("minutes"))


@query("a18_road_access", f"""WITH {PAIRS} SELECT destination, count(*) FILTER (after > before + 1e-9 OR (before IS NOT NULL AND after IS NULL)) AS worse, round(coalesce(sum(population) FILTER (after > before + 1e-9 OR (before IS NOT NULL AND after IS NULL)), 0), 4) AS worse_population,
  round(avg(after - before), 6) AS mean_change, round(coalesce(sum(population) FILTER (after <= 60), 0), 4) AS reach_60 FROM pairs GROUP BY 1""")
def a18(spark, d):
    return access.road_access(I.pairs(spark, d), ["destination"])


@query("a23_boundary_conditions", f"WITH {_DAY_RANKS} SELECT id, string_agg(DISTINCT case_id, ',' ORDER BY case_id) AS cases, count(DISTINCT case_id) AS n FROM ranks WHERE rank > 3 GROUP BY 1")
def a23(spark, d):
    low = ranking.day_ranking(I.slots(spark, d), ["case_id"]).filter("rank > 3")
    return low.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("case_id")), ",").alias("cases"), F.countDistinct("case_id").alias("n"))


@query("a26_affected_inclusive", f"WITH {PAIRS} SELECT destination, threshold, round(coalesce(sum(population) FILTER (after - before >= threshold), 0), 4) AS affected FROM pairs, (VALUES (1), (5), (10)) t(threshold) GROUP BY ALL")
def a26(spark, d):
    return access.affected_from(I.pairs(spark, d), ["destination"])


@query("f9_facility_names", r"SELECT p_partkey, regexp_replace(lower(p_name || ' (' || p_type || ') - x.'), '[\s・･,，.。()（）\-ー]', '', 'g') AS name FROM part")
def f9(spark, d):
    return table(spark, d, "part").select("p_partkey", T.facility_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") - x."))).alias("name"))


@query("f13_compatible_names", "SELECT p_partkey, p_name = p_type OR contains(p_name, substr(p_name, 1, 5)) AND p_partkey % 3 = 0 AS ok FROM part")
def f13(spark, d):
    short = F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 1, 5)).otherwise("")
    return table(spark, d, "part").select("p_partkey", T.compatible_names(F.col("p_name"), F.col("p_type"), short).alias("ok"))


@query("j6_without_closed", f"WITH {_ROADS} SELECT u, count(*) AS edges, round(min(minutes), 6) AS least FROM roads WHERE edge_id NOT IN (SELECT edge_id FROM roads WHERE v % 6 = 0) GROUP BY 1")
def j6(spark, d):
    edges = _roads(spark, d)
    closed = edges.filter("v % 6 = 0").select("edge_id").toDF("edge_id")
    return edges.join(closed, "edge_id", "left_anti").groupBy("u").agg(F.count("*").alias("edges"), F.round(F.min("minutes"), 6).alias("least"))


@query("j12_zone_contract", f"WITH {ZONES}, o AS (SELECT o_custkey AS zone_id, any_value(1) AS one, sum(o_totalprice) AS spent, max(o_totalprice) AS most FROM orders GROUP BY 1) SELECT count(*) FILTER (one IS NULL) AS missing, 0 AS repeated, count(*) FILTER (population < spent OR spent < most) AS not_nested FROM zones LEFT JOIN o USING (zone_id)")
def j12(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("zone_id")).agg(F.sum("o_totalprice").alias("spent"), F.max("o_totalprice").alias("most"))
    return access.zone_contract_errors(I.zones(spark, d).select("zone_id", "population"), o, ("population", "spent", "most"))


@query("j13_common_links", f"WITH {_LINKS} SELECT count(*) AS common, round(sum(m.model), 4) AS model, round(sum(o.observed), 4) AS observed FROM links m JOIN links o ON m.edge_id = o.edge_id WHERE m.length_km < 4 AND o.length_km >= 1")
def j13(spark, d):
    links = _links(spark, d)
    m, o = links.filter("length_km < 4").select("edge_id", "model"), links.filter("length_km >= 1").select("edge_id", "observed")
    return m.join(o, "edge_id").agg(F.count("*").alias("common"), F.round(F.sum("model"), 4).alias("model"), F.round(F.sum("observed"), 4).alias("observed"))


_STOP_WALK = "walk AS (SELECT n_nationkey AS stop, s_suppkey AS node, ((n_nationkey * 7 + s_suppkey * 11) % 240)::DOUBLE / 10 AS minutes FROM nation, supplier), nodes AS (SELECT n_nationkey AS stop, n_nationkey AS node FROM nation)"


def _transfer_edges(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    walk = n.crossJoin(s).select(F.col("n_nationkey").alias("stop_id"), F.col("s_suppkey").alias("node"), (((F.col("n_nationkey") * 7 + F.col("s_suppkey") * 11) % 240).cast("double") / 10).alias("minutes"))
    return timetable.transfer_edges(walk, n.select(F.col("n_nationkey").alias("stop_id"), F.col("n_nationkey").cast("long").alias("node")))


@query("j18_transfer_edges", f"WITH {_STOP_WALK} SELECT walk.stop AS from_stop, nodes.stop AS to_stop, minutes AS walk_minutes, minutes + 1 AS transfer_minutes FROM walk JOIN nodes USING (node) WHERE walk.stop <> nodes.stop AND minutes <= 10")
def j18(spark, d):
    return _transfer_edges(spark, d)


@query("a17_transfer_statistics", f"WITH {_STOP_WALK} SELECT count(*) AS edges, round(avg(minutes), 6) AS mean, max(minutes) AS longest FROM walk JOIN nodes USING (node) WHERE walk.stop <> nodes.stop AND minutes <= 10")
def a17(spark, d):
    return _transfer_edges(spark, d).agg(F.count("*").alias("edges"), F.round(F.avg("walk_minutes"), 6).alias("mean"), F.max("walk_minutes").alias("longest"))


@query("u4_equal_sets", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_left, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_right")
def u4(spark, d):
    return access.unlike(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("t1_scan_order", f"WITH {RIDES} SELECT trip_id, seq, row_number() OVER (PARTITION BY day ORDER BY dep, arr, trip_id, seq)::INT AS place FROM rides")
def t1(spark, d):
    c = timetable.connections(I.stop_times(spark, d), I.trips(spark, d)).withColumn("day", F.split("trip_id", ":")[1])
    return timetable.numbered(c, "day", "dep", "arr", "trip_id", "seq").select("trip_id", "seq", F.col("place").cast("int").alias("place"))


@query("t2_top_three", f"WITH {_DAY_RANKS} SELECT case_id, id, rank FROM ranks WHERE rank <= 3")
def t2(spark, d):
    return ranking.day_ranking(I.slots(spark, d), ["case_id"]).filter("rank <= 3").select("case_id", "id", "rank")


@query("x12_equivalence", f"""WITH {SLOTS}, other AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'none' ELSE event_type END AS case_id, hour(ts)::INT * 3600 AS seconds, 'r' || (user_id % 12)::VARCHAR AS id, round(sum(abs(value)), 4) AS affected FROM events GROUP BY ALL)
  SELECT case_id, seconds, id, s.affected AS actual, o.affected AS golden FROM slots s FULL JOIN other o USING (case_id, seconds, id) WHERE abs(s.affected - o.affected) > 1e-3 OR s.affected IS NULL OR o.affected IS NULL""")
def x12(spark, d):
    """What the hours' impacts are with all events, against those of a rule that books some events elsewhere."""
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 13 == 0, "none").otherwise(F.col("event_type")).alias("case_id"), (F.hour("ts") * 3600).alias("seconds"), F.concat(F.lit("r"), F.col("user_id") % 12).alias("id"), "value")
    other = e.groupBy("case_id", "seconds", "id").agg(F.round(F.sum(F.abs("value")), 4).alias("golden"))
    own = I.slots(spark, d).select("case_id", "seconds", "id", F.col("affected").alias("actual"))
    return access.differences(own, other, ["case_id", "seconds", "id"])


def _from_first(roads: str, name: str) -> str:
    """Least times from the first supplier over ``roads``, as ``name``."""
    return f"""{name}(node, minutes) USING KEY (node) AS (SELECT min(s_suppkey), 0::DOUBLE FROM supplier
    UNION SELECT r.v, min(b.minutes + r.minutes) FROM {name} b JOIN {roads} r ON r.u = b.node LEFT JOIN recurring.{name} o ON o.node = r.v WHERE o.minutes IS NULL OR b.minutes + r.minutes < o.minutes - 1e-12 GROUP BY ALL)"""


@query("x13_road_closure", f"""WITH RECURSIVE {_ROADS}, kept AS (SELECT * FROM roads WHERE u % 4 <> 1), {_from_first("roads", "a")}, {_from_first("kept", "b")}
  SELECT a.node, round(a.minutes, 6) AS before, round(b.minutes, 6) AS after FROM a LEFT JOIN b USING (node)""")
def x13(spark, d):
    """Times from one supplier, before and after some roads are closed."""
    edges = _roads(spark, d)
    source = table(spark, d, "supplier").agg(F.min("s_suppkey").alias("node"))
    before = network.shortest_paths(edges, source).select("node", F.round("minutes", 6).alias("before"))
    after = network.shortest_paths(edges.filter("u % 4 <> 1"), source).select("node", F.round("minutes", 6).alias("after"))
    return before.join(after, "node", "left")


@query("x14_scenarios", "SELECT n_nationkey, n_name AS name, n_regionkey AS links FROM nation")
def x14(spark, d):
    """Scenarios as JSON and back; keys that the schema does not know are dropped."""
    kind = "scenario_id bigint, name string, disabled_links array<string>"
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("scenario_id"), F.col("n_name").alias("name"), F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i < F.col("n_regionkey")), lambda i: i.cast("string")).alias("disabled_links"), F.lit(1).alias("unknown"))
    s = n.select(F.from_json(F.to_json(F.struct("*")), kind).alias("s"))
    return s.select(F.col("s.scenario_id").alias("n_nationkey"), "s.name", F.size("s.disabled_links").alias("links"))


@query("x17_direction_stability", f"""WITH {SLOTS}, m AS (SELECT case_id, id, round(avg(mean_change), 6) - 50 AS v FROM slots GROUP BY ALL), s AS (SELECT case_id, id, CASE WHEN v > 0.0005 THEN 'positive' WHEN v < -0.0005 THEN 'negative' ELSE 'neutral' END AS dir FROM m),
  r AS (SELECT id, dir FROM s WHERE case_id = 'error') SELECT id, r.dir AS reference, count(*) AS cases, count(*) FILTER (s.dir = r.dir) AS same FROM s JOIN r USING (id) GROUP BY ALL""")
def x17(spark, d):
    m = I.slots(spark, d).groupBy("case_id", "id").agg((F.round(F.avg("mean_change"), 6) - 50).alias("v")).select("case_id", "id", S.direction(F.col("v")).alias("dir"))
    r = m.filter("case_id = 'error'").select("id", F.col("dir").alias("reference"))
    return m.join(r, "id").groupBy("id", "reference").agg(F.count("*").alias("cases"), F.count(F.when(F.col("dir") == F.col("reference"), 1)).alias("same"))


@query("q2_snap_coverage", f"WITH {PAIRS} SELECT destination, round(avg((before IS NOT NULL)::INT::DOUBLE) * 100, 4) AS covered_pct, avg((before IS NOT NULL)::INT::DOUBLE) >= 0.9 AS enough FROM pairs GROUP BY 1")
def q2(spark, d):
    return access.coverage(I.pairs(spark, d), ["destination"], F.col("before").isNotNull())


@query("q4_golden_differences", f"""WITH {PAIRS}, m AS (SELECT destination, round(sum(population), 4) AS population, round(avg(before), 3) AS mean FROM pairs GROUP BY 1), g AS (SELECT destination, round(sum(population), 4) AS population, round(avg(after), 3) AS mean FROM pairs GROUP BY 1),
  u AS (UNPIVOT m ON population, mean INTO NAME metric VALUE actual), v AS (UNPIVOT g ON population, mean INTO NAME metric VALUE golden) SELECT destination, metric, actual, golden FROM u FULL JOIN v USING (destination, metric) WHERE abs(actual - golden) > 1e-3 OR actual IS NULL OR golden IS NULL""")
def q4(spark, d):
    """Measures of today against those kept from before the disruption."""
    told = lambda c, name: I.pairs(spark, d).groupBy("destination").agg(F.round(F.sum("population"), 4).alias("population"), F.round(F.avg(c), 3).alias("mean")).unpivot("destination", ["population", "mean"], "metric", name)
    return access.differences(told("before", "actual"), told("after", "golden"), ["destination", "metric"])


@query("q5_sweep_contract", f"WITH {SLOTS} SELECT count(DISTINCT case_id) AS cases, count(DISTINCT seconds) AS slots, count(DISTINCT (case_id, seconds)) AS combinations, count(*) AS evaluations FROM slots")
def q5(spark, d):
    s = I.slots(spark, d)
    return s.agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("seconds").alias("slots"), F.countDistinct("case_id", "seconds").alias("combinations"), F.count("*").alias("evaluations"))


@query("events_per_window", "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_per_window(spark, d):
    return per_window(table(spark, d, "events"))


@query("f16_within_bounds", f"WITH {ZONES} SELECT zone_id FROM zones WHERE lat BETWEEN 33.4 AND 33.9 AND lon BETWEEN 132.25 AND 132.75 AND destination = 1")
def f16(spark, d):
    return I.zones(spark, d).filter(F.col("lat").between(33.4, 33.9) & F.col("lon").between(132.25, 132.75) & (F.col("destination") == 1)).select("zone_id")


def _elements(spark, d):
    """Map elements: suppliers as nodes, customers as ways of their orders' keys."""
    point = lambda k: F.struct((33 + F.col(k) % 1000 / 1000.0).alias("lat"), (132 + F.col(k) % 777 / 777.0).alias("lon"))
    kind = lambda k: F.element_at(F.array(F.lit("hospital"), F.lit("clinic"), F.lit("bank")), (F.col(k) % 3 + 1).cast("int"))
    s = table(spark, d, "supplier").select(F.lit("node").alias("type"), F.col("s_suppkey").alias("id"), point("s_suppkey").alias("p"), F.create_map(F.lit("amenity"), kind("s_suppkey"), F.lit("name"), F.col("s_name")).alias("tags"), F.expr("cast(array() as array<struct<lat:double,lon:double>>)").alias("geometry"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey"))).alias("keys"))
    ways = o.select(F.lit("way").alias("type"), F.col("o_custkey").alias("id"), F.create_map(F.lit("amenity"), kind("o_custkey")).alias("tags"), F.transform("keys", lambda k: F.struct((33 + k % 1000 / 1000.0).alias("lat"), (132 + k % 777 / 777.0).alias("lon"))).alias("geometry"))
    return s.select("type", "id", "p.lat", "p.lon", "tags", "geometry").unionByName(ways.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}))


@query("s9_facilities", """WITH e AS (SELECT 'osm:node:' || s_suppkey::VARCHAR AS place_id, s_name AS name, s_suppkey % 3 AS k, 33 + (s_suppkey % 1000)::DOUBLE / 1000 AS lat, 132 + (s_suppkey % 777)::DOUBLE / 777 AS lon FROM supplier
  UNION ALL SELECT 'osm:way:' || o_custkey::VARCHAR, ['hospital', 'clinic', 'bank'][o_custkey % 3 + 1], o_custkey % 3, avg(33 + (o_orderkey % 1000)::DOUBLE / 1000), avg(132 + (o_orderkey % 777)::DOUBLE / 777) FROM orders GROUP BY o_custkey)
  SELECT place_id, name, ['hospital', 'clinic'][k + 1] AS amenity, round(lat, 9) AS lat, round(lon, 9) AS lon FROM e WHERE k < 2""")
def s9(spark, d):
    found = places.facilities(_elements(spark, d))
    return found.select("place_id", "name", "amenity", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("q8_staged", """SELECT p_partkey, p_brand AS dataset_id, sha256(p_name) AS checksum, p_brand || '-' || substr(sha256(p_name), 1, 12) AS version_id,
  CASE WHEN p_size > 5 THEN 'passed' ELSE 'failed' END AS validation_status, CASE WHEN p_size > 5 THEN 'validated' ELSE 'candidate' END AS status FROM part""")
def q8_staged(spark, d):
    files = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("dataset_id"), F.col("p_name").alias("content"), "p_size")
    return versions.staged(files, F.col("p_size") > 5).drop("p_size")


_LOG = """log AS (SELECT 'd' || (l_partkey % 50)::VARCHAR AS dataset_id, 'p' || l_partkey::VARCHAR AS version_id, l_orderkey * 10 + l_linenumber AS "at", ['stage', 'approve', 'stage', 'rollback'][(l_orderkey + l_linenumber) % 4 + 1] AS action,
  CASE WHEN l_partkey % 5 <> 0 THEN 'passed' ELSE 'failed' END AS validation_status FROM lineitem),
seen AS (SELECT *, count(*) FILTER (action = 'stage') OVER (PARTITION BY version_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) > 0 AS known FROM log)"""


def _log(spark, d):
    """Lines of orders as what was done with versions, which are parts."""
    actions = F.array(*map(F.lit, ("stage", "approve", "stage", "rollback")))
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("d"), F.col("l_partkey") % 50).alias("dataset_id"), F.concat(F.lit("p"), "l_partkey").alias("version_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        F.element_at(actions, ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 + 1).cast("int")).alias("action"), F.when(F.col("l_partkey") % 5 != 0, "passed").otherwise("failed").alias("validation_status"),
    )


@query("q8_lifecycle", f"""WITH {_LOG}, done AS (SELECT * FROM seen WHERE action = 'stage' OR known AND validation_status = 'passed'),
  own AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY "at" DESC) = 1), staged AS (SELECT version_id, max("at") AS staged_at FROM done WHERE action = 'stage' GROUP BY 1),
  acts AS (SELECT dataset_id, max("at") AS newest, max("at") FILTER (action = 'rollback') AS back FROM done WHERE action <> 'stage' GROUP BY 1)
  SELECT dataset_id, version_id, staged_at, validation_status, CASE WHEN action <> 'stage' THEN CASE WHEN "at" = newest THEN 'active' ELSE 'archived' END WHEN back > "at" THEN 'archived' WHEN validation_status = 'passed' THEN 'validated' ELSE 'candidate' END AS status
  FROM own JOIN staged USING (version_id) LEFT JOIN acts USING (dataset_id)""")
def q8_lifecycle(spark, d):
    return versions.lifecycle(_log(spark, d))


@query("q8_refused", f"""WITH {_LOG} SELECT dataset_id, version_id, "at", action, CASE WHEN known THEN 'not passed' ELSE 'unknown' END AS reason FROM seen WHERE action <> 'stage' AND NOT (known AND validation_status = 'passed')""")
def q8_refused(spark, d):
    return versions.refused(_log(spark, d))


@query("k7_manifests", """SELECT '1.0.0' AS schema_version, s_name AS artifact_id, substr('ABCD', s_nationkey % 4 + 1, 1) AS classification, 'm' || (s_suppkey % 3)::VARCHAR AS model_version, '{"limit":' || (s_suppkey % 7)::VARCHAR || '}' AS parameters,
  0 AS inputs, s_suppkey % 2 AS limitations, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey END AS random_seed, true AS dated FROM supplier""")
def k7(spark, d):
    artifacts = table(spark, d, "supplier").select(
        F.col("s_name").alias("artifact_id"), F.substring(F.lit("ABCD"), F.col("s_nationkey") % 4 + 1, F.lit(1)).alias("classification"), F.concat(F.lit("m"), F.col("s_suppkey") % 3).alias("model_version"),
        F.struct((F.col("s_suppkey") % 7).alias("limit")).alias("parameters"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).alias("random_seed"), F.when(F.col("s_suppkey") % 2 == 1, F.array(F.lit("sampled"))).alias("limitations"),
    )
    made = sinks.manifest(artifacts)
    dated = F.col("generated_at_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$")
    return made.select("schema_version", "artifact_id", "classification", "model_version", F.to_json("parameters").alias("parameters"), F.size("input_data_versions").alias("inputs"), F.size("limitations").alias("limitations"), "random_seed", dated.alias("dated"))


@query("k9_merged_manifests", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'map,map,' || CASE WHEN s_suppkey % 3 = 1 THEN 'n' ELSE 'rank' END || ',' END || CASE WHEN s_suppkey % 3 = 2 THEN 'n2' ELSE 'rank,n2' END AS capabilities,
  's' || (s_nationkey % 2)::VARCHAR || '.json' || CASE WHEN s_nationkey % 2 = 0 THEN ',s1.json' ELSE '' END AS artifacts, 'A1.12' AS analysis_result_stage, 'A1.13' AS ui_release_stage FROM supplier""")
def k9_merged(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    has = F.when(k == 1, F.array(F.lit("map"), F.lit("map"), F.lit("n"))).when(k == 2, F.array(F.lit("map"), F.lit("map"), F.lit("rank")))
    rows = s.select("s_suppkey", F.lit("A1.12").alias("result_stage"), has.alias("ui_capabilities"), F.array(F.concat(F.lit("s"), F.col("s_nationkey") % 2, F.lit(".json"))).alias("artifacts"))
    merged = sinks.merged_manifests(rows, "A1.12", "A1.13", F.array(F.lit("rank"), F.lit("n2")), F.array(F.lit("s1.json")))
    return merged.select("s_suppkey", F.array_join("ui_capabilities", ",").alias("capabilities"), F.array_join("artifacts", ",").alias("artifacts"), "analysis_result_stage", "ui_release_stage")
