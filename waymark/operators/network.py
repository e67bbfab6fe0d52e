"""Street graphs, shortest paths in buckets of cost, and traffic assignment.

Edges: edge_id, u, v, minutes, and further columns.  Loops write their state
to the checkpoint folder, so executors may come and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import WALK_KMH, bpr_minutes, first_number, free_flow_minutes, haversine_km, node_key
from . import trees
from .tables import settled

# Speeds (km/h) and lanes by class of road, and what nobody walks on.
SPEEDS = {"motorway": 80.0, "trunk": 60.0, "primary": 50.0, "secondary": 40.0, "tertiary": 30.0, "residential": 25.0}
LANES = {"motorway": 2, "trunk": 2, "primary": 2, "secondary": 1, "tertiary": 1, "residential": 1}
NOT_WALKED = ("motorway", "motorway_link", "construction", "proposed")
LANE_CAPACITY, LEAST_KM, BETTER = 650.0, 0.001, 1e-12
#: Tables of final labels that are read side by side, at most; then they become one.
MOST_TABLES = 16


def segments(ways: DataFrame) -> DataFrame:
    """(id, tags, index, a, b): each two points of a way that follow each other."""
    points = F.col("geometry")
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return ways.filter((F.col("type") == "way") & (F.size("geometry") >= 2)).select("id", "tags", F.posexplode(pairs).alias("index", "p")).select("id", "tags", "index", "p.a", "p.b")


def _measured(rows: DataFrame, prefix: str) -> DataFrame:
    km = F.greatest(haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), F.lit(LEAST_KM))
    return rows.withColumns({"u": node_key(F.col("a.lat"), F.col("a.lon"), prefix), "v": node_key(F.col("b.lat"), F.col("b.lon"), prefix), "length_km": km})


def road_edges(ways: DataFrame) -> DataFrame:
    """Directed edges of a road map: both ways unless the way is one-way, forward or reverse."""
    rows = _measured(segments(ways), "n").withColumn("highway", F.coalesce(F.col("tags")["highway"], F.lit("road")))
    base = F.regexp_replace("highway", "_link$", "")
    of = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[base]
    speed = F.coalesce(F.nullif(first_number(F.col("tags")["maxspeed"], -1.0), F.lit(-1.0)), of(SPEEDS), F.lit(SPEEDS["secondary"]))
    lanes = F.greatest(F.lit(1.0), F.coalesce(F.nullif(first_number(F.col("tags")["lanes"], -1.0), F.lit(-1.0)), of(LANES).cast("double"), F.lit(1.0)))
    oneway = F.lower(F.coalesce(F.col("tags")["oneway"], F.lit("")))
    way = F.when(oneway == "-1", F.array(F.lit("rev"))).when(oneway.isin("yes", "1", "true"), F.array(F.lit("fwd"))).otherwise(F.array(F.lit("fwd"), F.lit("rev")))
    rows = rows.withColumns({"speed_kmh": speed, "capacity": lanes * LANE_CAPACITY}).withColumn("way", F.explode(way))
    forward = F.col("way") == "fwd"
    return rows.select(
        F.concat_ws(":", F.lit("osm"), "id", "index", "way").alias("edge_id"), F.when(forward, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("v"),
        "length_km", "speed_kmh", "capacity", free_flow_minutes(F.col("length_km"), F.col("speed_kmh")).alias("minutes"),
    )


def walk_edges(ways: DataFrame) -> DataFrame:
    """Edges for walking, always both ways; nothing where nobody may walk."""
    tag = lambda k: F.lower(F.coalesce(F.col("tags")[k], F.lit("")))
    open_ = ways.filter(F.col("tags")["highway"].isNotNull() & ~F.col("tags")["highway"].isin(*NOT_WALKED) & ~tag("access").isin("no", "private") & (tag("foot") != "no"))
    rows = _measured(segments(open_), "w").withColumn("way", F.explode(F.array(F.lit("f"), F.lit("r"))))
    forward = F.col("way") == "f"
    return rows.select(
        F.concat_ws(":", F.lit("walk"), "id", "index", "way").alias("edge_id"), F.when(forward, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("v"),
        "length_km", (F.col("length_km") / WALK_KMH * 60).alias("minutes"),
    ).dropDuplicates(["edge_id"])


def graph_errors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(error) of edges: lengths, speeds, capacities, and ends that are no node."""
    say = lambda cond, text: F.when(cond, F.concat(F.lit(text), F.col("edge_id")))
    own = edges.select(F.explode(F.array_compact(F.array(say(F.col("length_km") <= 0, "length: "), say(F.col("speed_kmh") <= 0, "speed: "), say(F.col("capacity") < 0, "capacity: ")))).alias("error"))
    ends = edges.select("edge_id", F.explode(F.array("u", "v")).alias("node")).join(nodes, "node", "left_anti").select(F.concat(F.lit("end: "), F.col("edge_id")).alias("error"))
    twice = edges.groupBy("edge_id").count().filter("count > 1").select(F.concat(F.lit("repeated: "), F.col("edge_id")).alias("error"))
    return own.unionByName(ends).unionByName(twice).distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, cost: Column | None = None, most: float = float("inf"), width: float | None = None, rounds: int = 10_000) -> DataFrame:
    """(source, node, minutes, via): least costs from each source, ``most`` at the most; via is the last edge.

    ``sources``: node, and most where each source has a bound of its own.
    A graph of up to ``trees.MOST_ARCS`` arcs is sent to tasks that take some
    sources each.  Else delta-stepping: the open labels less than ``width`` (by default 32 mean
    costs) above the least one are relaxed until none improves, then they are
    final and only looked up by what is reached later.  A round joins and
    writes the open labels, the strip between what is final and what is
    unknown, never all.  Edges with null, negative or infinite cost are closed.
    """
    arcs = _arcs(edges, cost)
    if arcs.count() <= trees.MOST_ARCS:
        bound = F.least(F.col("most"), F.lit(most)) if "most" in sources.columns else F.lit(most)
        return trees.paths(arcs, sources.select("node", bound.alias("most")).distinct())
    width = width or 32 * (arcs.agg(F.avg("cost")).first()[0] or 1.0)
    bound = F.least(F.col("most"), F.lit(most)) if "most" in sources.columns else F.lit(most)
    labels = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("minutes"), F.lit(None).cast("string").alias("via"), bound.alias("most")).distinct()
    open_ = settled(labels.withColumn("fresh", F.lit(True)))
    final: list[DataFrame] = []
    for _ in range(rounds):
        low, fresh = open_.agg(F.min("minutes"), F.min(F.when(F.col("fresh"), F.col("minutes")))).first()
        if low is None:
            done = _union(final) if final else open_
            return done.select("source", "node", "minutes", "via")
        if fresh is None or fresh >= low + width:
            ripe = F.col("minutes") < low + width
            final.append(settled(open_.filter(ripe).drop("fresh")))
            final = [settled(_union(final))] if len(final) > MOST_TABLES else final
            open_ = settled(open_.filter(~ripe))
            continue
        front = open_.filter(F.col("fresh") & (F.col("minutes") < low + width))
        reached = front.join(arcs, front["node"] == arcs["u"]).withColumn("to", F.col("minutes") + F.col("cost")).filter(F.col("to") <= F.col("most"))
        reached = reached.groupBy("source", F.col("v").alias("node"), "most").agg(F.min(F.struct(F.col("to").alias("minutes"), F.col("edge_id").alias("via"))).alias("n"))
        if final:
            reached = settled(reached)
            known = _union(final).join(reached.select("source", "node"), ["source", "node"], "left_semi").select("source", "node")
            reached = reached.join(known, ["source", "node"], "left_anti")
        met = open_.join(reached, ["source", "node", "most"], "full")
        better = F.coalesce(F.col("n.minutes") < F.col("minutes") - BETTER, F.col("minutes").isNull())
        still = F.col("fresh") & (F.col("minutes") >= low + width)
        told = lambda c: F.when(better, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
        open_ = settled(met.select("source", "node", told("minutes"), told("via"), "most", F.coalesce(better | still, F.lit(False)).alias("fresh")))
    raise RuntimeError("shortest paths did not settle")


def _arcs(edges: DataFrame, cost: Column | None) -> DataFrame:
    """(edge_id, u, v, cost) of the edges that are open, written once."""
    known = edges.select("edge_id", "u", "v", (F.col("minutes") if cost is None else cost).alias("cost"))
    return settled(known.filter((F.col("cost") >= 0) & (F.col("cost") < float("inf")) & F.col("u").isNotNull() & F.col("v").isNotNull()))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def walks_between(edges: DataFrame, stops: DataFrame, most: float) -> DataFrame:
    """(from_stop, to_stop, minutes): least walks between different stops, ``most`` minutes at the most; ``stops``: stop_id, node.

    Stops at one node are no distance apart; each node is searched from once.
    """
    paths = shortest_paths(edges, stops.select("node").distinct(), most=most)
    from_, to = stops.select(F.col("stop_id").alias("from_stop"), F.col("node").alias("source")), stops.select(F.col("stop_id").alias("to_stop"), "node")
    return paths.join(to, "node").join(from_, "source").filter("from_stop <> to_stop").select("from_stop", "to_stop", "minutes")


def isochrone(paths: DataFrame, most: float) -> DataFrame:
    return paths.filter(F.col("minutes") <= most)


def all_or_nothing(edges: DataFrame, demand: DataFrame, cost: Column | None = None, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(edge_id, volume) with all demand on shortest paths, and (unreachable) summed.

    A graph of up to ``trees.MOST_ARCS`` arcs is sent to tasks that take some
    origins each.  Else sums over what lies behind each node of the paths'
    trees, in as many rounds as the longest path has binary digits.
    """
    every, arcs = edges.select("edge_id"), _arcs(edges, cost)
    if arcs.count() <= trees.MOST_ARCS:
        found = settled(trees.loads(arcs, demand.filter(F.col("value") > 0).select("origin", "destination", "value")))
        lost = found.filter("edge_id is null").agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("unreachable"))
        volumes = found.filter("edge_id is not null").groupBy("edge_id").agg(F.sum("volume").alias("volume"))
        return every.join(volumes, "edge_id", "left").select("edge_id", F.coalesce("volume", F.lit(0.0)).alias("volume")), lost
    wanted = demand.filter(F.col("value") > 0).groupBy("origin", "destination").agg(F.sum("value").alias("value"))
    tree = settled(shortest_paths(edges, wanted.select(F.col("origin").alias("node")).distinct(), cost))
    lost = wanted.join(tree, (F.col("origin") == F.col("source")) & (F.col("destination") == F.col("node")), "left_anti").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("unreachable"))
    loads = _subtree_sums(tree, edges, wanted, rounds).groupBy(F.col("via").alias("edge_id")).agg(F.sum("value").alias("volume"))
    return every.join(loads, "edge_id", "left").select("edge_id", F.coalesce("volume", F.lit(0.0)).alias("volume")), lost


def _subtree_sums(tree: DataFrame, edges: DataFrame, wanted: DataFrame, rounds: int) -> DataFrame:
    """(via, value) for each node of each tree: what goes through its last edge, to it and to all that lies behind it.

    Path doubling: a node knows the sum of the nodes behind it within 2**k
    edges, and its ancestor 2**k edges before it; both double in a round.
    """
    value = wanted.select(F.col("origin").alias("source"), F.col("destination").alias("node"), "value")
    parent = edges.select(F.col("edge_id").alias("via"), F.col("u").alias("before"))
    state = tree.join(parent, "via", "left").join(value, ["source", "node"], "left").select("source", "node", "via", "before", F.coalesce("value", F.lit(0.0)).alias("value"))
    for _ in range(rounds):
        state = settled(state)
        linked = state.filter("before is not null")
        if linked.isEmpty():
            return state.filter("via is not null").select("via", "value")
        sums = linked.groupBy("source", F.col("before").alias("node")).agg(F.sum("value").alias("more"))
        ahead = state.select("source", F.col("node").alias("before"), F.col("before").alias("next"))
        state = state.join(sums, ["source", "node"], "left").join(ahead, ["source", "before"], "left").select("source", "node", "via", F.col("next").alias("before"), (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))
    raise RuntimeError("paths have circles")


def user_equilibrium(edges: DataFrame, demand: DataFrame, iterations: int = 25, still: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Successive averages of all-or-nothing loads under congested times; (edge_id, volume), and what is unreachable."""
    edges, demand = settled(edges), settled(demand)
    volumes, lost = edges.select("edge_id", F.lit(0.0).alias("volume")), None
    for n in range(1, iterations + 1):
        state = edges.join(volumes, "edge_id")
        loads, lost = all_or_nothing(state, demand, bpr_minutes(F.col("minutes"), F.col("volume"), F.col("capacity")))
        both = settled(state.select("edge_id", F.col("volume").alias("old")).join(loads, "edge_id").select("edge_id", "old", (F.col("old") + (F.col("volume") - F.col("old")) / n).alias("volume")))
        volumes = both.select("edge_id", "volume")
        if both.agg(F.max(F.abs(F.col("volume") - F.col("old")))).first()[0] <= still:
            break
    return volumes, lost


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Edges by their id, as files and reports list them."""
    return edges.orderBy("edge_id")


def road_features(elements: DataFrame) -> DataFrame:
    """(id, feature): a JSON line feature of each element with two points at least, whatever its type."""
    points = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    key = F.concat_ws(":", F.lit("osm"), "id")
    shape = F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))
    told = F.struct(F.lit("Feature").alias("type"), key.alias("id"), F.struct(F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name")).alias("properties"), shape.alias("geometry"))
    return elements.filter(F.size("geometry") >= 2).select(key.alias("id"), F.to_json(told).alias("feature"))
