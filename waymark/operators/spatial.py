"""Nearest neighbours by grid cells, and re-aggregation to a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import grid_corner, haversine_km
from .tables import settled

CELL_DEGREES, RINGS = 0.005, 8
#: Kilometres of a degree of latitude.
DEGREE_KM = 111.19
#: Cells around a point that a step with wider cells looks into.
WIDE = 2


def _best(points: DataFrame, places: DataFrame, cell: float, first: int, last: int, by: list[str], nearest_ring: bool) -> DataFrame:
    """(by, point_id, place_id, km, lat) of the best place in rings ``first`` to ``last`` of cells; places are dealt to the cells around them.

    Joins are merges here and below: dealt out, places are many times what Spark takes their size for, and no driver holds them.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    around = F.sequence(F.lit(-last), F.lit(last))
    spread = places.select(*by, "place_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), at("lat").alias("y"), at("lon").alias("x"))
    spread = spread.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).withColumn("ring", F.greatest(F.abs("dy"), F.abs("dx"))).filter(F.col("ring") >= first)
    spread = spread.select(*by, "place_id", "b_lat", "b_lon", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "ring")
    met = points.withColumns({"y": at("lat"), "x": at("lon")}).join(spread.hint("merge"), [*by, "y", "x"])
    met = met.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")))
    order = ["ring", "km", "place_id"] if nearest_ring else ["km", "place_id"]
    return met.groupBy(*by, "point_id").agg(F.min(F.struct(*order)).alias("n"), F.max("lat").alias("lat")).select(*by, "point_id", F.col("n.place_id").alias("place_id"), F.col("n.km").alias("km"), "lat")


def nearest(points: DataFrame, places: DataFrame, cell: float = CELL_DEGREES, rings: int = RINGS, most_km: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, point_id, place_id, km): the nearest place in the first ring of cells that has one, for each point.

    ``points``: point_id, lat, lon; ``places``: place_id, lat, lon; both with
    the columns ``by``, within which places are looked for.  As ever with rings,
    a nearer place beyond the first occupied ring is not seen.  Points without a
    place in ``rings`` rings get the nearest of all places: cells double until
    no place outside of those looked into can be nearer.  Each step asks only
    for points that have none yet.  Points of a ``by`` without any place have no
    row; ``most_km`` leaves out what is farther.
    """
    by, key = list(by), [*by, "point_id"]
    left, done = points.select(*key, "lat", "lon"), []
    for first, last in ((0, 1), (2, rings)):
        if first <= rings:
            done.append(settled(_best(left, places, cell, first, min(last, rings), by, True).drop("lat")))
            left = settled(left.join(done[-1].select(*key).hint("merge"), key, "left_anti"))
    left = left.join(places.select(*by).distinct(), by, "left_semi") if by else left if not places.isEmpty() else left.limit(0)
    while not left.isEmpty():
        cell *= 2
        found = _best(left, places, cell, 0, WIDE, by, False)
        # Whatever is not in these cells differs by WIDE cells at least, in latitude or in longitude.
        safe = F.lit(cell >= 360) | (F.col("km") <= WIDE * cell * DEGREE_KM * F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + (WIDE + 1) * cell))))
        done.append(settled(found.filter(safe).drop("lat")))
        left = settled(left.join(done[-1].select(*key).hint("merge"), key, "left_anti"))
    out = done[0] if done else _best(left, places, cell, 0, 0, by, True).drop("lat")  # nothing to look for, or nowhere
    for part in done[1:]:
        out = out.unionByName(part)
    return out if most_km is None else out.filter(F.col("km") <= most_km)


def nearest_by_degrees(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(point_id, node): the node with the smallest squared difference of degrees, ties to the smaller key; ``nodes`` (node) are keys that hold both coordinates.

    Cells double as in :func:`nearest`, so no point meets all nodes.
    """
    part = lambda k: F.split("node", ":")[k].cast("double")
    places, left, done, cell = settled(nodes.select("node", part(1).alias("b_lat"), part(2).alias("b_lon"))), points.select("point_id", "lat", "lon"), [], CELL_DEGREES
    around = F.sequence(F.lit(-1), F.lit(1))
    while not left.isEmpty() and not places.isEmpty():
        at = lambda c, cell=cell: F.floor(F.col(c) / cell).cast("long")
        spread = places.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).withColumns({"y": at("b_lat") + F.col("dy"), "x": at("b_lon") + F.col("dx")})
        met = left.withColumns({"y": at("lat"), "x": at("lon")}).join(spread.hint("merge"), ["y", "x"])
        square = F.pow(F.col("lat") - F.col("b_lat"), 2) + F.pow(F.col("lon") - F.col("b_lon"), 2)
        best = met.groupBy("point_id").agg(F.min(F.struct(square.alias("d"), "node")).alias("n")).filter((F.col("n.d") <= cell * cell) | F.lit(cell > 720))
        done.append(settled(best.select("point_id", F.col("n.node").alias("node"))))
        left, cell = settled(left.join(done[-1].hint("merge"), "point_id", "left_anti")), cell * 2
    out = points.sparkSession.createDataFrame([], f"point_id {dict(points.dtypes)['point_id']}, node string")
    for part in done:
        out = out.unionByName(part)
    return out


def to_grid(rows: DataFrame) -> DataFrame:
    """Population summed to cells of a tenth of a degree; cells without people are left out."""
    cells = rows.groupBy(grid_corner(F.col("lon")).alias("lon"), grid_corner(F.col("lat")).alias("lat")).agg(F.round(F.sum("population"), 4).alias("population"), F.count("*").alias("zones"))
    return cells.filter("population > 0")


def padded_bounds(points: DataFrame, pad: float = 0.02) -> DataFrame:
    return points.agg((F.min("lat") - pad).alias("south"), (F.min("lon") - pad).alias("west"), (F.max("lat") + pad).alias("north"), (F.max("lon") + pad).alias("east"))
