"""Service days, connections and checks of a timetable."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame, exceptions: DataFrame, day: datetime.date) -> DataFrame:
    """service_id of those that run: weekly ones and added ones, without removed ones.

    Of several exceptions of a service on one day the last row (``row``) counts.
    """
    stamp = f"{day:%Y%m%d}"
    weekly = calendar.filter((F.col(WEEKDAYS[day.weekday()]) == "1") & (F.col("start_date") <= stamp) & (F.col("end_date") >= stamp)).select("service_id")
    last = exceptions.filter(F.col("date") == stamp).groupBy("service_id").agg(F.max(F.struct("row", "exception_type"))["exception_type"].alias("kind"))
    added, removed = last.filter("kind = '1'").select("service_id"), last.filter("kind = '2'").select("service_id")
    return weekly.unionByName(added).distinct().join(removed, "service_id", "left_anti")


def connections(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Elementary rides: each stop of a trip with the next one, by sequence as a number."""
    w = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("int"))
    active = stop_times.join(trips.select("trip_id", "route_id"), "trip_id")
    ride = active.select("trip_id", "route_id", F.col("stop_sequence").cast("int").alias("seq"), F.col("stop_id").alias("from_stop"), F.col("departure").alias("dep"), F.lead("stop_id").over(w).alias("to_stop"), F.lead("arrival").over(w).alias("arr"))
    return ride.filter(F.col("to_stop").isNotNull())


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with place: 1..n within ``by``, in ``order``.

    Rows are dealt by ranges of both, numbered within each part, and start
    where the parts before them end; so one key may hold all rows.
    """
    parts = settled(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    met = parts.withColumn("_nth", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)))
    met = met.join(starts, met[by].eqNullSafe(starts["_by"]) & (met["_part"] == starts["_at"]))
    return met.withColumn("place", F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_by", "_at", "_start")


def feed_errors(stops: DataFrame, trips: DataFrame, routes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(error): what is wrong with a feed, each message once."""
    told = lambda df, text, key: df.select(F.concat(F.lit(text), F.col(key).cast("string")).alias("error"))
    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    wrong = ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    twice = stop_times.groupBy("trip_id", "stop_sequence").count().filter("count > 1").withColumn("key", F.concat_ws("/", "trip_id", "stop_sequence"))
    parts = [
        told(stops.filter(wrong), "stop out of range: ", "stop_id"),
        told(trips.join(routes, "route_id", "left_anti"), "trip without route: ", "trip_id"),
        told(stop_times.join(trips, "trip_id", "left_anti"), "stop time without trip: ", "trip_id"),
        told(stop_times.join(stops, "stop_id", "left_anti"), "stop time without stop: ", "stop_id"),
        told(twice, "repeated stop time: ", "key"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


# The columns that a feed has to have.
FEED_COLUMNS = {
    "stops.txt": ("stop_id", "stop_name", "stop_lat", "stop_lon"), "routes.txt": ("route_id", "route_short_name", "route_type"), "trips.txt": ("route_id", "service_id", "trip_id"),
    "stop_times.txt": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
}
_WHOLE, _CLOCK = r"^\s*[+-]?\d+\s*$", r"^\s*[+]?\d+\s*:\s*[+]?0*[0-5]?\d\s*:\s*[+]?0*[0-5]?\d\s*$"


def contract_errors(cells: DataFrame, feeds: DataFrame) -> DataFrame:
    """(path, error): all that is wrong with each feed, each message once.

    ``cells``: path, member, row, cells, as :func:`feeds.read_feeds` gives them;
    ``feeds``: path of every feed, so that empty files are seen.
    """
    path = "path"
    of = lambda member, *columns: cells.filter(F.col("member") == member).select(path, *[F.col("cells")[c].alias(c) for c in columns])
    told = lambda df, text, key: df.select(path, F.concat(F.lit(text), F.coalesce(key if isinstance(key, Column) else F.col(key), F.lit("?"))).alias("error"))
    needed = feeds.sparkSession.createDataFrame([(m, list(c)) for m, c in FEED_COLUMNS.items()], "member string, needed array<string>")
    first = cells.filter("row = 0").select(path, "member", F.map_keys("cells").alias("has"))
    heads = feeds.select(path).distinct().crossJoin(needed).join(first, [path, "member"], "left")  # a row for each of four files
    absent = heads.filter("has is not null").select(path, "member", F.explode(F.array_except("needed", "has")).alias("column"))
    stops, trips, times = of("stops.txt", "stop_id", "stop_lat", "stop_lon"), of("trips.txt", "trip_id", "route_id"), of("stop_times.txt", "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")
    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    given = lat.isNotNull() & lon.isNotNull()
    fits = F.coalesce(F.col("arrival_time").rlike(_CLOCK) & F.col("departure_time").rlike(_CLOCK) & F.col("stop_sequence").rlike(_WHOLE), F.lit(False))
    twice = times.groupBy(path, "trip_id", "stop_sequence").agg(F.count("*").alias("n")).filter("n > 1")
    unknown = lambda df, other, key: df.join(other.select(path, key).distinct(), [path, key], "left_anti")
    parts = [
        told(heads.filter("has is null"), "no rows: ", "member"), told(absent, "missing column: ", F.concat_ws("/", "member", "column")),
        told(stops.filter(given & ~(lat.between(-90, 90) & lon.between(-180, 180))), "stop out of range: ", "stop_id"), told(stops.filter(~given), "no coordinate: ", "stop_id"),
        told(unknown(trips, of("routes.txt", "route_id"), "route_id"), "trip without route: ", "trip_id"),
        told(unknown(times, trips, "trip_id"), "stop time without trip: ", "trip_id"), told(unknown(times, stops, "stop_id"), "stop time without stop: ", "stop_id"),
        told(times.filter(~fits), "stop time that does not parse: ", F.concat_ws("/", "trip_id", "stop_id")), told(twice, "repeated stop time: ", F.concat_ws("/", "trip_id", "stop_sequence")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def transfer_edges(stop_walk: DataFrame, stop_nodes: DataFrame, most: float = 10.0, buffer: float = 1.0) -> DataFrame:
    """(from_stop, to_stop, walk_minutes, transfer_minutes): stops that walk to each other's nodes in time; ``stop_walk``: stop_id, node, minutes, ``stop_nodes``: stop_id, node."""
    met = stop_walk.withColumnRenamed("stop_id", "from_stop").join(stop_nodes.withColumnRenamed("stop_id", "to_stop"), "node")
    near = met.filter((F.col("from_stop") != F.col("to_stop")) & (F.col("minutes") <= most))
    return near.select("from_stop", "to_stop", F.col("minutes").alias("walk_minutes"), (F.col("minutes") + buffer).alias("transfer_minutes"))


def route_name(routes: DataFrame):
    """The long name, else the short one, else the id; empty names count as missing."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("route_long_name", "route_short_name") if c in routes.columns]
    return F.coalesce(*given, F.col("route_id")).alias("route_name")


def named_routes(routes: DataFrame, part: str) -> DataFrame:
    """route_id of the routes whose name holds ``part``."""
    return routes.filter(route_name(routes).contains(part)).select("route_id")
