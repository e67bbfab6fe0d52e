"""The engine's inputs as projections of the driver's tables, each also as SQL.

Zones are customers, facilities suppliers, timetables events; times between
them follow from keys, so both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import mesh_centre

STOPS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(df: DataFrame) -> DataFrame:
    lat, lon = mesh_centre(F.col("mesh"))
    return df.withColumns({"lat": lat, "lon": lon})


def _mesh(key: str, by: int):
    return F.concat(F.lit("5032"), F.lpad((F.col(key) * by % 1000000).cast("string"), 6, "0"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zone_id"), _mesh("c_custkey", 7919).alias("mesh"), F.abs("c_acctbal").alias("population"), (F.col("c_nationkey") % 4).alias("destination")))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), _mesh("s_suppkey", 104729).alias("mesh"), (F.col("s_nationkey") % 4).alias("kind")))


_CENTRE = """substr(mesh, 1, 2)::DOUBLE * 2 / 3 + substr(mesh, 5, 1)::DOUBLE / 12 + substr(mesh, 7, 1)::DOUBLE / 120 + (substr(mesh, 9, 1)::DOUBLE + 0.5::DOUBLE) / 1200 AS lat,
  substr(mesh, 3, 2)::DOUBLE + 100 + substr(mesh, 6, 1)::DOUBLE / 8 + substr(mesh, 8, 1)::DOUBLE / 80 + (substr(mesh, 10, 1)::DOUBLE + 0.5::DOUBLE) / 800 AS lon"""
ZONES = f"""zones AS (SELECT *, {_CENTRE} FROM (
  SELECT c_custkey AS zone_id, '5032' || lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') AS mesh, abs(c_acctbal) AS population, c_nationkey % 4 AS destination FROM customer))"""
FACILITIES = f"""facilities AS (SELECT *, {_CENTRE} FROM (
  SELECT s_suppkey AS place_id, '5032' || lpad((s_suppkey * 104729 % 1000000)::VARCHAR, 6, '0') AS mesh, s_nationkey % 4 AS kind FROM supplier))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with minutes before and after a disruption; null where unreachable."""
    z = zones(spark, sf_dir)
    plain = (F.col("zone_id") * 37 % 1400) / 10.0
    return z.withColumns({"before": F.when(F.col("zone_id") % 17 != 0, plain), "after": F.when(F.col("zone_id") % 19 != 0, plain + (F.col("zone_id") * 13 % 160) / 10.0)})


PAIRS = f"""{ZONES},
pairs AS (SELECT *, CASE WHEN zone_id % 17 <> 0 THEN (zone_id * 37 % 1400)::DOUBLE / 10 END AS before,
  CASE WHEN zone_id % 19 <> 0 THEN (zone_id * 37 % 1400)::DOUBLE / 10 + (zone_id * 13 % 160)::DOUBLE / 10 END AS after FROM zones)"""


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip is a user's day; its stops follow time, some five minutes apart, from an hour on that the user has."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.to_date("ts").alias("day"), F.col("user_id"), (F.col("event_id") % STOPS).alias("stop_id"), "ts", "event_id")
    rows = rows.withColumn("trip_id", F.concat_ws(":", F.col("user_id"), F.col("day").cast("string")))
    rows = rows.withColumn("stop_sequence", F.row_number().over(Window.partitionBy("trip_id").orderBy("ts", "event_id")))
    clock = ((6 + F.col("user_id") % 16) * 3600 + F.col("stop_sequence") * 300 + (F.minute("ts") * 60 + F.second("ts")) % 240).cast("long")
    return rows.select("day", "user_id", "stop_id", clock.alias("arrival"), clock.alias("departure"), "trip_id", F.col("stop_sequence").cast("string").alias("stop_sequence"))


def first_day(spark: SparkSession, sf_dir: str):
    """The service day of queries that look at one: the first that the table has."""
    return table(spark, sf_dir, "events").agg(F.min(F.to_date("ts"))).first()[0]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_times(spark, sf_dir).select("trip_id", F.concat(F.lit("r"), F.col("user_id") % 5).alias("route_id"), "day").distinct()


RIDES = """stop_times AS (
  SELECT *, ((6 + user_id % 16) * 3600 + seq * 300 + (minute(ts) * 60 + second(ts)) % 240)::BIGINT AS arrival FROM (
    SELECT ts, ts::DATE AS day, user_id, event_id % 20 AS stop_id, user_id::VARCHAR || ':' || (ts::DATE)::VARCHAR AS trip_id,
      row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INT AS seq FROM events)),
rides AS (SELECT * FROM (
  SELECT trip_id, 'r' || (user_id % 5)::VARCHAR AS route_id, user_id, day, seq, stop_id AS from_stop, arrival AS dep,
    lead(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS to_stop, lead(arrival) OVER (PARTITION BY trip_id ORDER BY seq) AS arr FROM stop_times) WHERE to_stop IS NOT NULL)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each service's withdrawal would do in each hour, by case."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("case_id"), (F.hour("ts") * 3600).alias("seconds"), F.concat(F.lit("r"), F.col("user_id") % 12).alias("id"), F.col("value"))
    g = e.groupBy("case_id", "seconds", "id").agg(F.round(F.sum(F.abs("value")), 4).alias("affected"), F.round(F.avg("value"), 3).alias("mean_change"), F.count("*").alias("n"))
    return g.withColumns({"evaluated": F.col("n") > 1, "material": F.col("affected") > 5})


SLOTS = """slots AS (SELECT *, n > 1 AS evaluated, affected > 5 AS material FROM (
  SELECT event_type AS case_id, hour(ts)::INT * 3600 AS seconds, 'r' || (user_id % 12)::VARCHAR AS id, round(sum(abs(value)), 4) AS affected, round(avg(value), 3) AS mean_change, count(*) AS n
  FROM events GROUP BY ALL))"""
