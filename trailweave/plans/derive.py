"""Geographic entities that follow from the driver's tables, in Spark and in SQL side by side.

site: places of customers; gstop: places of suppliers; vertex: one line per user from the events;
trip and stop_time: journeys from orders and line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, a: int, b: int) -> tuple:
    k = F.col(key)
    return F.lit(43.0) + (k * a % 10007) / 10007.0, F.lit(2.0) + (k * b % 10009) / 10009.0


def site(spark, d) -> DataFrame:
    lat, lon = _place("c_custkey", 7919, 104729)
    kind = F.when(F.col("c_custkey") % 3 == 0, "train").otherwise("bus")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("area"), lat.alias("lat"), lon.alias("lon"), kind.alias("kind"))


def gstop(spark, d) -> DataFrame:
    lat, lon = _place("s_suppkey", 6133, 50021)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop"), F.col("s_nationkey").alias("area"), lat.alias("lat"), lon.alias("lon"))


def vertex(spark, d) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, d, "events").select(F.col("user_id").alias("route"), seq.alias("seq"), F.col("value").alias("elev"))
    lon = F.lit(2.0) + (F.col("route") * 7919 % 997) / 997.0 + F.col("seq") * 0.002
    lat = F.lit(43.0) + (F.col("route") * 104729 % 991) / 991.0 + (F.col("elev") - 245) / 100000.0
    return e.select("route", "seq", "elev", lon.alias("lon"), lat.alias("lat"))


def trip(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("trip"), (F.col("o_custkey") % 50).alias("route"))


def stop_time(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stop"), F.col("l_orderkey").alias("trip"))


SITE = "site AS (SELECT c_custkey AS site, c_name AS name, c_nationkey AS area, 43e0 + (c_custkey*7919 % 10007)/10007e0 AS lat, 2e0 + (c_custkey*104729 % 10009)/10009e0 AS lon, CASE WHEN c_custkey % 3 = 0 THEN 'train' ELSE 'bus' END AS kind FROM customer)"
GSTOP = "gstop AS (SELECT s_suppkey AS stop, s_nationkey AS area, 43e0 + (s_suppkey*6133 % 10007)/10007e0 AS lat, 2e0 + (s_suppkey*50021 % 10009)/10009e0 AS lon FROM supplier)"
VERTEX = (
    "vertex AS (SELECT route, seq, elev, 2e0 + (route*7919 % 997)/997e0 + seq*0.002e0 AS lon, 43e0 + (route*104729 % 991)/991e0 + (elev-245)/100000e0 AS lat "
    "FROM (SELECT user_id AS route, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS elev FROM events))"
)
TRIP = "trip AS (SELECT o_orderkey AS trip, o_custkey % 50 AS route FROM orders)"
STOP_TIME = "stop_time AS (SELECT l_suppkey AS stop, l_orderkey AS trip FROM lineitem)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle metres in SQL."""
    a = f"(pow(sin(radians({lat2}-{lat1})/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))"
    return f"(12742000e0*atan2(sqrt({a}), sqrt(1e0-{a})))"


def rnd(value: str, digits: int) -> str:
    return f"(floor({value}*1e{digits}+0.5e0)/1e{digits})"
