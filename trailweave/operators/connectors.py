"""Walks between stations and a trail: captured routing answers, straight lines instead, and steps joined to both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, rounded

ROUTING = "routes array<struct<geometry: struct<coordinates: array<array<double>>>, distance: double>>"
TABLE = "distances array<array<string>>"
TO, FROM = "to_trail", "from_trail"


def _point(lon, lat) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def concatenated(start, line, end) -> Column:
    """``start`` without its last point, ``line``, ``end`` without its first: the line's ends win. A null connector adds nothing."""
    nothing = F.slice(line, 1, 0)
    head = F.slice(start, F.lit(1), F.greatest(F.size(start) - 1, F.lit(0)))
    tail = F.slice(end, F.lit(2), F.greatest(F.size(end) - 1, F.lit(0)))
    return F.concat(F.coalesce(head, nothing), line, F.coalesce(tail, nothing))


def straight(lat1, lon1, lat2, lon2) -> Column:
    """struct(line, km) of two points and the great circle between them."""
    return F.struct(F.array(_point(lon1, lat1), _point(lon2, lat2)).alias("line"), (haversine_m(lat1, lon1, lat2, lon2) / 1000.0).alias("km"))


def walked(answer) -> Column:
    """struct(line, km) of a routing answer's first route; null if it has none, under two points or no distance."""
    first = F.try_element_at(F.from_json(answer, ROUTING)["routes"], F.lit(1))
    points = first["geometry"]["coordinates"]
    line = F.transform(points, lambda p: _point(F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))))
    return F.when((F.size(points) >= 2) & first["distance"].isNotNull(), F.struct(line.alias("line"), (first["distance"] / 1000.0).alias("km")))


def walked_metres(answer, n: int) -> Column:
    """The first row of a table of distances to ``n`` places, null where one is no number; all null if it has not ``n`` of them."""
    row = F.try_element_at(F.from_json(answer, TABLE)["distances"], F.lit(1))
    none = F.array_repeat(F.lit(None).cast("double"), n)
    return F.when(F.size(row) == n, F.transform(row, lambda x: x.try_cast("double"))).otherwise(none)


def legs(stations: DataFrame, walks: DataFrame, threshold_m: float) -> DataFrame:
    """code, direction, leg: how each station joins its junction, worked out once a station and direction.

    ``stations`` (code, lat, lon, junction struct(lon, lat), off_m); ``walks`` (code, direction, answer) are
    captured answers. Below ``threshold_m`` there is no leg; without a usable answer it is a straight line.
    """
    known = walks.groupBy("code", "direction").agg(F.min("answer").alias("answer"))
    both = stations.withColumn("direction", F.explode(F.array(F.lit(TO), F.lit(FROM)))).join(known, ["code", "direction"], "left")
    place = (F.col("lat"), F.col("lon"))
    junction = (F.col("junction.lat"), F.col("junction.lon"))
    instead = F.when(F.col("direction") == TO, straight(*place, *junction)).otherwise(straight(*junction, *place))
    return both.select("code", "direction", F.when(F.col("off_m") >= threshold_m, F.coalesce(walked(F.col("answer")), instead)).alias("leg"))


def attach(steps: DataFrame, stations: DataFrame, walks: DataFrame, threshold_m: float) -> DataFrame:
    """``steps`` (start, end, line, km, any others) with the walks to and from the trail in their line and km, to 0.1 km."""
    every = legs(stations, walks, threshold_m)
    side = lambda direction, code, name: every.where(F.col("direction") == direction).select(F.col("code").alias(code), F.col("leg").alias(name))
    met = steps.join(side(TO, "start", "_a"), "start", "left").join(side(FROM, "end", "_b"), "end", "left")
    km = F.coalesce("_a.km", F.lit(0.0)) + F.col("km") + F.coalesce("_b.km", F.lit(0.0))
    done = met.withColumn("line", concatenated(F.col("_a.line"), F.col("line"), F.col("_b.line"))).withColumn("km", rounded(km, 1))
    return done.select(*steps.columns)
