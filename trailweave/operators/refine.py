"""Junctions re-picked by walking distance: samples of a trail, captured rows of distances, the nearest on foot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.geo import haversine_m, rounded_even
from . import folds

#: Height in degrees of the bands in which samples and stations meet, per metre of the radius.
_BAND_M = 111_000.0


def trail_samples(trail: DataFrame, step_m: float = CONFIG.refine_step_m) -> DataFrame:
    """route, k, fraction, lon, lat: places every ``step_m`` along each trail (route, part, seq, lon, lat), and its end.

    Fractions count great-circle metres; gaps between parts have none. A place on a vertex belongs to the segment that
    ends there, segments of no length hold none.
    """
    w = Window.partitionBy("route").orderBy("part", "seq")
    here, lag = F.struct("lon", "lat", "part"), F.lag(F.struct("lon", "lat", "part")).over(w)
    s = trail.withColumn("_p", lag).withColumn("_h", here)
    step = F.when(F.col("_p.part") == F.col("part"), haversine_m(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))).otherwise(F.lit(0.0))
    s = s.withColumn("m", step).withColumn("to", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = s.groupBy("route").agg(F.max("to").alias("total"), F.max_by(F.struct("lon", "lat"), F.struct("part", "seq")).alias("e")).where("total > 0")
    first = F.when(F.col("to") - F.col("m") <= 0, F.lit(0)).otherwise(F.floor((F.col("to") - F.col("m")) / step_m) + 1).cast("long")
    last = F.floor(F.col("to") / step_m).cast("long")
    each = s.where("m > 0").withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("k") * F.lit(step_m) - (F.col("to") - F.col("m"))) / F.col("m")
    on = lambda c: (F.col(f"_p.{c}") + (F.col(c) - F.col(f"_p.{c}")) * t).alias(c)
    placed = each.select("route", "k", on("lon"), on("lat")).join(ends.select("route", "total"), "route").select("route", "k", (F.col("k") * F.lit(step_m) / F.col("total")).alias("fraction"), "lon", "lat")
    whole = F.floor(F.col("total") / step_m)
    tail = ends.where(whole * step_m / F.col("total") < 1.0 - 1e-9).select("route", (whole + 1).cast("long").alias("k"), F.lit(1.0).alias("fraction"), "e.lon", "e.lat")
    return placed.unionByName(tail)


def candidates(matched: DataFrame, samples: DataFrame, radius_m: float = CONFIG.station_radius_m) -> DataFrame:
    """route, site, pos, k, fraction, lon, lat, crow_m: a route's samples within ``radius_m`` of each matched station, numbered from 0 in their order. Both meet in bands of latitude."""
    size = radius_m / _BAND_M
    band = lambda c: F.floor(F.col(c) / size)
    s = samples.withColumn("_b", F.explode(F.sequence(band("lat") - 1, band("lat") + 1)))
    m = matched.select("route", "site", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).withColumn("_b", F.floor(F.col("_lat") / size))
    met = m.join(s, ["route", "_b"]).withColumn("crow_m", haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).where(F.col("crow_m") <= radius_m)
    pos = F.row_number().over(Window.partitionBy("route", "site").orderBy("k")) - 1
    return met.select("route", "site", pos.alias("pos"), "k", "fraction", "lon", "lat", "crow_m")


def repicked(matched: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """``matched`` (route, site, ord, fraction, jlon, jlat, dist_m, any others) with the candidate that is nearest on foot, in its new order.

    ``answers`` (route, site, metres array) hold a distance for each of ``found``'s candidates by position, null where there is no way;
    an answer of another length says nothing. The first of equal ones wins; without any the old junction stays.
    """
    many = found.groupBy("route", "site").agg(F.count(F.lit(1)).alias("_c"))
    fine = answers.join(many, ["route", "site"]).where(F.size("metres") == F.col("_c")).select("route", "site", F.posexplode("metres").alias("pos", "walk"))
    near = found.join(fine.where("walk is not null and not isnan(walk)"), ["route", "site", "pos"])
    best = near.groupBy("route", "site").agg(F.min_by(F.struct("fraction", "lon", "lat", "walk"), F.struct("walk", "pos")).alias("_n"))
    new = {"fraction": F.col("_n.fraction"), "jlon": F.col("_n.lon"), "jlat": F.col("_n.lat"), "dist_m": rounded_even(F.col("_n.walk"), 1)}
    moved = matched.join(best, ["route", "site"], "left").withColumns({c: F.coalesce(v, F.col(c)) for c, v in new.items()}).drop("_n")
    return moved.withColumn("ord", F.row_number().over(Window.partitionBy("route").orderBy("fraction", "ord")).cast("long"))


def refined(matched: DataFrame, samples: DataFrame, answers: DataFrame, radius_m: float = CONFIG.station_radius_m) -> DataFrame:
    """route, slot, site, frac, dist of matched stations (route, site, ord, name, lat, lon, fraction, jlon, jlat, dist_m) after re-picking and a second search for duplicates."""
    moved = repicked(matched, candidates(matched, samples, radius_m), answers)
    return folds.greedy_dedup(moved.select("route", "ord", "site", "name", F.col("fraction").alias("frac"), F.col("dist_m").alias("dist")))
