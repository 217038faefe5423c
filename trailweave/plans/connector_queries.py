"""Queries over walks to the trail: each line joined to the sites at its ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_m, rounded
from ..operators import connectors
from .derive import SITE, VERTEX, hav, rnd, site, vertex

#: Sites nearer to their junction than this have no walk of their own.
NEAR_M = 60_000.0


def _connector_lines(spark, d):
    """Lines from the site of their number to the next one's, by straight walks from 60 km on."""
    points = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    lines = vertex(spark, d).groupBy("route").agg(points.alias("p")).select("route", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("line"))
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    ends = lines.select("route", F.concat(F.col("route"), F.lit("a")).alias("start"), F.concat(F.col("route"), F.lit("b")).alias("end"), "line", a.alias("a"), b.alias("b"))
    steps = ends.withColumn("km", haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / 1000.0)
    sides = steps.select(F.inline(F.array(F.struct(F.col("start").alias("code"), F.col("route").alias("site"), F.col("a").alias("junction")), F.struct(F.col("end").alias("code"), (F.col("route") + 1).alias("site"), F.col("b").alias("junction")))))
    met = sides.join(site(spark, d).select("site", "lat", "lon"), "site")
    stations = met.withColumn("off_m", haversine_m(F.col("lat"), F.col("lon"), F.col("junction.lat"), F.col("junction.lon")))
    walks = stations.select("code", F.lit(connectors.TO).alias("direction"), F.lit(None).cast("string").alias("answer")).where("answer is not null")
    done = connectors.attach(steps, stations, walks, NEAR_M)
    told = lambda i, c: rounded(F.element_at("line", i)[c], 6).alias(("first_" if i > 0 else "last_") + c)
    return done.select("route", F.size("line").cast("long").alias("n_points"), "km", told(1, "lon"), told(1, "lat"), told(-1, "lon"), told(-1, "lat"))


CONNECTOR_LINES_SQL = f"""WITH {SITE}, {VERTEX},
l AS (SELECT route, count(*) AS n, arg_min(lon, seq) AS alon, arg_min(lat, seq) AS alat, arg_max(lon, seq) AS blon, arg_max(lat, seq) AS blat FROM vertex GROUP BY 1),
m AS (SELECT l.*, s.lat AS slat, s.lon AS slon, e.lat AS elat, e.lon AS elon, {hav('s.lat', 's.lon', 'alat', 'alon')} AS am, {hav('blat', 'blon', 'e.lat', 'e.lon')} AS bm, {hav('alat', 'alon', 'blat', 'blon')} AS m
 FROM l LEFT JOIN site s ON s.site = l.route LEFT JOIN site e ON e.site = l.route + 1),
w AS (SELECT *, coalesce(am >= {NEAR_M}, false) AS wa, coalesce(bm >= {NEAR_M}, false) AS wb FROM m)
SELECT route, n + wa::INT + wb::INT AS n_points, {rnd('(CASE WHEN wa THEN am/1000e0 ELSE 0e0 END + m/1000e0 + CASE WHEN wb THEN bm/1000e0 ELSE 0e0 END)', 1)} AS km,
{rnd('(CASE WHEN wa THEN slon ELSE alon END)', 6)} AS first_lon, {rnd('(CASE WHEN wa THEN slat ELSE alat END)', 6)} AS first_lat,
{rnd('(CASE WHEN wb THEN elon ELSE blon END)', 6)} AS last_lon, {rnd('(CASE WHEN wb THEN elat ELSE blat END)', 6)} AS last_lat FROM w"""

QUERIES = {"connector_lines": (_connector_lines, CONNECTOR_LINES_SQL)}
