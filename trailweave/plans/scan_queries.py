"""Queries over map elements that the customers give: scans by boxes along the lines, captured walks and tables of distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_m, rounded
from ..operators import connectors
from ..operators.lines import bounds
from ..sources import scans
from .derive import SITE, VERTEX, hav, rnd, site, vertex


def _elements(spark, d):
    """Nodes, and ways with or without a centre, with the tags of stations, beds, sights and woods."""
    i, kind = F.col("site"), F.col("site") % 5 == 0
    when = lambda c, v: F.when(c, F.lit(v) if isinstance(v, str) else v)
    tags = {
        "railway": F.when(i % 4 == 0, "station").when(i % 4 == 1, "halt"), "disused": when(i % 12 == 0, "yes"), "highway": when(i % 4 == 2, "bus_stop"), "public_transport": when(i % 4 == 3, "platform"), "bus": when(i % 8 == 3, "yes"),
        "tourism": F.when(i % 6 == 0, "hotel").when(i % 6 == 1, "camp_site").when(i % 6 == 2, "viewpoint").when(i % 6 == 3, "museum").when(i % 6 == 5, "hostel"), "natural": F.when(i % 7 == 0, "peak").when(i % 7 == 1, "wood"),
        "name": F.when(i % 9 == 0, None).when(i % 9 == 1, "").otherwise(F.concat(F.lit("N"), i % 50)), "ele": F.when(i % 14 == 0, "high").when(i % 7 == 0, F.concat(i.cast("string"), F.lit(".7"))),
        "website": when(i % 5 == 1, F.concat(F.lit("w"), i)), "contact:website": when(i % 3 == 0, F.concat(F.lit("c"), i)),
    }
    made = F.map_filter(F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    point = lambda x, y: F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon"))
    ring = F.array(point(0.0, 0.0), point(0.01, 0.0), point(0.01, 0.01), point(0.0, 0.0))
    geometry = F.when(kind, F.when(i % 15 == 0, F.slice(ring, 1, 3)).otherwise(ring))
    own = lambda c: F.when(~kind, F.col(c)).alias(c)
    center = F.when(kind & (i % 10 != 0), F.struct("lat", "lon"))
    none = F.lit(None).cast("array<struct<type: string, ref: bigint, geometry: array<struct<lat: double, lon: double>>>>")
    return site(spark, d).select(i.alias("id"), F.when(kind, "way").otherwise("node").alias("type"), made.alias("tags"), own("lat"), own("lon"), center.alias("center"), geometry.alias("geometry"), none.alias("members"))


def _boxes(spark, d):
    """A line's box, cut into its west and its east half."""
    b = bounds(vertex(spark, d))
    mid = (F.col("min_lon") + F.col("max_lon")) / 2
    half = lambda n, a, z: F.struct(F.lit(n).alias("chunk"), a.alias("min_lon"), F.col("min_lat"), z.alias("max_lon"), F.col("max_lat"))
    return b.select("route", F.inline(F.array(half(0, F.col("min_lon"), mid), half(1, mid, F.col("max_lon")))))


def _counted(found, *more):
    return found.groupBy("home", "route").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("chunk").cast("long").alias("chunks"), *more).drop("home")


def _stations(spark, d):
    """Stations around each line: of each name the first by half, then by number."""
    rows = scans.stations(_elements(spark, d)).withColumn("key", F.coalesce(F.col("tags")["name"], F.lit("-")))
    return _counted(scans.scan(rows, _boxes(spark, d), scans.STATION_MARGIN, ["key"], "id"))


def _beds(spark, d):
    """Places to sleep around each line, with a link where one is told."""
    found = scans.scan(scans.accommodation(_elements(spark, d)), _boxes(spark, d), scans.BED_MARGIN, ["lat", "lon"], "id")
    return _counted(found, F.count_if(F.col("poi_type") == "camping").alias("camps"), F.count("url").alias("linked"), F.max("url").alias("last_url"))


def _landmarks(spark, d):
    """Sights around each line with their heights, told apart by kind and place."""
    rows = scans.landmarks(_elements(spark, d)).withColumn("key", scans.landmark_key())
    found = scans.scan(rows, _boxes(spark, d), scans.LANDMARK_MARGIN, ["key"], "id")
    return _counted(found, F.count_if(F.col("kind") == "viewpoint").alias("views"), F.count_if(F.col("name") == "").alias("unnamed"), F.sum("elevation_m").cast("long").alias("metres"))


def _woods(spark, d):
    """Rings of woods, by their number of points."""
    return scans.forests(_elements(spark, d)).groupBy(F.size("points").cast("long").alias("points")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


EL = f"""{SITE}, {VERTEX}, el AS (SELECT site AS id, site % 5 = 0 AS way, CASE WHEN site % 5 <> 0 OR site % 10 <> 0 THEN lat END AS lat, CASE WHEN site % 5 <> 0 OR site % 10 <> 0 THEN lon END AS lon, CASE WHEN site % 9 = 0 THEN NULL WHEN site % 9 = 1 THEN '' ELSE 'N' || (site % 50) END AS name FROM site),
b0 AS (SELECT route, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM vertex GROUP BY route), b AS (SELECT route, 0 AS chunk, w, s, (w+e)/2 AS e, n FROM b0 UNION ALL SELECT route, 1, (w+e)/2, s, e, n FROM b0)"""


def _scan_sql(rows: str, margin: float, key: str, *more: str) -> str:
    return f"""WITH {EL}, r AS ({rows}), m AS (SELECT r.*, route, chunk, row_number() OVER (PARTITION BY route, {key} ORDER BY chunk, id) AS rn FROM r JOIN b ON lon BETWEEN w-{margin}e0 AND e+{margin}e0 AND lat BETWEEN s-{margin}e0 AND n+{margin}e0)
SELECT route, count(*) AS n, sum(id)::BIGINT AS ids, sum(chunk)::BIGINT AS chunks{''.join(', ' + x for x in more)} FROM m WHERE rn = 1 GROUP BY route"""


_URL = "CASE WHEN id % 5 = 1 THEN 'w' || id WHEN id % 3 = 0 THEN 'c' || id END"


def _walks(spark, d):
    """route, code, direction, site, junction and captured answers about the walks between each line's ends and two sites."""
    points = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    line = vertex(spark, d).groupBy("route").agg(points.alias("p")).select("route", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("line"))
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    ends = line.select("route", F.concat(F.col("route"), F.lit("a")).alias("start"), F.concat(F.col("route"), F.lit("b")).alias("end"), "line", a.alias("a"), b.alias("b"))
    steps = ends.withColumn("km", haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / 1000.0)
    sides = steps.select("route", F.inline(F.array(F.struct(F.col("start").alias("code"), F.col("route").alias("site"), F.col("a").alias("junction")), F.struct(F.col("end").alias("code"), (F.col("route") + 1).alias("site"), F.col("b").alias("junction")))))
    met = sides.join(site(spark, d).select("site", "lat", "lon"), "site")
    stations = met.withColumn("off_m", haversine_m(F.col("lat"), F.col("lon"), F.col("junction.lat"), F.col("junction.lon")))
    spot = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    told = F.concat(F.lit('{"routes": [{"geometry": {"coordinates": ['), spot(F.lit(2.5), F.lit(43.5)), F.lit(","), spot(F.lit(2.25), F.col("site") % 2 + 43), F.lit(","), spot(F.lit(2.0), F.lit(43.25)), F.lit(']}, "distance": '), (F.col("site") * 100 + 50).cast("string"), F.lit("}]}"))
    answer = F.when(F.col("site") % 4 == 0, told).when(F.col("site") % 4 == 1, F.lit('{"routes": [{"geometry": {"coordinates": [[2, 43]]}, "distance": 5}]}')).when(F.col("site") % 4 == 2, F.lit('{"routes": []}'))
    walks = stations.where("site % 4 <> 3").select("code", F.explode(F.array(F.lit(connectors.TO), F.lit(connectors.FROM))).alias("direction"), answer.alias("answer"))
    return steps, stations, walks


def _routed(spark, d):
    """Lines joined to the sites at their ends by captured walks; straight where an answer holds no way."""
    steps, stations, walks = _walks(spark, d)
    done = connectors.attach(steps, stations, walks, 60_000.0)
    told = lambda i, c: rounded(F.element_at("line", i)[c], 6).alias(("first_" if i > 0 else "last_") + c)
    return done.select("route", F.size("line").cast("long").alias("n_points"), "km", told(1, "lon"), told(1, "lat"), told(-1, "lon"), told(-1, "lat"))


def _table(spark, d):
    """A row of captured distances for each site: null where one is no number, all null in a row of another length."""
    s = site(spark, d).select("site")
    cells = F.transform(F.sequence(F.lit(0), F.lit(3) + (F.col("site") % 10 == 0).cast("int")), lambda j: F.when((F.col("site") + j) % 4 == 0, "null").when((F.col("site") + j) % 9 == 0, '"far"').otherwise((F.col("site") * 10 + j).cast("string")))
    answer = F.when(F.col("site") % 13 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"distances": [['), F.array_join(cells, ","), F.lit("]]}")))
    m = s.select("site", connectors.walked_metres(answer, 4).alias("m"))
    return m.select("site", *(F.get("m", F.lit(j)).alias(f"m{j}") for j in range(4)))


ROUTED_SQL = f"""WITH {SITE}, {VERTEX}, l AS (SELECT route, count(*) AS n, arg_min(lon, seq) AS alon, arg_min(lat, seq) AS alat, arg_max(lon, seq) AS blon, arg_max(lat, seq) AS blat FROM vertex GROUP BY 1),
m AS (SELECT l.*, s.site AS sa, e.site AS sb, s.lat AS slat, s.lon AS slon, e.lat AS elat, e.lon AS elon, {hav('s.lat', 's.lon', 'alat', 'alon')} AS am, {hav('blat', 'blon', 'e.lat', 'e.lon')} AS bm, {hav('alat', 'alon', 'blat', 'blon')} AS m
 FROM l LEFT JOIN site s ON s.site = l.route LEFT JOIN site e ON e.site = l.route + 1), w AS (SELECT *, coalesce(am >= 60000, false) AS wa, coalesce(bm >= 60000, false) AS wb, coalesce(sa % 4 = 0, false) AS ra, coalesce(sb % 4 = 0, false) AS rb FROM m)
SELECT route, n + CASE WHEN wa THEN CASE WHEN ra THEN 2 ELSE 1 END ELSE 0 END + CASE WHEN wb THEN CASE WHEN rb THEN 2 ELSE 1 END ELSE 0 END AS n_points,
{rnd('(CASE WHEN wa THEN CASE WHEN ra THEN (sa*100+50)/1e3 ELSE am/1e3 END ELSE 0e0 END + m/1e3 + CASE WHEN wb THEN CASE WHEN rb THEN (sb*100+50)/1e3 ELSE bm/1e3 END ELSE 0e0 END)', 1)} AS km,
{rnd('(CASE WHEN NOT wa THEN alon WHEN ra THEN 2.5e0 ELSE slon END)', 6)} AS first_lon, {rnd('(CASE WHEN NOT wa THEN alat WHEN ra THEN 43.5e0 ELSE slat END)', 6)} AS first_lat,
{rnd('(CASE WHEN NOT wb THEN blon WHEN rb THEN 2e0 ELSE elon END)', 6)} AS last_lon, {rnd('(CASE WHEN NOT wb THEN blat WHEN rb THEN 43.25e0 ELSE elat END)', 6)} AS last_lat FROM w"""
_cell = lambda j: f"CASE WHEN c_custkey % 13 = 0 OR c_custkey % 10 = 0 OR (c_custkey + {j}) % 4 = 0 OR (c_custkey + {j}) % 9 = 0 THEN NULL ELSE (c_custkey*10 + {j})::DOUBLE END AS m{j}"

QUERIES = {
    "scan_stations": (_stations, _scan_sql("SELECT *, coalesce(name, '-') AS key FROM el WHERE NOT way AND ((id % 4 IN (0, 1) AND id % 12 <> 0) OR id % 4 = 2 OR id % 8 = 3)", scans.STATION_MARGIN, "key")),
    "scan_beds": (_beds, _scan_sql("SELECT * FROM el WHERE lat IS NOT NULL AND name <> '' AND id % 6 IN (0, 1, 5)", scans.BED_MARGIN, "lat, lon", "count(*) FILTER (WHERE id % 6 = 1) AS camps", f"count({_URL}) AS linked", f"max({_URL}) AS last_url")),
    "scan_landmarks": (
        _landmarks,
        _scan_sql("SELECT *, CASE WHEN id % 6 = 0 THEN 'hotel' WHEN id % 6 = 1 THEN 'camp_site' WHEN id % 6 = 2 THEN 'viewpoint' WHEN id % 6 = 3 THEN 'museum' WHEN id % 6 = 5 THEN 'hostel' ELSE 'peak' END AS kind FROM el WHERE lat IS NOT NULL AND (id % 6 = 2 OR id % 7 = 0)", scans.LANDMARK_MARGIN, "kind, id", "count(*) FILTER (WHERE kind = 'viewpoint') AS views", "count(*) FILTER (WHERE coalesce(name, '') = '') AS unnamed", "sum(CASE WHEN id % 14 <> 0 AND id % 7 = 0 THEN id END)::BIGINT AS metres"),
    ),
    "scan_woods": (_woods, "SELECT 4::BIGINT AS points, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 15 <> 0 AND c_custkey % 7 = 1"),
    "routed_connectors": (_routed, ROUTED_SQL),
    "walk_table": (_table, f"SELECT c_custkey AS site, {', '.join(map(_cell, range(4)))} FROM customer"),
}
