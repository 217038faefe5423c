"""Queries over single routes, places of stations, styles, dictionaries and settings, and junctions re-picked on foot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..functions.text import slug
from ..operators import catalog, refine
from .derive import SITE, hav, rnd, site, table
from .hike_queries import TRAIL, _trail

SAMPLE_M, RADIUS_M, WORLD = 400.0, 1500.0, "world"
KEYS = ["k1", "k3", "k5", "none"]


def _communes(spark, d):
    """Department, region and coast of each station by the commune of its code; of records of one code the last counts."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    insee = F.when(key % 17 == 0, "").when(key % 13 == 0, F.concat(F.lit("2B"), F.lpad((key % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lpad((key * 37 % 99).cast("string"), 2, "0"), F.lit("123 ")))
    records = c.select(key.alias("ord"), F.concat(F.lit(" T"), key % 701).alias("libellecourt"), insee.alias("codeinsee"))
    stations = site(spark, d).select("site", F.concat(F.lit("T"), F.col("site") * 3 % 997).alias("code"))
    return catalog.placed_stations(stations, records)


_regions = " ".join(f"WHEN department IN ({', '.join(repr(c) for c in codes.split())}) THEN '{name.replace(chr(39), chr(39) * 2)}'" for name, codes in catalog.REGIONS.items())
COMMUNES_SQL = f"""WITH r AS (SELECT c_custkey AS ord, 'T' || (c_custkey % 701) AS code, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN '2B' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE lpad((c_custkey*37 % 99)::VARCHAR, 2, '0') || '123' END AS insee FROM customer),
c AS (SELECT code, arg_max(insee, ord) AS insee FROM r WHERE insee <> '' GROUP BY code), d AS (SELECT c_custkey AS site, 'T' || (c_custkey*3 % 997) AS code FROM customer),
e AS (SELECT site, d.code, coalesce(CASE WHEN insee[1:2] = '97' THEN insee[1:3] ELSE insee[1:2] END, '') AS department FROM d LEFT JOIN c ON c.code = d.code)
SELECT site, code, department, CASE {_regions} ELSE '' END AS region, department IN ({', '.join(repr(c) for c in catalog.COASTAL)}) AS coastal FROM e"""


def _routes(spark, d):
    """ord, slug, name, region, pois of nations as routes: their places, with nulls where nothing is known."""
    s = site(spark, d)
    poi = F.struct(F.col("name").alias("name"), F.when(F.col("kind") == "train", "train_station").otherwise("bus_stop").alias("poi_type"), F.when(F.col("site") % 3 == 0, F.concat(F.lit("u"), "site")).alias("url"), F.when(F.col("site") % 4 == 0, F.col("site") / 8.0).alias("distance_km"))
    pois = s.groupBy(F.col("area").alias("ord")).agg(F.transform(F.sort_array(F.collect_list(F.struct("site", poi.alias("p")))), lambda x: x["p"]).alias("pois"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("Été "), "r_name", F.lit(" — "), (F.col("n_nationkey") % 3).cast("string")).alias("name"), F.col("r_name").alias("region"))
    return named.withColumn("slug", slug(F.col("name"))).join(pois, "ord", "left")


def _rows(spark, d):
    """Routes as rows of a catalog: trains counted, nulls told as empty texts and zeros."""
    p = F.transform(F.coalesce("pois", F.array()), lambda x: F.struct(x["name"].alias("name"), x["poi_type"].alias("poi_type"), F.coalesce(x["url"], F.lit("")).alias("url"), F.coalesce(x["distance_km"], F.lit(0.0)).alias("distance_km")))
    r = _routes(spark, d).withColumn("pois", p)
    trains = catalog.of_kind(F.col("pois"), "train_station")
    return r.select("ord", "slug", "name", F.size("pois").cast("long").alias("pois"), F.size(trains).cast("long").alias("trains"), F.size(F.filter("pois", lambda x: x["url"] == "")).cast("long").alias("without_url"), rounded(F.aggregate("pois", F.lit(0.0), lambda a, x: a + x["distance_km"]), 3).alias("km"), F.coalesce(F.get(trains, F.lit(0))["name"], F.lit("")).alias("first_train"))


def _slugs_found(spark, d):
    """The first route of each asked slug, in the order of the routes."""
    asked = table(spark, d, "region").select(F.concat(F.lit("ete-"), F.lower("r_name"), F.lit("-1")).alias("slug"))
    return catalog.by_slug(_routes(spark, d).drop("pois"), asked).select("slug", "ord", "name")


_name = "'Été ' || r_name || ' — ' || (n_nationkey % 3)"
_slug = "regexp_replace('ete-' || lower(r_name) || '-' || (n_nationkey % 3), '[\\s-]+', '-', 'g')"
ROWS_SQL = f"""WITH {SITE}, s AS (SELECT area AS ord, count(*) AS pois, count(*) FILTER (WHERE kind = 'train') AS trains, count(*) FILTER (WHERE site % 3 <> 0) AS without_url, sum(CASE WHEN site % 4 = 0 THEN site/8e0 ELSE 0e0 END) AS km, arg_min(name, site) FILTER (WHERE kind = 'train') AS first_train FROM site GROUP BY area)
SELECT n_nationkey AS ord, {_slug} AS slug, {_name} AS name, coalesce(pois, 0) AS pois, coalesce(trains, 0) AS trains, coalesce(without_url, 0) AS without_url, {rnd('coalesce(km, 0e0)', 3)} AS km, coalesce(first_train, '') AS first_train FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON s.ord = n_nationkey"""
FOUND_SQL = f"WITH r AS (SELECT n_nationkey AS ord, {_slug} AS slug, {_name} AS name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT slug, min(ord) AS ord, arg_min(name, ord) AS name FROM r WHERE slug IN (SELECT 'ete-' || lower(r_name) || '-1' FROM region) GROUP BY slug"


def _styles(spark, d):
    """Styles made of customers' keys, stripped to what draws the world: layers kept, their names, zooms left, sources left."""
    k = F.col("c_custkey")
    layer = lambda i, kind, source, zoom: F.concat(F.lit(f'{{"id": "l{i}", "type": "{kind}"'), F.lit(f', "source": "{source}"' if source else ""), F.when(k % zoom == 0, F.lit(', "maxzoom": 7')).otherwise(F.lit(', "paint": {"width": 1.5}')), F.lit("}"))
    layers = F.array(layer(1, "background", "", 2), layer(2, "line", WORLD, 3), layer(3, "fill", "grid", 5), F.when(k % 7 == 0, layer(4, "symbol", WORLD, 2)).otherwise(layer(4, "symbol", "grid", 2)))
    text = F.when(k % 11 == 0, F.lit('{"version": 8}')).otherwise(F.concat(F.lit('{"sources": {"world": {"url": "w"}, "grid": {"url": "g"}}, "layers": ['), F.array_join(layers, ", "), F.lit("]}")))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("style"), F.parse_json(text).alias("v"))
    s = s.select("style", catalog.world_layers(F.col("v"), WORLD).alias("l"), catalog.world_sources(F.col("v"), WORLD).alias("s"))
    names = F.array_join(F.transform("l", lambda x: F.try_variant_get(x["id"], "$", "string")), ",")
    return s.select("style", F.size("l").cast("long").alias("layers"), names.alias("names"), F.size(F.filter("l", lambda x: F.map_contains_key(x, "maxzoom"))).cast("long").alias("zooms"), F.size(F.filter("l", lambda x: F.map_contains_key(x, "paint"))).cast("long").alias("painted"), F.array_join(F.map_keys("s"), ",").alias("sources"))


STYLES_SQL = """WITH l AS (SELECT c_custkey AS style, c_custkey % 11 = 0 AS bare, c_custkey % 7 = 0 AS four, (c_custkey % 2 <> 0)::INT AS p1, (c_custkey % 3 <> 0)::INT AS p2, (c_custkey % 2 <> 0)::INT AS p4 FROM customer)
SELECT style, CASE WHEN bare THEN 0 ELSE 2 + four::INT END::BIGINT AS layers, CASE WHEN bare THEN '' WHEN four THEN 'l1,l2,l4' ELSE 'l1,l2' END AS names, 0::BIGINT AS zooms, CASE WHEN bare THEN 0 ELSE p1 + p2 + CASE WHEN four THEN p4 ELSE 0 END END::BIGINT AS painted, CASE WHEN bare THEN '' ELSE 'world' END AS sources FROM l"""


def _texts(spark, d):
    """Some keys of each nation's dictionary of customers' segments, with nation 0's and then the key itself instead."""
    c = table(spark, d, "customer").select("c_nationkey", F.concat(F.lit("k"), F.col("c_custkey") % 7).alias("key"), "c_custkey", "c_mktsegment").where("c_custkey % 3 <> 0")
    words = c.groupBy("c_nationkey", "key").agg(F.min_by("c_mktsegment", "c_custkey").alias("t")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("key", "t"))).alias("own"))
    default = words.where("c_nationkey = 0").select(F.col("own").alias("default"))
    empty = F.create_map().cast("map<string,string>")
    met = words.withColumn("_j", F.lit(0)).join(default.withColumn("_j", F.lit(0)), "_j", "left")
    told = met.withColumn("m", catalog.client_texts(F.col("own"), F.coalesce("default", empty), KEYS))
    return told.select(F.col("c_nationkey").alias("nation"), *(F.element_at("m", F.lit(k)).alias(k) for k in KEYS))


_t = lambda k: f"coalesce((SELECT t FROM w WHERE w.nation = n.nation AND key = '{k}'), (SELECT t FROM w WHERE w.nation = 0 AND key = '{k}'), '{k}') AS {k}"
TEXTS_SQL = f"""WITH w AS (SELECT c_nationkey AS nation, 'k' || (c_custkey % 7) AS key, arg_min(c_mktsegment, c_custkey) AS t FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1, 2) SELECT n.nation, {', '.join(map(_t, KEYS))} FROM (SELECT DISTINCT nation FROM w) n"""


def _settings(spark, d):
    """The box that each nation's settings file names, by a line anchored in a text of several."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("# BBOX := 9,9,9,9\nMAX := 13\nMBBOX := 1\nBBOX  :=  "), k.cast("string"), F.lit(",43,"), (k + 1).cast("string"), F.lit(".5,44  \nBBOX := 0,0,0,0\n"))
    box = F.split(catalog.config_value(text, "BBOX"), ",")
    return table(spark, d, "nation").select(k.alias("nation"), *(F.get(box, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("west", "south", "east", "north"))), catalog.config_value(text, "MAX").cast("int").alias("zoom"))


def _repicked(spark, d):
    """Stations of each line, re-picked by walks of 1.3 times the crow's way, of which some are missing; some answers are of another length."""
    samples = refine.trail_samples(_trail(spark, d), SAMPLE_M)
    at = samples.groupBy("route").agg(F.max("k").alias("n"))
    picks = at.withColumn("site", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))))
    mid = picks.withColumn("k", F.floor(F.col("n") * F.col("site") / 7)).join(samples.select("route", "k", "fraction", "lon", "lat"), ["route", "k"])
    off = (F.col("route") * 7 + F.col("site") * 13) % 9 * 0.002
    matched = mid.select("route", "site", F.col("site").alias("ord"), (F.col("lat") + off).alias("lat"), (F.col("lon") - 0.004).alias("lon"), "fraction", F.col("lon").alias("jlon"), F.col("lat").alias("jlat"), F.lit(9999.0).alias("dist_m"))
    found = refine.candidates(matched, samples, RADIUS_M)
    walk = F.when((F.col("site") + F.col("k")) % 3 != 0, F.rint(F.col("crow_m") * 1.3))
    answers = found.withColumn("w", walk).groupBy("route", "site").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("metres"))
    answers = answers.withColumn("metres", F.when((F.col("route") + F.col("site")) % 5 == 0, F.slice("metres", 2, 1000)).otherwise(F.col("metres")))
    told = refine.repicked(matched, found, answers)
    return told.select("route", "site", "ord", rounded(F.col("fraction"), 6).alias("fraction"), rounded(F.col("jlon"), 6).alias("jlon"), rounded(F.col("jlat"), 6).alias("jlat"), "dist_m")


REPICKED_SQL = f"""WITH {TRAIL}, a AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(part) OVER w AS ppart FROM trail WINDOW w AS (PARTITION BY route ORDER BY part, seq)),
b AS (SELECT *, CASE WHEN ppart = part THEN {hav('plat', 'plon', 'lat', 'lon')} ELSE 0e0 END AS m FROM a), c AS (SELECT *, sum(m) OVER (PARTITION BY route ORDER BY part, seq ROWS UNBOUNDED PRECEDING) AS upto FROM b), e AS (SELECT route, max(upto) AS total, arg_max(lon, (part, seq)) AS lon, arg_max(lat, (part, seq)) AS lat FROM c GROUP BY route),
f AS (SELECT *, unnest(range(CASE WHEN upto-m <= 0 THEN 0 ELSE floor((upto-m)/{SAMPLE_M}e0)::BIGINT + 1 END, floor(upto/{SAMPLE_M}e0)::BIGINT + 1)) AS k FROM c WHERE m > 0),
s AS (SELECT f.route, k, k*{SAMPLE_M}e0/total AS fraction, plon+(f.lon-plon)*(k*{SAMPLE_M}e0-(upto-m))/m AS lon, plat+(f.lat-plat)*(k*{SAMPLE_M}e0-(upto-m))/m AS lat FROM f JOIN e USING (route) UNION ALL SELECT route, floor(total/{SAMPLE_M}e0)::BIGINT + 1, 1e0, lon, lat FROM e WHERE floor(total/{SAMPLE_M}e0)*{SAMPLE_M}e0/total < 1e0-1e-9),
p AS (SELECT route, max(k) AS n FROM s GROUP BY route), q AS (SELECT p.route, i AS site, floor(n*i/7e0)::BIGINT AS k FROM p, range(1, 7) t(i)),
m AS (SELECT q.route, site, s.lat + ((q.route*7 + site*13) % 9)*0.002e0 AS lat, s.lon - 0.004e0 AS lon, fraction, s.lon AS jlon, s.lat AS jlat FROM q JOIN s ON s.route = q.route AND s.k = q.k),
g0 AS (SELECT m.route, m.site, s.k, s.fraction, s.lon, s.lat, {hav('m.lat', 'm.lon', 's.lat', 's.lon')} AS crow FROM m JOIN s ON s.route = m.route), g AS (SELECT *, CASE WHEN (site + k) % 3 <> 0 THEN round_even(crow*1.3e0, 0) END AS walk FROM g0 WHERE crow <= {RADIUS_M} AND (route + site) % 5 <> 0),
h AS (SELECT route, site, arg_min(fraction, (walk, k)) AS fraction, arg_min(lon, (walk, k)) AS lon, arg_min(lat, (walk, k)) AS lat, min(walk) AS walk FROM g WHERE walk IS NOT NULL GROUP BY ALL),
r AS (SELECT m.route, m.site, coalesce(h.fraction, m.fraction) AS fraction, coalesce(h.lon, jlon) AS jlon, coalesce(h.lat, jlat) AS jlat, coalesce(walk, 9999e0) AS dist_m FROM m LEFT JOIN h ON h.route = m.route AND h.site = m.site)
SELECT route, site, row_number() OVER (PARTITION BY route ORDER BY fraction, site) AS ord, {rnd('fraction', 6)} AS fraction, {rnd('jlon', 6)} AS jlon, {rnd('jlat', 6)} AS jlat, dist_m FROM r"""

QUERIES = {
    "commune_region": (_communes, COMMUNES_SQL),
    "catalog_rows": (_rows, ROWS_SQL),
    "routes_by_slug": (_slugs_found, FOUND_SQL),
    "style_filter": (_styles, STYLES_SQL),
    "dictionary_subset": (_texts, TEXTS_SQL),
    "settings_box": (_settings, "SELECT n_nationkey AS nation, n_nationkey::DOUBLE AS west, 43e0 AS south, n_nationkey + 1.5e0 AS east, 44e0 AS north, 13 AS zoom FROM nation"),
    "repicked_stations": (_repicked, REPICKED_SQL),
}
