"""Queries over the catalog: upsert, facets, ranking, exports, configuration rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..functions.text import fold, natural_list, short_hash
from ..operators import catalog as cat
from ..operators.lines import difficulty
from .derive import SITE, VERTEX, rnd, site, table, vertex

OLD, NEW = "o_orderdate < TIMESTAMP '1996-01-01'", "o_orderdate >= TIMESTAMP '1995-06-01'"


def _orders(spark, d, where):
    day = F.lit(where.split("'")[1]).cast("timestamp_ntz")
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderdate") < day if "<" in where and ">=" not in where else F.col("o_orderdate") >= day)


def _upsert(spark, d):
    """Customers' catalog rows: last order of an older run, replaced where the newer run has one."""
    last = lambda o, tag: o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.lit(tag).alias("run"))
    return cat.upsert(last(_orders(spark, d, OLD), "old"), last(_orders(spark, d, NEW), "new"), "o_custkey")


UPSERT_SQL = f"""WITH o AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, 'old' AS run FROM orders WHERE {OLD} GROUP BY 1),
n AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, 'new' AS run FROM orders WHERE {NEW} GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)"""


def _carry(spark, d):
    """Images: every fourth new row has its own, the others keep the old run's."""
    new = _orders(spark, d, NEW).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("image", F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("new/"), F.col("o_custkey").cast("string"))))
    old = _orders(spark, d, OLD).select("o_custkey").distinct().withColumn("image", F.concat(F.lit("old/"), F.col("o_custkey").cast("string")))
    return cat.carry_over(new, old, "o_custkey", "image").select("o_custkey", "n", "image")


CARRY_SQL = f"""WITH n AS (SELECT o_custkey, count(*) AS n, CASE WHEN o_custkey % 4 = 0 THEN 'new/' || o_custkey END AS image FROM orders WHERE {NEW} GROUP BY 1), o AS (SELECT DISTINCT o_custkey, 'old/' || o_custkey AS image FROM orders WHERE {OLD})
SELECT n.o_custkey, n, coalesce(n.image, o.image) AS image FROM n LEFT JOIN o USING (o_custkey)"""

REGIONS, TERRAINS = ["ASIA", "EUROPE"], ["PROMO", "ring"]


def _routes(spark, d):
    """Catalog rows: parts with a region by key and tags from their type."""
    p = table(spark, d, "part")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    return p.withColumn("rk", (F.col("p_partkey") % 6).cast("int")).join(r, "rk", "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.coalesce("region", F.lit("")).alias("region"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tags"), F.col("p_size").alias("size"), F.col("p_brand").alias("ref"), "p_retailprice")


ROUTES = "routes AS (SELECT p_partkey AS id, p_name AS name, coalesce(r_name, '') AS region, string_split(p_name || ' ' || p_type, ' ') AS tags, p_size AS size, p_brand AS ref, p_retailprice FROM part LEFT JOIN region ON r_regionkey = p_partkey % 6)"


def _facets(spark, d):
    r = _routes(spark, d)
    return r.where(cat.facet(F.col("region"), F.col("tags"), REGIONS, TERRAINS)).select("id", "region", "name")


def _facet_counts(spark, d):
    r = _routes(spark, d)
    counts = [F.count_if(cat.facet(F.col("region"), F.col("tags"), a, b)).alias(n) for n, a, b in (("n_all", [], []), ("n_region", REGIONS, []), ("n_terrain", [], TERRAINS), ("n_both", REGIONS, TERRAINS))]
    return r.agg(*counts)


_has = "list_has_any(tags, ['PROMO', 'ring'])"
_in = "region IN ('ASIA', 'EUROPE')"


def _facet_values(spark, d):
    r = _routes(spark, d)
    both = r.select(F.lit("region").alias("facet"), F.col("region").alias("value")).unionByName(r.select(F.lit("terrain").alias("facet"), F.explode("tags").alias("value")))
    return both.where("value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def _visible_bounds(spark, d):
    s = site(spark, d).where("kind = 'train' and area in (1, 2, 3)")
    return s.agg(*(rounded(f(c), 5).alias(n) for n, f, c in (("min_lon", F.min, "lon"), ("min_lat", F.min, "lat"), ("max_lon", F.max, "lon"), ("max_lat", F.max, "lat"))), F.count(F.lit(1)).alias("n"))


def _poi_counts(spark, d):
    s = site(spark, d)
    return s.groupBy("area").agg(F.count_if(F.col("kind") == "train").alias("trains"), F.count_if(F.col("kind") == "bus").alias("buses"), F.count(F.lit(1)).alias("n"))


def _top_landmarks(spark, d):
    """The twelve first of every brand: named ones first, by the rank of their kind, then by height."""
    p = table(spark, d, "part").withColumn("kind", F.col("p_type"))
    kinds = ["PROMO", "ECONOMY", "LARGE", "SMALL", "STANDARD"]
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)), F.lit(99))
    unnamed = F.col("p_partkey") % 10 == 0
    t = cat.top_ranked(p, "p_brand", 12, unnamed, rank, F.coalesce("p_size", F.lit(0)).desc(), "p_partkey")
    return t.select("p_brand", "p_partkey", "rank")


_rank = "CASE kind WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 3 WHEN 'STANDARD' THEN 4 ELSE 99 END"
TOP = f"t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 10 = 0, {_rank}, coalesce(p_size, 0) DESC, p_partkey)::INT AS rank FROM (SELECT *, p_type AS kind FROM part))"


def _phrase(spark, d):
    """The first three of each brand as a phrase."""
    t = _top_landmarks(spark, d).where("rank <= 3").join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    g = t.groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "p_name"))), lambda x: x["p_name"]).alias("names"))
    return g.select("p_brand", natural_list(F.col("names"), "none").alias("phrase"))


def _difficulty(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 200).alias("gain"), ((F.col("o_orderkey") % 40).cast("double") + 1).alias("km"))
    minutes = F.col("km") / 4 * 60 + F.col("gain") / 300 * 60
    return o.select("o_orderkey", difficulty(F.col("gain"), F.col("km")).alias("difficulty"), rounded(minutes, 1).alias("minutes"))


def _terrain(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") % 1400).alias("top"), (F.col("p_size") * 20.0).alias("gain"), ((F.col("p_partkey") % 30) + 1).cast("double").alias("km"), (F.col("p_partkey") % 7 == 0).alias("coastal"), ((F.col("p_partkey") % 11) / 10.0).alias("forest"))
    return s.select("id", F.array_join(cat.terrain_tags(*(F.col(c) for c in ("top", "gain", "km", "coastal", "forest"))), ",").alias("terrain"))


TERRAIN_SQL = """WITH s AS (SELECT p_partkey AS id, p_retailprice % 1400 AS top, p_size*20e0 AS gain, (p_partkey % 30)+1e0 AS km, p_partkey % 7 = 0 AS coastal, (p_partkey % 11)/10e0 AS forest FROM part)
SELECT id, concat_ws(',', CASE WHEN top < 200 AND coastal THEN 'coastal' END, CASE WHEN top >= 1000 THEN 'mountain' END, CASE WHEN forest >= 0.4e0 THEN 'forest' END,
 CASE WHEN (top >= 300 AND top < 1000) OR (top < 1000 AND gain/km >= 25) THEN 'hills' END, CASE WHEN top < 300 AND gain/km < 25 AND NOT (top < 200 AND coastal) THEN 'plains' END) AS terrain FROM s"""


def _department(spark, d):
    """Commune codes from customers' keys to departments to regions; the first station of each nation decides its region."""
    c = site(spark, d)
    code = F.when(F.col("site") % 17 == 0, F.lit(None)).when(F.col("site") % 13 == 0, F.concat(F.lit("2A"), F.lpad((F.col("site") % 1000).cast("string"), 3, "0"))).when(F.col("site") % 11 == 0, F.concat(F.lit("97"), F.lpad((F.col("site") % 1000).cast("string"), 3, "0"))).otherwise(F.lpad((F.col("site") * 37 % 95000).cast("string"), 5, "0"))
    e = c.withColumn("department", cat.department(code))
    first = e.groupBy("area").agg(F.min_by("department", "site").alias("first_department"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("area"), F.col("r_name").alias("region"))
    return e.join(first, "area").join(n, "area", "left").select("site", "department", "first_department", F.coalesce("region", F.lit("")).alias("region"))


DEPARTMENT_SQL = f"""WITH {SITE}, c AS (SELECT site, area, CASE WHEN site % 17 = 0 THEN NULL WHEN site % 13 = 0 THEN '2A' || lpad((site % 1000)::VARCHAR, 3, '0') WHEN site % 11 = 0 THEN '97' || lpad((site % 1000)::VARCHAR, 3, '0') ELSE lpad((site*37 % 95000)::VARCHAR, 5, '0') END AS code FROM site),
e AS (SELECT site, area, CASE WHEN code IS NULL OR code = '' THEN '' WHEN substr(code,1,2) = '97' THEN substr(code,1,3) ELSE substr(code,1,2) END AS department FROM c), f AS (SELECT area, arg_min(department, site) AS first_department FROM e GROUP BY area)
SELECT site, department, first_department, coalesce(r_name, '') AS region FROM e JOIN f USING (area) LEFT JOIN nation ON n_nationkey = area LEFT JOIN region ON r_regionkey = n_regionkey"""


def _skip(spark, d):
    """Orders to rebuild: state changed since the older run (hash of price and status by band), or not there before."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", short_hash(F.concat_ws("|", F.col("o_orderstatus"), (F.col("o_orderkey") % 3).cast("string")), 16).alias("state"))
    known = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select("o_orderkey", short_hash(F.concat_ws("|", F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("9")).otherwise((F.col("o_orderkey") % 3).cast("string"))), 16).alias("was"))
    j = o.join(known, "o_orderkey", "left")
    status = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("state"), "skipped").otherwise("rebuilt")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("state").alias("least_state"))


SKIP_SQL = """WITH o AS (SELECT o_orderkey, substr(sha256(o_orderstatus || '|' || (o_orderkey % 3)),1,16) AS state FROM orders), k AS (SELECT o_orderkey, substr(sha256(o_orderstatus || '|' || CASE WHEN o_orderkey % 4 = 0 THEN '9' ELSE (o_orderkey % 3)::VARCHAR END),1,16) AS was FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN was IS NULL THEN 'new' WHEN was = state THEN 'skipped' ELSE 'rebuilt' END AS status, count(*) AS n, min(state) AS least_state FROM o LEFT JOIN k USING (o_orderkey) GROUP BY 1"""


def _ttl(spark, d):
    """Cached answers still young enough at a stated time: 30 days, 90 for finished ones; the rest are misses."""
    now = F.lit("1998-08-01").cast("timestamp_ntz")
    age = F.datediff(now, F.col("o_orderdate"))
    ttl = F.when(F.col("o_orderstatus") == "F", 900).otherwise(300)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(age <= ttl).alias("hits"), F.count_if(age > ttl).alias("misses"))


def _tumbling(spark, d):
    """Events by day: count, sum and the last value."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


def _elevation_json(spark, d):
    """Each line's profile as one JSON text with fixed decimals."""
    v = vertex(spark, d)
    one = lambda c: F.col(c).cast("decimal(12,1)").cast("string")
    g = v.withColumn("e", F.floor(F.col("elev") * 10 + 0.5) / 10).groupBy("route").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", one("e").alias("e")))), lambda x: x["e"]).alias("es"))
    return g.select("route", F.concat(F.lit('{"elevations":['), F.array_join("es", ","), F.lit("]}")).alias("json"))


def _geojson(spark, d):
    """Each nation's places as a feature collection."""
    s = site(spark, d).where("kind = 'train'")
    f = F.concat(F.lit('{"type":"Feature","id":'), F.col("site").cast("string"), F.lit(',"kind":"'), F.col("kind"), F.lit('"}'))
    g = s.groupBy("area").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("site", f.alias("f")))), lambda x: x["f"]), ",").alias("fs"))
    return g.select("area", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("fs"), F.lit("]}")).alias("json"))


def _gpx(spark, d):
    """Each line as track points in a text, six decimals."""
    v = vertex(spark, d)
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").cast("string")
    p = F.concat(F.lit('<trkpt lat="'), micro("lat"), F.lit('" lon="'), micro("lon"), F.lit('"/>'))
    return v.groupBy("route").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", p.alias("p")))), lambda x: x["p"]), "").alias("gpx"))


def _search(spark, d):
    """Options whose folded label holds the folded query."""
    return _routes(spark, d).where(F.contains(fold(F.concat(F.col("name"), F.lit(" é"), F.col("region"))), fold(F.lit("ÉASIA")))).select("id", "region")


def _sorted(spark, d):
    """References by text order, ties by key, with their place."""
    w = Window.partitionBy("region").orderBy("ref", "id")
    return _routes(spark, d).withColumn("place", F.row_number().over(w)).select("id", "region", "place")


QUERIES = {
    "catalog_upsert": (_upsert, UPSERT_SQL),
    "image_path_carry": (_carry, CARRY_SQL),
    "facet_filter": (_facets, f"WITH {ROUTES} SELECT id, region, name FROM routes WHERE {_in} AND {_has}"),
    "facet_counts": (_facet_counts, f"WITH {ROUTES} SELECT count(*) AS n_all, count(*) FILTER (WHERE {_in}) AS n_region, count(*) FILTER (WHERE {_has}) AS n_terrain, count(*) FILTER (WHERE {_in} AND {_has}) AS n_both FROM routes"),
    "facet_values": (_facet_values, f"WITH {ROUTES}, b AS (SELECT 'region' AS facet, region AS value FROM routes UNION ALL SELECT 'terrain', unnest(tags) FROM routes) SELECT facet, value, count(*) AS n FROM b WHERE value <> '' GROUP BY ALL"),
    "visible_bounds": (_visible_bounds, f"WITH {SITE} SELECT {rnd('min(lon)', 5)} AS min_lon, {rnd('min(lat)', 5)} AS min_lat, {rnd('max(lon)', 5)} AS max_lon, {rnd('max(lat)', 5)} AS max_lat, count(*) AS n FROM site WHERE kind = 'train' AND area IN (1,2,3)"),
    "poi_counts": (_poi_counts, f"WITH {SITE} SELECT area, count(*) FILTER (WHERE kind='train') AS trains, count(*) FILTER (WHERE kind='bus') AS buses, count(*) AS n FROM site GROUP BY area"),
    "landmark_top12": (_top_landmarks, f"WITH {TOP} SELECT p_brand, p_partkey, rank FROM t WHERE rank <= 12"),
    "landmark_phrase": (_phrase, f"WITH {TOP}, g AS (SELECT p_brand, list(p_name ORDER BY rank) AS names FROM t WHERE rank <= 3 GROUP BY 1) SELECT p_brand, CASE len(names) WHEN 1 THEN names[1] WHEN 2 THEN names[1] || ' and ' || names[2] ELSE names[1] || ', ' || names[2] || ' and ' || names[3] END AS phrase FROM g"),
    "difficulty_duration": (
        _difficulty,
        "WITH o AS (SELECT o_orderkey, o_totalprice/200 AS gain, (o_orderkey % 40)+1e0 AS km FROM orders) SELECT o_orderkey, CASE WHEN km <= 0 THEN 'easy' WHEN gain < 500 AND gain/km < 30 THEN 'easy' WHEN gain < 1000 AND gain/km < 50 THEN 'moderate' WHEN gain < 1500 AND gain/km < 70 THEN 'difficult' ELSE 'very_difficult' END AS difficulty, "
        + rnd("(km/4*60 + gain/300*60)", 1) + " AS minutes FROM o",
    ),
    "terrain_tags": (_terrain, TERRAIN_SQL),
    "departement_region": (_department, DEPARTMENT_SQL),
    "incremental_skip": (_skip, SKIP_SQL),
    "ttl_filter": (_ttl, "WITH o AS (SELECT o_orderstatus, datediff('day', o_orderdate, TIMESTAMP '1998-08-01') AS age, CASE WHEN o_orderstatus = 'F' THEN 900 ELSE 300 END AS ttl FROM orders) SELECT o_orderstatus, count(*) FILTER (WHERE age <= ttl) AS hits, count(*) FILTER (WHERE age > ttl) AS misses FROM o GROUP BY 1"),
    "tumbling_resample": (_tumbling, f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {rnd('sum(value)', 2)} AS total, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY ALL"),
    "export_elevation": (_elevation_json, f"WITH {VERTEX} SELECT route, '{{\"elevations\":[' || string_agg((floor(elev*10e0+0.5e0)/10e0)::DECIMAL(12,1)::VARCHAR, ',' ORDER BY seq) || ']}}' AS json FROM vertex GROUP BY route"),
    "export_geojson": (_geojson, f"WITH {SITE} SELECT area, '{{\"type\":\"FeatureCollection\",\"features\":[' || string_agg('{{\"type\":\"Feature\",\"id\":' || site || ',\"kind\":\"' || kind || '\"}}', ',' ORDER BY site) || ']}}' AS json FROM site WHERE kind = 'train' GROUP BY area"),
    "export_gpx_text": (_gpx, f"WITH {VERTEX} SELECT route, string_agg('<trkpt lat=\"' || floor(lat*1e6+0.5e0)::BIGINT || '\" lon=\"' || floor(lon*1e6+0.5e0)::BIGINT || '\"/>', '' ORDER BY seq) AS gpx FROM vertex GROUP BY route"),
    "accent_search": (_search, f"WITH {ROUTES} SELECT id, region FROM routes WHERE contains(lower(name || ' e' || region), 'easia')"),
    "ref_string_sort": (_sorted, f"WITH {ROUTES} SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY ref, id)::INT AS place FROM routes"),
}
