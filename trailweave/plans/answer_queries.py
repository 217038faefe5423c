"""Queries over captured answers, coerced entries, catalogs with their envelope, features read back, layers by zoom."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..sources import answers
from .derive import SITE, rnd, site, table
from .export_queries import ROUTES, _features
from .hike_queries import TRAIL

HOUR = 3600


def _answered(spark, d):
    """What each customer's question gets: orders are cached answers, shipped lines fresh ones, some of which failed."""
    o = table(spark, d, "orders")
    now = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    cached = o.where("o_orderkey % 3 <> 0").select((F.col("o_custkey") % 400).alias("key"), F.col("o_orderdate").alias("fetched_at"), F.concat(F.lit("c"), "o_orderkey").alias("body"))
    fetched = o.where("o_orderkey % 7 = 0").select((F.col("o_custkey") % 400).alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).alias("body"))
    asked = table(spark, d, "customer").select((F.col("c_custkey") % 420).alias("key"))
    both = [answers.answered(asked, cached.groupBy("key").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("body", F.struct("fetched_at", "body")).alias("body")), fetched, s, now).withColumn("seconds", F.lit(s)) for s in (0, 400 * 24 * HOUR)]
    return both[0].unionByName(both[1])


ANSWERED_SQL = f"""WITH c AS (SELECT o_custkey % 400 AS key, max(o_orderdate) AS at_, arg_max('c' || o_orderkey, (o_orderdate, 'c' || o_orderkey)) AS body FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
f AS (SELECT o_custkey % 400 AS key, min('f' || lpad(o_orderkey::VARCHAR, 9, '0')) AS body FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT DISTINCT c_custkey % 420 AS key FROM customer),
s AS (SELECT unnest([0, {400 * 24 * HOUR}]) AS seconds), m AS (SELECT a.key, seconds, c.body AS cb, f.body AS fb, coalesce(seconds > 0 AND at_ >= TIMESTAMP '1995-06-01' - to_seconds(seconds), false) AS young FROM a CROSS JOIN s LEFT JOIN c ON c.key = a.key LEFT JOIN f ON f.key = a.key)
SELECT key, seconds::INT AS seconds, CASE WHEN young THEN cb ELSE coalesce(fb, cb) END AS body, CASE WHEN young THEN 'cached' WHEN fb IS NOT NULL THEN 'fetched' WHEN cb IS NOT NULL THEN 'stale' ELSE 'none' END AS state FROM m"""


def _entries(spark, d):
    """Catalog entries of parts' keys, in which numbers come as texts, lists as nulls and fields not at all."""
    k = F.col("p_partkey")
    part = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"id": '), k.cast("string"), part(k % 2 == 0, F.concat(F.lit(', "slug": "s'), k, F.lit('"'))), part(k % 3 != 0, F.concat(F.lit(', "distance_km": "'), k / 4.0, F.lit('"'))), part(k % 5 == 0, F.lit(', "distance_km": "far"')),
        part(k % 7 == 0, F.lit(', "terrain": null')), part(k % 7 == 1, F.lit(', "terrain": ["hills", "forest"]')), part(k % 4 == 0, F.concat(F.lit(', "elevation_gain_m": '), k, F.lit(".9"))), part(k % 6 == 0, F.lit(', "is_circular_trail": true')),
        part(k % 8 == 0, F.lit(', "bbox": ["1", 2, 3.5]')), part(k % 9 == 0, F.lit(', "pois": [{"name": "a", "url": "", "lat": "1.5"}, {"url": "u", "distance_km": 2}]')), F.lit("}"),
    )
    e = table(spark, d, "part").select("p_partkey", answers.entry(text).alias("e")).select("p_partkey", "e.*")
    total = F.aggregate("bbox", F.lit(0.0), lambda a, x: a + x)
    return e.select("p_partkey", "id", "slug", "region", rounded(F.col("distance_km"), 2).alias("km"), F.array_join("terrain", "|").alias("terrain"), F.col("elevation_gain_m").alias("gain"), "is_circular_trail", total.alias("box"), F.size("pois").cast("long").alias("pois"), F.size(F.filter("pois", lambda p: p["url"].isNotNull())).cast("long").alias("linked"), F.coalesce(F.get("pois", F.lit(0))["lat"], F.lit(-1.0)).alias("lat"))


ENTRIES_SQL = f"""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS p_partkey, k::VARCHAR AS id, CASE WHEN k % 2 = 0 THEN 's' || k ELSE '' END AS slug, '' AS region, {rnd('CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 0e0 ELSE k/4e0 END', 2)} AS km, CASE WHEN k % 7 = 1 THEN 'hills|forest' ELSE '' END AS terrain,
CASE WHEN k % 4 = 0 THEN k ELSE 0 END::BIGINT AS gain, k % 6 = 0 AS is_circular_trail, CASE WHEN k % 8 = 0 THEN 6.5e0 ELSE 0e0 END AS box, CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END::BIGINT AS pois, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END::BIGINT AS linked, CASE WHEN k % 9 = 0 THEN 1.5e0 ELSE -1e0 END AS lat FROM p"""


def _catalogs(spark, d):
    """Each region's catalog: nations as routes by their reference as text, in the envelope."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ref = F.concat(F.lit("GR "), F.col("n_nationkey"))
    json = F.concat(F.lit('{"id": '), F.col("n_nationkey"), F.lit(', "path_ref": "'), ref, F.lit('", "path_name": "'), F.col("n_name"), F.lit('"}'))
    return answers.catalog_documents(n.select(F.col("r_name").alias("region"), ref.alias("path_ref"), F.col("n_nationkey").alias("ord"), json.alias("json")), "region", "2024-01-01T00:00:00+00:00", "Map data", "ODbL")


CATALOGS_SQL = """SELECT r_name AS region, '{"generated_at": "2024-01-01T00:00:00+00:00", "source": "Map data", "license": "ODbL", "routes": [' || string_agg('{"id": ' || n_nationkey || ', "path_ref": "GR ' || n_nationkey || '", "path_name": "' || n_name || '"}', ', ' ORDER BY 'GR ' || n_nationkey) || ']}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""


def _read_back(spark, d):
    """Trails and places read back out of the features' texts: how many points, and their box's corner."""
    doc = _features(spark, d)
    both = [answers.features_of(doc, kind).withColumn("kind", F.lit(kind)) for kind in ("trail", "poi")]
    every = both[0].unionByName(both[1]).select("route", "kind", "url", F.explode("points").alias("p"))
    return every.groupBy("route", "kind").agg(F.count(F.lit(1)).alias("points"), F.count("url").alias("linked"), rounded(F.min(F.get("p", F.lit(0))), 5).alias("west"), rounded(F.min(F.get("p", F.lit(1))), 5).alias("south"))


_six = lambda c: f"round_even({c}*1e6, 0)/1e6"
READ_BACK_SQL = f"""WITH {SITE}, {TRAIL}, {ROUTES}, t AS (SELECT route, 'trail' AS kind, NULL AS url, lon, lat FROM trail UNION ALL SELECT pl.route, 'poi', url, lon, lat FROM pl JOIN rt USING (route))
SELECT route, kind, count(*) AS points, count(url) AS linked, {rnd(f'min({_six("lon")})', 5)} AS west, {rnd(f'min({_six("lat")})', 5)} AS south FROM t GROUP BY route, kind"""


def _layers(spark, d):
    """Layers that show at places' zooms, and what holds them."""
    t = site(spark, d).select("site", (F.col("site") % 16).cast("int").alias("z"))
    return answers.layers_at(t).groupBy("layer", "held", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("site").alias("sites"))


LAYERS_SQL = f"""WITH l(layer, a, b, c, d) AS (VALUES {', '.join(map(str, answers.LAYERS))}), h AS (SELECT layer, 'base' AS held, a AS lo, b AS hi FROM l UNION ALL SELECT layer, 'grid', c, d FROM l), s AS (SELECT c_custkey AS site, (c_custkey % 16)::INT AS z FROM customer)
SELECT layer, held, z, count(*) AS n, sum(site)::BIGINT AS sites FROM s JOIN h ON z BETWEEN lo AND hi GROUP BY ALL"""

QUERIES = {
    "answer_fallback": (_answered, ANSWERED_SQL),
    "coerced_entries": (_entries, ENTRIES_SQL),
    "catalog_documents": (_catalogs, CATALOGS_SQL),
    "features_read_back": (_read_back, READ_BACK_SQL),
    "layer_zooms": (_layers, LAYERS_SQL),
}
