"""Captured answers: which one a key gets, and catalog entries out of them, coerced field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "id string, slug string, path_ref string, path_name string, description string, osm_relation_id string, distance_km string, elevation_gain_m string, region string, departement string, difficulty string, is_circular_trail string, terrain array<string>, bbox array<string>, image_path string, pois array<struct<name: string, lat: string, lon: string, poi_type: string, url: string, transit_lines: array<string>, distance_km: string>>"
# Layers of map tiles, the zooms of the base file they share and those of a square's own.
LAYERS = [("france", 6, 10, 11, 13), ("contours", 8, 10, 11, 13), ("hillshade", 6, 8, 9, 11)]


def answered(asked: DataFrame, cached: DataFrame, fetched: DataFrame, seconds: int, now: Column) -> DataFrame:
    """key, body, state of each asked key: ``cached`` (key, fetched_at, body) if it is at most ``seconds`` old at ``now`` ("cached"), else what was ``fetched`` (key, body; null where that failed: "fetched"), else the newest cached one of any age ("stale"), else nothing ("none").

    0 seconds pass the cache by, at first; of a key's cached answers the newest counts, whose age must be over the limit to be too old.
    """
    newest = cached.groupBy("key").agg(F.max("fetched_at").alias("_at"), F.max_by("body", "fetched_at").alias("_cached"))
    new = fetched.where("body is not null").groupBy("key").agg(F.min("body").alias("_new"))
    met = asked.select("key").distinct().join(newest, "key", "left").join(new, "key", "left")
    young = F.lit(seconds > 0) & F.coalesce(F.col("_at") >= now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))
    state = F.when(young, "cached").when(F.col("_new").isNotNull(), "fetched").when(F.col("_cached").isNotNull(), "stale").otherwise("none")
    return met.select("key", F.when(young, F.col("_cached")).otherwise(F.coalesce("_new", "_cached")).alias("body"), state.alias("state"))


def entry(text: Column) -> Column:
    """struct of a catalog entry's JSON: texts and numbers coerced, what is missing told as empty, zero, false or an empty list; url and image_path stay null."""
    e = F.from_json(text, ENTRY)
    word = lambda c: F.coalesce(c, F.lit("")).alias
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    whole = lambda c: F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    pois = F.transform(F.coalesce(e["pois"], F.array()), lambda p: F.struct(
        word(p["name"])("name"), number(p["lat"]).alias("lat"), number(p["lon"]).alias("lon"), word(p["poi_type"])("poi_type"), F.nullif(p["url"], F.lit("")).alias("url"),
        listed(p["transit_lines"]).alias("transit_lines"), p["distance_km"].try_cast("double").alias("distance_km"),
    ))
    texts = [word(e[c])(c) for c in ("id", "slug", "path_ref", "path_name", "description", "region", "departement", "difficulty")]
    box = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: number(F.get(e["bbox"], i)))
    return F.struct(
        *texts, whole(e["osm_relation_id"]).alias("osm_relation_id"), number(e["distance_km"]).alias("distance_km"), whole(e["elevation_gain_m"]).alias("elevation_gain_m"),
        F.coalesce(e["is_circular_trail"] == "true", F.lit(False)).alias("is_circular_trail"), listed(e["terrain"]).alias("terrain"), box.alias("bbox"), e["image_path"].alias("image_path"), pois.alias("pois"),
    )


def catalog_documents(routes: DataFrame, key: str, generated_at: str, source: str, license: str) -> DataFrame:
    """key, json: a catalog of each key's ``routes`` (key, path_ref, ord, json) in order of their reference as text, in its envelope."""
    each = routes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path_ref", "ord", "json"))).alias("_a"))
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    head = f'{{"generated_at": {quoted(generated_at)}, "source": {quoted(source)}, "license": {quoted(license)}, "routes": ['
    return each.select(key, F.concat(F.lit(head), F.array_join(F.transform("_a", lambda x: x["json"]), ", "), F.lit("]}")).alias("json"))


def features_of(documents: DataFrame, kind: str) -> DataFrame:
    """``documents`` (geojson, any others) by feature of one kind ("trail" or "poi"): name, poi_type, url, points (array of lon, lat pairs of all parts)."""
    shape = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: variant>>>"
    f = documents.withColumn("_f", F.explode(F.from_json("geojson", shape)["features"])).where(F.col("_f.properties")["feature_type"] == kind)
    c, t = F.col("_f.geometry.coordinates"), F.col("_f.geometry.type")
    pair = "array<double>"
    points = F.when(t == "Point", F.array(F.try_variant_get(c, "$", pair))).when(t == "LineString", F.try_variant_get(c, "$", f"array<{pair}>")).otherwise(F.flatten(F.try_variant_get(c, "$", f"array<array<{pair}>>")))
    told = F.col("_f.properties")
    return f.select(*(x for x in documents.columns if x != "geojson"), *(told[p].alias(p) for p in ("name", "poi_type", "url")), points.alias("points"))


def layers_at(tiles: DataFrame) -> DataFrame:
    """``tiles`` (z, any others) with each layer that shows at their zoom, and whether the base file or a square holds it ("base", "grid")."""
    bands = [(name, z, kind) for name, a, b, c, d in LAYERS for kind, lo, hi in (("base", a, b), ("grid", c, d)) for z in range(lo, hi + 1)]
    return tiles.join(tiles.sparkSession.createDataFrame(bands, "layer string, z int, held string"), "z")
