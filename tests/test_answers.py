"""Captured answers, coerced entries, catalogs in their envelope, features read back: small cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trailweave.sources import answers


def test_answers_by_age_and_failure(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    day = "key string, fetched_at timestamp_ntz, body string"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 2) - dt.timedelta(hours=h)
    cached = spark.createDataFrame([("young", at(1), "y"), ("young", at(9), "old"), ("edge", at(24), "e"), ("past", at(25), "p"), ("failed", at(99), "s")], day)
    fetched = spark.createDataFrame([("young", "Y"), ("past", "P"), ("failed", None), ("new", "N")], "key string, body string")
    asked = spark.createDataFrame([(k,) for k in ("young", "edge", "past", "failed", "new", "nothing", "new")], "key string")
    got = {r.key: (r.body, r.state) for r in answers.answered(asked, cached, fetched, 86400, now).collect()}
    assert got == {"young": ("y", "cached"), "edge": ("e", "cached"), "past": ("P", "fetched"), "failed": ("s", "stale"), "new": ("N", "fetched"), "nothing": (None, "none")}
    passed_by = {r.key: (r.body, r.state) for r in answers.answered(asked, cached, fetched, 0, now).collect()}
    assert passed_by["young"] == ("Y", "fetched") and passed_by["edge"] == ("e", "stale")


def test_entries_are_coerced(spark):
    texts = ['{"id": 7}', '{"id": "x", "distance_km": "7.5", "osm_relation_id": "12", "elevation_gain_m": 3.9, "bbox": [1, "2", null, "x"], "terrain": null, "pois": [{"url": ""}, {"name": "n", "distance_km": "1.5", "transit_lines": null}], "image_path": "i"}', "not json"]
    rows = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(answers.entry(F.col("t")).alias("e")).collect()]
    assert (rows[0].id, rows[0].slug, rows[0].distance_km, rows[0].terrain, rows[0].bbox, rows[0].pois, rows[0].image_path, rows[0].is_circular_trail) == ("7", "", 0.0, [], [0.0] * 4, [], None, False)
    assert (rows[1].distance_km, rows[1].osm_relation_id, rows[1].elevation_gain_m, rows[1].bbox, rows[1].terrain) == (7.5, 12, 3, [1.0, 2.0, 0.0, 0.0], [])
    assert [(p.name, p.url, p.distance_km, p.transit_lines, p.lat) for p in rows[1].pois] == [("", None, None, [], 0.0), ("n", None, 1.5, [], 0.0)]
    assert rows[2].id == ""


def test_catalogs_in_their_envelope(spark):
    rows = spark.createDataFrame([("a", "GR 2", 1, '{"i": 1}'), ("a", "GR 10", 2, '{"i": 2}'), ("b", "x", 3, '{"i": 3}')], "region string, path_ref string, ord int, json string")
    got = {r.region: json.loads(r.json) for r in answers.catalog_documents(rows, "region", "2024", 'a "source"', "l").collect()}
    assert got["a"] == {"generated_at": "2024", "source": 'a "source"', "license": "l", "routes": [{"i": 2}, {"i": 1}]} and len(got["b"]["routes"]) == 1


def test_features_by_kind(spark):
    feature = lambda kind, shape, at, **more: {"type": "Feature", "properties": {"feature_type": kind, "name": "n", **more}, "geometry": {"type": shape, "coordinates": at}}
    doc = {"type": "FeatureCollection", "features": [feature("trail", "MultiLineString", [[[1, 2], [3, 4]], [[5, 6.5]]]), feature("trail", "LineString", [[7, 8]]), feature("poi", "Point", [9, 10], poi_type="hotel", url="u")]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "route int, geojson string")
    assert [r.points for r in answers.features_of(df, "trail").collect()] == [[[1, 2], [3, 4], [5, 6.5]], [[7, 8]]]
    assert [tuple(r) for r in answers.features_of(df, "poi").collect()] == [(1, "n", "hotel", "u", [[9, 10]])]


def test_layers_by_zoom(spark):
    got = sorted((r.z, r.layer, r.held) for r in answers.layers_at(spark.createDataFrame([(5,), (7,), (12,)], "z int")).collect())
    assert got == [(7, "france", "base"), (7, "hillshade", "base"), (12, "contours", "grid"), (12, "france", "grid")]
