"""Documents of routes on small cases."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from trailweave.functions.geo import rounded_even
from trailweave.operators import documents

NS = {"g": documents.TRACKS}


def _trail(spark, parts):
    return spark.createDataFrame([(1, k, i, *map(float, p)) for k, part in enumerate(parts) for i, p in enumerate(part)], "route long, part long, seq long, lon double, lat double")


def _pois(spark):
    rows = [(1, 2, "B & <b>", 48.5, 2.5, "train_station", None), (1, 1, "A", -1.0000004, -0.0000001, "train_station", "u"), (1, 3, 'C "c" \\ é', 48.0, 2.0, "hotel", "https://x?a=1&b")]
    return spark.createDataFrame(rows, "route long, ord int, name string, lat double, lon double, poi_type string, url string")


def test_fixed_and_rounded(spark):
    values = [(0.25, 1, "0.2"), (0.35, 1, "0.4"), (2.5, 0, "2"), (-0.04, 1, "0.0"), (-1.25, 1, "-1.2"), (12.0, 3, "12.000"), (0.0005, 3, "0.000"), (1e9 + 0.1, 1, "1000000000.1")]
    for v, digits, text in values:
        row = spark.range(1).select(documents.fixed(F.lit(v), digits).alias("t"), rounded_even(F.lit(v), digits).alias("r")).first()
        assert row.t == text and row.r == float(text), v


def test_track(spark):
    trail = documents.with_elevation(_trail(spark, [[(2, 48), (2.1, 48)], [(3, 48), (3.1, 48.05)]]), spark.createDataFrame([(1, 0, 10.04), (1, 1, None), (1, 2, -3.0)], "route long, i int, ele double"))
    routes = spark.createDataFrame([(1, "Tour & <x>", None), (2, "empty", "d")], "route long, name string, description string")
    got = {r.route: ET.fromstring(r.gpx.encode()) for r in documents.track_documents(routes, trail, _pois(spark)).collect()}
    one = got[1]
    assert [w.find("g:name", NS).text for w in one.findall("g:wpt", NS)] == ["A", "B & <b>"]
    assert one.find("g:metadata/g:name", NS).text == one.find("g:trk/g:name", NS).text == "Tour & <x>"
    segments = one.findall("g:trk/g:trkseg", NS)
    assert [[p.get("lon") for p in s.findall("g:trkpt", NS)] for s in segments] == [["2.000000", "2.100000"], ["3.000000", "3.100000"]]
    assert [[getattr(p.find("g:ele", NS), "text", None) for p in s.findall("g:trkpt", NS)] for s in segments] == [["10.0", None], ["-3.0", None]]
    assert one.find("g:wpt", NS).get("lon") == "0.000000" and got[2].findall("g:trk/g:trkseg", NS) == []


def test_features(spark):
    routes = spark.createDataFrame([(1, 'é "n"'), (9, "no trail")], "route long, name string")
    for parts, kind in (([[(2, 48), (2.1, 48)]], "LineString"), ([[(2, 48), (2.1, 48)], [(3, 48), (3.1, 48)]], "MultiLineString")):
        rows = documents.feature_documents(routes, _trail(spark, parts), _pois(spark)).collect()
        assert [r.route for r in rows] == [1]
        told = json.loads(rows[0].geojson)
        first, *others = told["features"]
        assert first["properties"] == {"id": "1", "name": 'é "n"', "feature_type": "trail"} and "é" in rows[0].geojson
        assert first["geometry"] == {"type": kind, "coordinates": [list(map(list, p)) for p in parts] if len(parts) > 1 else list(map(list, parts[0]))}
        assert [f["properties"] for f in others] == [{"feature_type": "poi", "poi_type": t, "name": n} | ({"url": u} if u else {}) for t, n, u in (("train_station", "A", "u"), ("train_station", "B & <b>", None), ("hotel", 'C "c" \\ é', "https://x?a=1&b"))]


def test_profiles(spark):
    steps = spark.createDataFrame([(1, 0, 0, 0.0, 100.04, 0.0), (1, 0, 1, 1.5, 110.0, 20.04), (1, 2, 0, 0.0, 110.0, 0.0), (1, 2, 1, 2.0004, 90.0, 30.0), (1, 3, 0, 0.5, 80.0, 9.0)], "hike long, step int, seq int, dist_km double, elev_m double, time_min double")
    got = json.loads(documents.profile_documents(steps).first().json)
    assert got == {"distances_km": [0, 1.5, 1.5, 3.5, 4.0], "elevations_m": [100, 110, 110, 90, 80], "times_min": [0, 20, 20, 50, 59], "step_boundaries_km": [1.5, 3.5], "station_positions_km": []}
    stations = spark.createDataFrame([(1, 2.00049), (1, 0.5)], "route long, km double")
    profiles = steps.where("step = 0").withColumnRenamed("hike", "route")
    assert json.loads(documents.elevation_documents(profiles, stations).first().json) == {"distances_km": [0, 1.5], "elevations_m": [100, 110], "times_min": [0, 20], "station_positions_km": [0.5, 2.0]}
    assert documents.elevation_documents(profiles.where("false"), stations).count() == 0
