"""Scans of map elements and walks to the trail, on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trailweave.operators import connectors
from trailweave.sources import readers, scans


@pytest.fixture
def found(spark, tmp_path):
    def node(i, lat=48.0, lon=2.0, kind="node", **tags):
        return {"type": kind, "id": i, "lat": lat, "lon": lon, "tags": {k.replace("__", ":"): v for k, v in tags.items()}}

    ring = [{"lat": float(i), "lon": 1.0} for i in range(4)]
    rows = [
        node(1, railway="station", name="A"),
        node(2, railway="halt", disused="yes"),
        node(3, public_transport="platform", bus="yes"),
        node(4, public_transport="platform"),
        node(5, tourism="camp_site", name="Camp", contact__website="c"),
        node(6, tourism="hotel", name=""),
        {"type": "way", "id": 7, "center": {"lat": 48.5, "lon": 2.5}, "tags": {"tourism": "hostel", "name": "H", "website": "w"}},
        {"type": "way", "id": 8, "tags": {"tourism": "hotel", "name": "nowhere"}},
        node(9, historic="castle", natural="peak", name=" K ", ele="-12.9"),
        node(10, natural="peak", ele="high"),
        node(11, natural="tree", name="T"),
        {"type": "way", "id": 12, "tags": {"landuse": "forest"}, "geometry": ring},
        {"type": "way", "id": 13, "tags": {"natural": "wood"}, "geometry": ring[:3]},
        {"type": "relation", "id": 14, "tags": {"natural": "wood"}, "members": [{"type": "way", "ref": 1, "geometry": ring}, {"type": "way", "ref": 2}, {"type": "way", "ref": 3, "geometry": ring}]},
    ]
    path = tmp_path / "elements.json"
    path.write_text(json.dumps({"elements": rows}))
    return readers.elements(spark, str(path))


def _ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_kinds(found):
    assert _ids(scans.stations(found)) == [1, 3]
    beds = {r["id"]: (r["poi_type"], r["url"], r["lat"]) for r in scans.accommodation(found).collect()}
    assert beds == {5: ("camping", "c", 48.0), 7: ("hotel", "w", 48.5)}
    sights = {r["id"]: (r["name"], r["kind"], r["elevation_m"]) for r in scans.landmarks(found).collect()}
    assert sights == {9: ("K", "castle", -12), 10: ("", "peak", None)}
    assert sorted((r["id"], r["ring"]) for r in scans.forests(found).collect()) == [(12, 0), (14, 0), (14, 2)]


def test_scan_by_boxes(spark):
    rows = spark.createDataFrame([(1, 48.0, 2.0), (2, 48.0, 2.0), (3, 48.04, 2.0), (4, 48.06, 2.0), (5, 49.5, 2.0)], "id int, lat double, lon double")
    boxes = spark.createDataFrame([(7, 0, 1.0, 47.0, 2.0, 48.0), (7, 1, 1.9, 47.9, 2.1, 49.6), (8, 0, -1.0, -1.0, 0.0, 0.0)], "route int, chunk int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = scans.scan(rows, boxes, 0.05, ["lat", "lon"], "id").select("route", "chunk", "id").collect()
    assert sorted(map(tuple, got)) == [(7, 0, 1), (7, 0, 3), (7, 1, 4), (7, 1, 5)]


def test_landmark_key(spark):
    row = spark.createDataFrame([("peak", 48.1234567, 2.0)], "kind string, lat double, lon double").select(scans.landmark_key().alias("k")).first()
    assert row["k"] == "peak:48.12346,2.00000"


def test_feed_urls(spark, tmp_path):
    feed = lambda i, url, kind="GTFS", there=True: {"id": i, "format": kind, "is_available": there, "url": url}
    path = tmp_path / "sets.json"
    path.write_text(json.dumps([{"resources": [feed(1, "a"), feed(2, "b", "NeTEx"), feed(3, "c", there=False)]}, {}, {"resources": [feed(1, "d"), feed(4, "")]}]))
    assert [tuple(r) for r in scans.feed_urls(spark, str(path)).collect()] == [(1, "d")]


def _line(*xs):
    return [(float(x), 0.0) for x in xs]


LINE = "array<struct<lon: double, lat: double>>"


def test_lines_join_at_the_trail(spark):
    rows = [(_line(0, 1, 2), _line(2, 3, 4), _line(4, 5, 6)), (None, _line(2, 3), None), (_line(0, 1, 9), _line(2, 4), None), (None, _line(2, 4), _line(9, 5))]
    got = spark.createDataFrame(rows, f"a {LINE}, t {LINE}, b {LINE}").select(connectors.concatenated(F.col("a"), F.col("t"), F.col("b")).alias("x")).collect()
    assert [[p["lon"] for p in r["x"]] for r in got] == [[0, 1, 2, 3, 4, 5, 6], [2, 3], [0, 1, 2, 4], [2, 4, 5]]


def test_routing_answers(spark):
    route = lambda points, metres: json.dumps({"routes": [{"geometry": {"coordinates": points}, "distance": metres}]})
    rows = [(route([[2, 48], [2.1, 48.1]], 1500),), (route([[2, 48]], 5),), (json.dumps({"routes": []}),), ("no json",), (None,)]
    got = [r["w"] for r in spark.createDataFrame(rows, "x string").select(connectors.walked(F.col("x")).alias("w")).collect()]
    assert got[0]["km"] == 1.5 and [tuple(p) for p in got[0]["line"]] == [(2.0, 48.0), (2.1, 48.1)] and got[1:] == [None] * 4
    rows = [('{"distances": [[1, null, 2.5]]}',), ('{"distances": [[1, 2]]}',), ('{"distances": [["x", 1, 2]]}',), ("{}",), (None,)]
    got = [r["m"] for r in spark.createDataFrame(rows, "x string").select(connectors.walked_metres(F.col("x"), 3).alias("m")).collect()]
    assert got == [[1.0, None, 2.5], [None] * 3, [None, 1.0, 2.0], [None] * 3, [None] * 3]


def test_steps_get_their_walks(spark):
    point = "struct<lon: double, lat: double>"
    stations = spark.createDataFrame([("a", 48.0, 2.0, (2.005, 48.002), 500.0), ("b", 48.01, 2.1, (2.099, 48.009), 500.0), ("c", 48.01, 2.1, (2.1, 48.01), 99.0)], f"code string, lat double, lon double, junction {point}, off_m double")
    answer = json.dumps({"routes": [{"geometry": {"coordinates": [[2.0, 48.0], [2.003, 48.001], [2.005, 48.002]]}, "distance": 500}]})
    walks = spark.createDataFrame([("a", "to_trail", answer)], "code string, direction string, answer string")
    trail = [(2.005, 48.002), (2.05, 48.005), (2.099, 48.009)]
    steps = spark.createDataFrame([(1, "a", "b", trail, 10.0), (2, "a", "c", trail, 10.0), (3, "c", "c", trail, 10.0)], f"step int, start string, end string, line {LINE}, km double")
    got = {r["step"]: r for r in connectors.attach(steps, stations, walks, 100.0).collect()}
    lons = {k: [p["lon"] for p in r["line"]] for k, r in got.items()}
    assert lons == {1: [2.0, 2.003, 2.005, 2.05, 2.099, 2.1], 2: [2.0, 2.003, 2.005, 2.05, 2.099], 3: [2.005, 2.05, 2.099]}
    assert (got[1]["km"], got[2]["km"], got[3]["km"]) == (10.6, 10.5, 10.0)
