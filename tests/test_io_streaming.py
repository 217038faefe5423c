"""Readers, writers and streams on files written here."""

from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F

from trailweave.sources import readers, writers
from trailweave.streaming import windows


def test_feed_stops(spark, tmp_path):
    def point(stop, resource, at=(2.0, 45.0), kind="Point"):
        return {"type": "Feature", "properties": {"stop_id": stop, "resource_id": resource}, "geometry": {"type": kind, "coordinates": list(at)}}

    f = {"type": "FeatureCollection", "features": [point("a", "7"), point("a", "8", (3.0, 46.0)), point("", "7"), point("b", None), point("c", "x"), point("d", "9", (1.0,)), point("e", "5", kind="LineString")]}
    (tmp_path / "stops.json").write_text(json.dumps(f))
    got = readers.feed_stops(spark, str(tmp_path / "stops.json")).collect()
    assert [(r.stop_id, r.resource_id, r.lat, r.lon) for r in got] == [("a", 7, 45.0, 2.0)]


def test_catalog_and_elements(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"generated_at": "x", "routes": [{"id": "1", "slug": "s", "terrain": ["hills"]}]}))
    assert [(r.id, r.terrain, r.region) for r in readers.catalog(spark, str(tmp_path / "c.json")).collect()] == [("1", ["hills"], None)]
    e = {"elements": [{"type": "node", "id": 1, "tags": {"railway": "halt"}}, {"type": "way", "id": 2, "geometry": [{"lat": 1, "lon": 2}]}, {"type": "way", "id": 3, "geometry": [{"lat": 1, "lon": 2}] * 2}]}
    (tmp_path / "e.json").write_text(json.dumps(e))
    assert [r.id for r in readers.elements(spark, str(tmp_path / "e.json"), "way").collect()] == [3]


def test_feed_table_and_seeds(spark, tmp_path):
    (tmp_path / "trips.txt").write_bytes("﻿trip_id,route_id\n1,a\n".encode())
    assert [tuple(r) for r in readers.feed_table(spark, str(tmp_path / "trips.txt"), "trip_id route_id note").collect()] == [("1", "a", None)]
    got = readers.seeds(spark, [{"ref": "GR 2", "relation_id": 1}, {"ref": "GR 10", "relation_id": 2, "name": "n"}, {"ref": "GR 1"}]).collect()
    assert [(r.ref, r.name) for r in got] == [("GR 10", "n"), ("GR 2", "")]


def test_elevation_tiles(spark, tmp_path):
    (tmp_path / "N45E006.hgt").write_bytes(struct.pack(">9h", 1, 2, 3, -32768, 5, 6, 7, 8, -9))
    (tmp_path / "N46E006.hgt").write_bytes(b"odd")
    got = readers.elevation_tiles(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.tile, r.samples) for r in got] == [("N45E006", [1, 2, 3]), ("N45E006", [None, 5, 6]), ("N45E006", [7, 8, -9])]


def test_fresh_answers(spark):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01', 1), ('a', timestamp'2024-02-01', 2), ('b', timestamp'2023-01-01', 3) t(key, fetched_at, v)")
    assert [r.v for r in readers.fresh(rows, 60, "2024-02-10 00:00:00").collect()] == [2]


def test_writers(spark, tmp_path):
    writers.write_tiles(spark.createDataFrame([(3, 1, 2, b"x")], "z int, x int, y int, blob binary"), str(tmp_path / "tiles"))
    assert [(r.z, r.y) for r in spark.read.parquet(str(tmp_path / "tiles")).collect()] == [(3, 5)]
    writers.write_texts(spark.createDataFrame([("a", "<gpx/>")], "id string, gpx string"), "id", "gpx", str(tmp_path / "gpx"))
    assert [(r.key, r.value) for r in spark.read.text(str(tmp_path / "gpx")).collect()] == [("a", "<gpx/>")]
    writers.write_routes(spark.createDataFrame([("1", "R")], "id string, region string"), str(tmp_path / "routes"))
    assert spark.read.json(str(tmp_path / "routes")).count() == 1


def test_tumbling_stream_equals_batch(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{data}/events.parquet")
    stream = windows.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling(spark.read.parquet(f"{data}/events.parquet"))
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)
    assert windows.sessions(spark.read.parquet(f"{data}/events.parquet")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_merged_batches_keep_the_newest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, schema = str(tmp_path / "table"), "id long, at long, v string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    (tmp_path / "in" / "1.json").write_text('{"id":1,"at":1,"v":"a"}\n{"id":1,"at":2,"v":"b"}\n{"id":2,"at":1,"v":"c"}\n')
    q = windows.merge_batches(stream, "id", "at", out, str(tmp_path / "state"))
    q.processAllAvailable()
    (tmp_path / "in" / "2.json").write_text('{"id":2,"at":5,"v":"d"}\n{"id":3,"at":5,"v":"e"}\n')
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{out}/v1").collect()) == [(1, "b"), (2, "d"), (3, "e")]
