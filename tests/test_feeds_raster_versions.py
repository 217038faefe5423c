"""Feeds out of archives, heights and map tiles, woods as one area, versioned tables: small cases."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from trailweave.operators import forests, raster
from trailweave.sources import feeds, readers
from trailweave.sources.versions import Versions

TRIPS, TIMES = "trip_id,route_id\r\nt1,r1\r\nt2,r2\r\nt1,r3\r\n,r4\r\nt5,\r\n", "stop_id,trip_id,note\r\ns1,t1,\"a, b\"\r\ns1,t2,\r\ns2,t9,\r\n,t1,\r\ns2,t5,x\r\n"


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(f"{name}.txt", text)
    return out.getvalue()


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("feeds")
    whole = _zip(trips="﻿" + TRIPS, stop_times=TIMES, routes="route_id,route_short_name,route_long_name\nr1, 12 ,Long\nr2,,Far\nr3,,\nr3, ,\nr2,,\n,9,9\n")
    bad = bytearray(_zip(trips=TRIPS, stop_times=TIMES * 500))
    bad[len(bad) // 2] ^= 255
    files = {
        "whole": whole, "bare": _zip(trips=TRIPS.replace("r1", "x1"), stop_times=TIMES), "no_trips": _zip(stop_times=TIMES), "no_times": _zip(trips=TRIPS), "half": whole[: len(whole) // 2], "empty": b"", "flipped": bytes(bad),
        "no_columns": _zip(trips="a,b\n1,2\n", stop_times="a\n1\n"), "latin": _zip(trips=TRIPS.encode() + b"\xe9,r\n", stop_times=TIMES), "blank": _zip(trips="", stop_times=""),
    }
    for name, content in files.items():
        (at / f"{name}.zip").write_bytes(content)
    files = spark.read.format("binaryFile").load(str(at)).select("path", "content")
    return feeds.Feeds(files.where("not path like '%empty%'").unionByName(spark.createDataFrame([("empty.zip", b"")], "path string, content binary")))  # Spark skips files without a byte


def test_damaged_feeds_give_one_line_of_error_and_no_row(fed):
    assert {r.feed: r.error for r in fed.errors.collect()} == {"no_trips": "no trips.txt", "no_times": "no stop_times.txt", "half": "damaged archive", "empty": "damaged archive", "flipped": "damaged archive", "latin": "damaged table"}
    assert {r.feed for r in fed.trips.collect()} == {"whole", "bare"} == {r.feed for r in fed.stop_times.collect()}


def test_feed_tables(fed):
    assert sorted((r.feed, r.trip_id, r.route_id) for r in fed.trips.collect()) == [("bare", "t1", "r3"), ("bare", "t2", "r2"), ("whole", "t1", "r3"), ("whole", "t2", "r2")]
    assert sorted((r.stop_id, r.route_id) for r in fed.connectivity().collect()) == [("s1", "r2"), ("s1", "r3")]
    assert sorted((r.route_id, r.name) for r in fed.route_names().collect()) == [("r1", "12"), ("r2", "Far")]


def test_packed_feeds_are_read_back(spark):
    rows = [(f, m, i, x) for f in ("a", "b") for m, lines in (("trips.txt", ["trip_id,route_id", f"1,{f}"]), ("stop_times.txt", ["trip_id,stop_id", '1,"s ""x"", y"', "1,z"])) for i, x in enumerate(lines)]
    packed = feeds.packed_feeds(spark.createDataFrame(rows, "feed string, member string, row long, line string").repartition(3))
    assert sorted((r.stop_id, r.route_id) for r in feeds.Feeds(packed).connectivity().collect()) == [(s, r) for s in ('s "x", y', "z") for r in "ab"]
    assert feeds.packed_feeds(spark.createDataFrame([], "feed string, member string, row long, line string")).count() == 0


def _blocks(spark, tiles, block):
    rows = [(la, lo, r, line) for (la, lo), grid in tiles.items() for r, line in enumerate(grid)]
    return raster.blocks_of(spark.createDataFrame(rows, "lat0 int, lon0 int, row int, samples array<int>"), block)


def _height(tiles, lat, lon):
    import math

    grid = tiles.get((math.floor(lat), math.floor(lon)))
    if grid is None:
        return None
    n = len(grid)
    y, x = (lat - math.floor(lat)) * (n - 1), (lon - math.floor(lon)) * (n - 1)
    r, c = min(int(y), n - 2), min(int(x), n - 2)
    s = [[grid[n - 1 - r - i][c + j] for j in (0, 1)] for i in (0, 1)]
    if any(v is None for line in s for v in line):
        return None
    low, high = (s[i][0] + (s[i][1] - s[i][0]) * (x - c) for i in (0, 1))
    return low + (high - low) * (y - r)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_heights(spark, block):
    tiles = {(45, 6): [[10, 20, 30, 40], [50, None, 70, 80], [90, 100, 110, 120], [5, 6, 7, 8]], (45, 7): [[40, 0], [8, 100]], (-1, -2): [[1, 2, 3], [4, 5, 6], [7, 8, 9]]}
    places = [(45.0, 6.0), (45.1, 6.1), (45.999, 6.999), (45.6, 6.5), (45.25, 6.75), (45.5, 7.25), (45.3, 7.0), (44.9, 6.5), (-0.5, -1.5), (-0.25, -1.01), (-0.0001, -1.9999), (45.1, 6.1)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lat double, lon double")
    got = {r.id: r.height for r in raster.heights(df, _blocks(spark, tiles, block), block).collect()}
    assert len(got) == len(places)
    for i, p in enumerate(places):
        want = _height(tiles, *p)
        assert got[i] == (None if want is None else pytest.approx(want, abs=1e-9)), p


def test_heights_of_tile_files(spark, tmp_path):
    (tmp_path / "S01W002.hgt").write_bytes(struct.pack(">9h", *range(1, 10)))
    rows = readers.elevation_tiles(spark, str(tmp_path))
    lat0, lon0 = raster.tile_corner(F.col("tile"))
    blocks = raster.blocks_of(rows.withColumn("lat0", lat0).withColumn("lon0", lon0))
    assert raster.heights(spark.createDataFrame([(-0.5, -1.5)], "lat double, lon double"), blocks).first().height == 5.0


def test_pyramid(spark):
    boxes = lambda *b: spark.createDataFrame([tuple(map(float, x)) for x in b], "min_lon double, min_lat double, max_lon double, max_lat double")
    tiles = lambda df: sorted((r.z, r.x, r.y) for r in df.collect())
    assert tiles(raster.pyramid(boxes((-180, -90, 180, 90)), 0, 1)) == [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    assert tiles(raster.pyramid(boxes((0, 0, 90, 66.5)), 2, 2)) == [(2, 2, 1)]  # edges to the east and south belong to the next tile
    assert tiles(raster.pyramid(boxes((170, 1, -170, 2)), 2, 2)) == [(2, 0, 1), (2, 3, 1)]
    assert tiles(raster.pyramid(boxes((2.35, 48.85, 2.35, 48.85), (2.35, 48.85, 2.36, 48.86)), 10, 10)) == [(10, 518, 352)]


def test_coded_windows_cross_tile_borders(spark):
    tiles = {(0, 0): [[100, 100], [100, 100]], (0, 1): [[200, 200], [200, 200]]}
    t = spark.createDataFrame([(8, 128, 127)], "z int, x long, y long")  # lon 0 to 1.40625, lat 0 to 1.4
    w = raster.coded_windows(t, _blocks(spark, tiles, 256), 4).first()
    assert w.tms_y == 128 and len(w.pixels) == 48
    metres = [int.from_bytes(w.pixels[i : i + 3]) / 10 - 10000 for i in range(0, 48, 3)]
    assert metres == [0, 0, 0, 0] + [100, 100, 100, 200] * 3 or metres[4:] == [100, 100, 100, 200] * 3


SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]  # lat, lon: around, closed by the reader


def _share(spark, line, rings, points=5):
    trail = spark.createDataFrame([(1, k, i, *map(float, p)) for k, part in enumerate(line) for i, p in enumerate(part)], "route long, part long, seq long, lon double, lat double")
    made = spark.createDataFrame([(i, [tuple(map(float, p)) for p in r]) for i, r in enumerate(rings)], "ring int, points array<struct<lat: double, lon: double>>")
    return forests.covered_share(trail, made, points).first().ratio


@pytest.mark.parametrize(
    ("line", "rings", "ratio"),
    [
        ([[(0.2, 0.5), (0.8, 0.5)]], [], 0), ([[(0.2, 0.5), (0.8, 0.5)]], [SQUARE], 1), ([[(2, 0.5), (3, 0.5)]], [SQUARE], 0), ([[(0.5, 0.5), (1.5, 0.5)]], [SQUARE], 0.4),  # the boundary is outside
        ([[(0.2, 0.5), (1.8, 0.5)]], [SQUARE, [(y, x + 1) for y, x in SQUARE]], 1), ([[(0.2, 0.5), (1.8, 0.5)]], [SQUARE, [(y, x + 1) for y, x in SQUARE][::-1]], 1),  # an edge that both share is inside
        ([[(0.2, 0.5), (1.4, 0.5)]], [SQUARE, [(y, x + 0.5) for y, x in SQUARE]], 1), ([[(0.0, 0.25), (0.0, 0.75)]], [SQUARE, SQUARE], 0),  # twice on one side is still the boundary
        ([[(0.25, 0.5), (0.5, 0.5)], [(5.0, 0.5), (5.25, 0.5)]], [SQUARE], 0.6), ([[(0.5, 0.5), (0.5, 0.5)]], [SQUARE], 0), ([[(0.5, 0.2), (0.5, 0.8)]], [SQUARE[:2]], 0), ([[(0.2, 0.0), (0.8, 0.0)]], [SQUARE], 0),
    ],
)
def test_covered_share(spark, line, rings, ratio):
    assert _share(spark, line, rings) == ratio


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, at long, v string")
    t = Versions(spark, str(tmp_path / "t"))
    assert t.read() is None and t.last() == (-1, None)
    assert t.merge(rows((1, 1, "a"), (1, 2, "b"), (2, 5, "c")), ["id"], F.col("at"), 4) == 0
    assert t.merge(rows((1, 9, "again")), ["id"], F.col("at"), 4) == 0 and t.merge(rows((1, 9, "late")), ["id"], F.col("at"), 2) == 0  # batches merged before
    assert t.merge(rows((2, 4, "older"), (3, 1, "d"), (1, 2, "same")), ["id"], F.col("at"), 9) == 1  # some numbers were left out
    assert _rows(t.read()) == [(1, 2, "same"), (2, 5, "c"), (3, 1, "d")]
    (tmp_path / "t" / "v2").mkdir()  # what an attempt that died has left
    (tmp_path / "t" / "v2" / "part-0.parquet").write_bytes(b"half")
    assert Versions(spark, str(tmp_path / "t")).last() == (1, 9)
    assert t.insert(rows((3, 8, "not again"), (4, 8, "e")), ["id"]) == 2
    assert _rows(t.read()) == [(1, 2, "same"), (2, 5, "c"), (3, 1, "d"), (4, 8, "e")]
    with pytest.raises(Exception, match="several rows of one key"):
        t.insert(rows((7, 1, "x"), (7, 2, "y")), ["id"])
    assert t.last()[0] == 2
    t.clean(1)
    assert t.numbers() == [2] and not (tmp_path / "t" / "v0").exists() and t.read().count() == 4
    with pytest.raises(Exception, match="(?i)exist"):  # a second writer of one version
        t._fs.create(t._path(f"{t.path}/_pointers/2"), False)
