"""Files without a network, stations that stay, samples as shares, landmarks in words: small cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.functions import text as tx
from trailweave.operators import lines, offline, spatial

BASE = [("base/a", 100), ("base/b", 7)]
FILES = [(0, 0, "g/0_0", 10), (0, 1, "g/0_1", 20), (1, 1, "g/1_1", 40)]


def _cover(spark, rows):
    return spark.createDataFrame(rows, "route long, col int, row int")


def _needed(spark, rows):
    return offline.needed_files(_cover(spark, rows), spark.createDataFrame(FILES, "col int, row int, path string, size long"))


def _present(spark, rows):
    return spark.createDataFrame(rows, "path string, size long")


def test_downloads_count_absent_and_outdated_files_once(spark):
    needed = _needed(spark, [(1, 0, 0), (1, 0, 0), (1, 0, 1), (2, 1, 1)])
    routes = spark.createDataFrame([(1,), (2,), (2,), (3,)], "route long")
    present = _present(spark, [("base/a", 100), ("g/0_0", 10), ("g/0_0", 10), ("g/1_1", 39)])
    got = {r.route: (r.files, r.bytes) for r in offline.to_download(routes, needed, BASE, present).collect()}
    assert got == {1: (2, 27), 2: (2, 47), 3: (1, 7)}
    everything = _present(spark, BASE + [(p, n) for *_, p, n in FILES])
    assert {(r.files, r.bytes) for r in offline.to_download(routes, needed, BASE, everything).collect()} == {(0, 0)}


def test_a_removal_frees_what_no_other_line_needs(spark):
    needed = _needed(spark, [(1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 1, 1), (3, 0, 1)])
    assert {r.route: (r.files, r.bytes) for r in offline.freed_by_removal(needed).collect()} == {1: (1, 10), 2: (1, 40), 3: (0, 0)}


def test_base_files_go_with_the_last_line(spark):
    present = _present(spark, [("base/a", 100), ("g/0_0", 10), ("g/1_1", 40)])
    some = {r.path for r in offline.unreferenced(present, _needed(spark, [(1, 0, 0)]), BASE).collect()}
    assert some == {"g/1_1"}
    assert {r.path for r in offline.unreferenced(present, _needed(spark, []), BASE).collect()} == {"base/a", "g/0_0", "g/1_1"}


def test_stations_stay_if_nearest_once_or_alone(spark):
    vertices = spark.createDataFrame([(r, i, 2.0 + i * 0.001, 45.0) for r in (1, 2, 3) for i in range(5)], "route long, seq long, lon double, lat double")
    rows = [
        (1, 1, 10, 2.0, 45.001), (1, 2, 11, 2.0, 45.002), (1, 3, 12, 2.004, 45.001),  # 11 is always behind 10
        (2, 1, 20, 9.0, 9.0),  # alone, though far away
        (3, 2, 5, 2.002, 45.001), (3, 1, 6, 2.002, 45.001), (3, 3, 30, 2.0, 46.0),  # equals: the first in order; none within reach
    ]
    kept = spatial.nearest_kept(spark.createDataFrame(rows, "route long, ord int, site long, lon double, lat double"), vertices, 5000.0)
    assert sorted((r.route, r.site) for r in kept.select("route", "site").collect()) == [(1, 10), (1, 12), (2, 20), (3, 6)]


def test_samples_skip_gaps_and_end_at_one(spark):
    step = 0.001  # some 111.19 m along the meridian
    rows = [(1, 0, 1, 2.0, 45.0), (1, 0, 2, 2.0, 45.0), (1, 0, 3, 2.0, 45.0 + step), (1, 1, 4, 3.0, 46.0), (1, 1, 5, 3.0, 46.0 + step)]
    rows += [(2, 0, 1, 2.0, 45.0), (2, 0, 2, 2.0, 45.0), (3, 0, 1, 2.0, 45.0), (4, 0, 1, 2.0, 45.0), (4, 1, 2, 5.0, 45.0)]
    v = spark.createDataFrame(rows, "route long, part long, seq long, lon double, lat double")
    got = lines.sample_shares(v, 50.0).orderBy("route", "k").collect()
    assert {r.route for r in got} == {1}  # lines without a length have no sample
    assert [r.k for r in got] == [0, 1, 2, 3, 4, 5]
    assert got[0].share == 0.0 and got[-1].share == 1.0 and got[-1].lat == 46.0 + step
    assert [round(r.share * 222.39, 0) for r in got[1:5]] == [50, 100, 150, 200]
    assert [r.lon for r in got] == [2.0, 2.0, 2.0, 3.0, 3.0, 3.0]  # nothing lies in the gap


def test_landmarks_in_words_and_transport_kinds(spark):
    kind = "array<struct<name: string, kind: string>>"
    rows = [(0, []), (1, [("Old Keep", "castle"), (None, "peak"), ("", "wind_mill"), ("Fourth", "fort")]), (2, [("Mill", "wind_mill")]), (3, None)]
    df = spark.createDataFrame(rows, f"id int, marks {kind}")
    got = {r.id: r.phrase for r in df.select("id", tx.landmark_prose(F.col("marks")).alias("phrase")).collect()}
    assert got == {0: "", 1: "Old Keep (a hilltop medieval castle), a prominent rocky peak", 2: "Mill (wind mill)", 3: ""}
    tags = [(0, {"railway": "halt", "highway": "bus_stop"}), (1, {"highway": "bus_stop"}), (2, {"public_transport": "platform", "bus": "yes"}), (3, {"public_transport": "platform"}), (4, {}), (5, None)]
    told = spark.createDataFrame(tags, "id int, tags map<string, string>").select("id", tx.transport_kind(F.col("tags")).alias("kind")).collect()
    assert {r.id: r.kind for r in told} == {0: "train", 1: "bus", 2: "bus", 3: "train", 4: "train", 5: "train"}
