"""Operators on small cases whose results follow from their definitions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trailweave.functions import geo, text
from trailweave.operators import catalog, folds, graph, lines, spatial, transit
from trailweave.plans import assembly_queries, route_queries, text_queries, transit_queries


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def _gain_loss(elevs):
    gain = loss = pending = 0.0
    for d in (b - a for a, b in zip(elevs, elevs[1:])):
        new = pending + d
        if pending >= 0 > new or pending <= 0 < new:
            gain += pending if pending >= 5 else 0
            loss += -pending if -pending >= 5 else 0
            pending = d
        else:
            pending = new
    return gain + (pending if pending >= 5 else 0), loss + (-pending if -pending >= 5 else 0)


@pytest.mark.parametrize("elevs", [[], [1.0], [0.0, 4.9], [0.0, 5.0], [0.0, 3.0, 6.0, 2.0, 1.0, -9.0], [10.0, 4.0, 8.0, 3.0, 30.0, 30.0, 24.0], [0.0, 0.0, 6.0, 0.0, 6.0]])
def test_gain_loss_counts_swings_over_the_threshold(spark, elevs):
    got = _one(spark, lines.gain_loss(F.array(*map(F.lit, elevs)).cast("array<double>")))
    assert (got["gain"], got["loss"]) == pytest.approx(_gain_loss(elevs))


def _line(spark, points):
    return spark.createDataFrame([(1, i + 1, float(x), float(y), float(e)) for i, (x, y, e) in enumerate(points)], "route long, seq long, lon double, lat double, elev double")


def test_resample_takes_vertices_once_and_adds_the_end(spark):
    step = 1.0 / 111_194.92664455873  # degrees of latitude in a metre on this sphere
    v = _line(spark, [(0, 0, 0), (0, 100 * step, 10), (0, 130 * step, 40)])
    got = lines.resample(v, 50.0).orderBy("k").collect()
    assert [round(r.dist_m) for r in got] == [0, 50, 100, 130]
    assert [round(r.elev, 3) for r in got] == pytest.approx([0, 5, 10, 40], abs=0.01)


def test_as_of_clamps_to_both_ends(spark):
    s = spark.createDataFrame([(1, i + 1, float(i)) for i in range(5)], "route long, seq long, dist_km double")
    t = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 1.5, 3.0, 9.0)], "route long, target_km double")
    assert {r.target_km: r.seq for r in lines.as_of(s, t).collect()} == {-1.0: 1, 0.0: 1, 1.5: 2, 3.0: 4, 9.0: 4}


def test_spurious_parts(spark):
    p = spark.createDataFrame([(1, 0, 300.0), (1, 1, 9.0), (1, 2, 10.0), (1, 3, 14.0), (2, 0, 3.0), (2, 1, 2.0), (2, 2, 0.1), (3, 0, 0.5)], "route int, part int, km double")
    assert sorted((r.route, r.part) for r in lines.drop_spurious(p).collect()) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0)]


def test_walking_time(spark):
    deg = 1000 / 111_194.92664455873
    v = _line(spark, [(0, 0, 0), (0, deg, 0), (0, 2 * deg, 150), (0, 3 * deg, 0), (0, 3 * deg, 9)])
    got = [r.step_min for r in lines.with_time(v).orderBy("seq").collect()]
    assert got == pytest.approx([0, 15, 30, 20, 0], abs=1e-6)


def test_chain_turns_ways_but_never_the_first(spark):
    ways = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 2.0, 0.0, 1.0, 0.0), (1, 2, 2.0, 0.04, 3.0, 0.0), (1, 3, 5.0, 0.0, 6.0, 0.0), (1, 4, 5.5, 0.0, 6.5, 0.0)]
    got = folds.chain_ways(spark.createDataFrame(ways, "route long, pos long, x1 double, y1 double, x2 double, y2 double")).orderBy("pos").collect()
    assert [(r.flipped, r.part) for r in got] == [(False, 0), (True, 0), (False, 0), (False, 1), (False, 2)]


def test_greedy_dedup_keeps_the_nearer_in_its_slot(spark):
    rows = [(1, 1, 10, "a", 0.1, 9.0), (1, 2, 11, "b", 0.3, 5.0), (1, 3, 12, "a", 0.103, 4.0), (1, 4, 13, "c", 0.3005, 8.0), (1, 5, 14, "a", 0.2, 1.0)]
    got = folds.greedy_dedup(spark.createDataFrame(rows, "route long, ord long, site long, name string, frac double, dist double")).orderBy("slot").collect()
    assert [r.site for r in got] == [12, 11, 14]


def test_box_chunks_begin_at_the_last_vertex(spark):
    got = folds.box_chunks(_line(spark, [(0, 0, 0), (2, 0, 0), (4, 1, 0), (5, 1, 0)]), 3.0).orderBy("chunk").collect()
    assert [(r.min_lon, r.max_lon) for r in got] == [(0, 2), (2, 5)]


@pytest.mark.parametrize(
    ("nodes", "km"),
    [
        ([(0, True, False), (10, True, False)], 10), ([(0, False, False), (10, True, False)], None), ([(0, True, False), (10, False, False)], None),
        ([(0, True, False), (10, True, False), (20, True, False)], 20), ([(0, True, False), (10, False, True), (30, True, False)], 30),
        ([(0, True, False), (10, False, False), (30, True, False)], None), ([(0, True, False), (7, True, False)], None), ([], None),
    ],
)
def test_longest_path_needs_trains_at_the_ends_and_hotels_between(spark, nodes, km):
    assert _one(spark, folds.longest_path(_stations([(k, [-1, 7] if t else [7], h) for k, t, h in nodes]), 8.0, 25.0)["km"]) == km


def _stations(nodes):
    each = (F.struct(F.lit(i).alias("idx"), F.lit(float(k)).alias("km"), F.lit(-1 in r).alias("train"), F.lit(h).alias("hotel"), F.array(*map(F.lit, r)).alias("routes")) for i, (k, r, h) in enumerate(nodes))
    return F.array(*each).cast("array<struct<idx: int, km: double, train: boolean, hotel: boolean, routes: array<bigint>>>")


@pytest.mark.parametrize(
    ("nodes", "path"),
    [
        ([(0, [-1], False), (10, [-1, 3], True), (20, [3], True), (30, [3, -1], False)], [0, 1, 3]),  # of equal ways the one over the first node
        ([(0, [-1], False), (20, [-1, 3], True), (40, [3], True), (60, [3, -1], False)], [0, 1, 2, 3]),  # by trains, then by a shared bus route
        ([(0, [-1], False), (20, [-1], False), (40, [-1], False)], [0, 1]),  # a train once reached starts no hike
        ([(0, [-1], True), (10, [4], True), (30, [-1], True)], None),  # nothing joins a train and a bus
        ([(0, [-1], True), (10, [-1], True), (20, [-1], True)], [0, 2]),  # equal lengths: straight from the first
    ],
)
def test_longest_path_gives_its_stations(spark, nodes, path):
    assert _one(spark, folds.longest_path(_stations(nodes), 8.0, 25.0)["path"]) == path


def test_band_join_meets_each_pair_once(spark):
    a = spark.createDataFrame([(1, 45.0, 3.0), (2, 46.0, 3.0)], "site long, lat double, lon double")
    b = spark.createDataFrame([(7, 45.001, 3.001), (8, 45.0, 3.0019), (9, 45.01, 3.0)], "stop long, lat double, lon double")
    assert sorted((r.site, r.stop) for r in spatial.band_join(a, b, 150.0).collect()) == [(1, 7), (1, 8)]


def test_points_inside_polygons(spark):
    square = [(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0)]
    edges = spark.createDataFrame([(1, 5, *map(float, e)) for e in square], "area long, poly long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 3.0, 1.0), (1, 3, -1.0, 1.0), (1, 4, 1.0, 2.5), (2, 5, 1.0, 1.0)], "area long, point long, px double, py double")
    assert [r.point for r in spatial.inside(points, edges).collect()] == [1]


def test_grid_cover_clamps_and_skips_what_is_outside(spark):
    boxes = spark.createDataFrame([(1, 0.5, 0.5, 0.6, 0.6), (2, 0.95, 0.5, 1.05, 0.6), (3, 9.0, 9.0, 9.5, 9.5), (4, 3.99, 3.99, 7.0, 7.0)], "route long, min_lon double, min_lat double, max_lon double, max_lat double")
    got = spatial.grid_cover(boxes, "route", 0.0, 0.0, 4.0, 4.0, 4, 4).collect()
    assert sorted((r.route, r.col, r.row) for r in got) == [(1, 0, 0), (2, 0, 0), (2, 1, 0), (4, 3, 3)]


def test_split_boxes_makes_one_cell_at_least(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.25), (2, 1.0, 1.0, 1.0, 1.0)], "route long, min_lon double, min_lat double, max_lon double, max_lat double")
    got = spatial.split_boxes(boxes, "route", 0.25)
    assert sorted((r.route, r.row, r.col) for r in got.collect()) == [(1, 0, 0), (1, 0, 1), (2, 0, 0)]


@pytest.mark.parametrize(
    ("trigram", "uic", "want"),
    [("ABC", "87123456", {"ABC", "87123456", "8712345", "123456"}), ("", "1234", {"1234", "871234"}), (None, "871", {"871", "87871"}), ("X", None, {"X"}), (None, "", set()), (None, "1234567", {"1234567"})],
)
def test_station_codes(spark, trigram, uic, want):
    got = _one(spark, transit.station_codes(F.lit(trigram).cast("string"), F.lit(uic).cast("string")))
    assert set(got) == want


@pytest.mark.parametrize(("a", "b", "want"), [([-1], [-1], True), ([1, 2], [2], True), ([1], [2], False), ([-1], [3], False), ([], [1], False)])
def test_connected(spark, a, b, want):
    array = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    assert _one(spark, transit.connected(array(a), array(b))) is want


@pytest.mark.parametrize(
    ("top", "gain", "km", "coastal", "forest", "want"),
    [(100, 0, 10, True, 0.0, ["coastal"]), (1500, 900, 20, False, 0.5, ["mountain", "forest"]), (500, 100, 10, False, 0.0, ["hills"]), (200, 300, 10, False, 0.0, ["hills"]), (250, 100, 10, False, 0.4, ["forest", "plains"])],
)
def test_terrain(spark, top, gain, km, coastal, forest, want):
    assert _one(spark, catalog.terrain_tags(F.lit(float(top)), F.lit(float(gain)), F.lit(float(km)), F.lit(coastal), F.lit(forest))) == want


def test_facets(spark):
    rows = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", ["x"]), (3, "A", [])], "id long, region string, tags array<string>")
    ids = lambda r, t: sorted(x.id for x in rows.where(catalog.facet(F.col("region"), F.col("tags"), r, t)).collect())
    assert ids([], []) == [1, 2, 3] and ids(["A"], []) == [1, 3] and ids([], ["x"]) == [1, 2] and ids(["A"], ["x", "z"]) == [1] and ids(["A", "B"], ["y"]) == [1]


def test_upsert_and_carry(spark):
    old = spark.createDataFrame([(1, "a", "i1"), (2, "b", "i2")], "id long, v string, image string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "i3")], "id long, v string, image string")
    merged = catalog.upsert(old, catalog.carry_over(new, old, "id", "image"), "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "i1"), (2, "c", "i2"), (3, "d", "i3")]


@pytest.mark.parametrize(("minutes", "long", "short"), [(45, "45min", "45min"), (60, "1h", "1h00"), (65, "1h5min", "1h05"), (150.4, "2h30min", "2h30"), (119.6, "1h60min", "1h60")])
def test_durations(spark, minutes, long, short):
    assert _one(spark, text.duration_long(F.lit(float(minutes)))) == long
    assert _one(spark, text.duration_short(F.lit(float(minutes)))) == short


def test_text_helpers(spark):
    assert _one(spark, text.slug(F.lit("  Été à l'Île -- 2 !"))) == "ete-a-lile-2"
    assert _one(spark, text.station_slug(F.lit("Saint-Étienne à X"))) == "saint-etienne"
    assert _one(spark, text.natural_list(F.array(*map(F.lit, "abc")), "-")) == "a, b and c"
    assert _one(spark, text.natural_list(F.array().cast("array<string>"), "-")) == "-"
    assert _one(spark, text.replace_once(F.lit("{n} of {n}"), "{n}", F.lit("3"))) == "3 of {n}"
    assert _one(spark, text.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert _one(spark, text.out_of_service(F.array(F.lit("disused:railway")))) and not _one(spark, text.out_of_service(F.array(F.lit("railway"))))
    assert _one(spark, text.split_tags(F.lit(" a;; b "))) == ["a", "b"]


def test_geometry(spark):
    far = _one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert far == pytest.approx(math.pi * 6_371_000)
    assert _one(spark, geo.foot(F.lit(1.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0))) == 0.25
    assert _one(spark, geo.foot(*map(F.lit, (1.0, 5.0, 2.0, 2.0, 2.0, 2.0)))) == 0.0
    assert _one(spark, geo.tile_name(F.lit(-0.5), F.lit(-7.2))) == "S01W008.hgt"
    assert _one(spark, geo.bilinear(*map(F.lit, (0.0, 10.0, 20.0, 30.0, 0.5, 0.5)))) == 15.0
    assert _one(spark, geo.bilinear(*map(F.lit, (0.0, -32768.0, 20.0, 30.0, 0.5, 0.5)))) is None
    assert [_one(spark, c) for c in geo.rgb_channels(F.lit(0.0))] == [1, 134, 160]
    assert _one(spark, geo.tile_samples(F.lit(2 * 1201 * 1201))) == 1201 and _one(spark, geo.tile_samples(F.lit(5))) is None


def _events(spark, path, users):
    """Tables in which user u has users[u] events of one value, and one customer."""
    rows = spark.createDataFrame(list(users.items()), "user_id long, n int")
    rows = rows.select("user_id", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    rows.select(F.col("i").cast("long").alias("event_id"), F.timestamp_seconds("i").alias("ts"), "user_id", F.lit(245.0).alias("value")).write.parquet(f"{path}/events.parquet")
    return str(path)


def _sites(monkeypatch, module, spark, *places):
    made = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "site long, lon double, lat double")
    monkeypatch.setattr(module, "site", lambda spark, d: made)


def test_parts_of_a_route_over_25000_vertices_stay_its_own(spark, tmp_path, monkeypatch):
    path = _events(spark, tmp_path, {0: 25_030})
    _sites(monkeypatch, assembly_queries, spark, (2.0 + 25_010 * 0.002, 43.0))
    assert [(r.site, r.route, r.part) for r in assembly_queries._multipart(spark, path).collect()] == [(0, 0, 1000)]


def test_vertices_of_a_route_over_100000_keep_their_nearest_places(spark, tmp_path, monkeypatch):
    path = _events(spark, tmp_path, {0: 100_001, 1: 1})
    other = (2.0 + 7919 % 997 / 997.0 + 0.002, 43.0 + 104729 % 991 / 991.0)  # at route 1's vertex
    _sites(monkeypatch, route_queries, spark, (2.0 + 100_001 * 0.002 + 0.0199, 43.0), other)
    assert sorted(r.site for r in route_queries._ever_nearest(spark, path).collect()) == [0, 1]


def test_components_of_an_area_over_100000_stations(spark, monkeypatch):
    steps = spark.createDataFrame([(0, 100_001, 100_002, 9.0), (1, 1, 2, 9.0)], "area int, src int, dst int, km double")
    monkeypatch.setattr(transit_queries, "_edges", lambda spark, d: steps)
    assert [r.nodes for r in transit_queries._components(spark, None).collect()] == [2, 2]


def _nodes_table(kms):
    return [(area, i, float(km)) for area, line in kms.items() for i, km in enumerate(line, 1)]


def test_round_trip_keeps_only_loops_that_steps_join(spark, monkeypatch):
    made = spark.createDataFrame(_nodes_table({0: [0, 10, 20, 30, 40], 1: [0, 10, 40, 50], 2: [0, 9, 12, 21, 30], 3: [0]}), "area int, idx int, km double")
    monkeypatch.setattr(transit_queries, "_nodes", lambda spark, d: made)
    got = {r.area: (r.wraps, r.total_km, r.lo, r.hi, r.path) for r in transit_queries._round_trip(spark, None).collect()}
    assert got == {0: (2, 46.0, 1, 4, "1>2>4"), 2: (5, 36.0, 1, 3, "1>3")}
    assert 1 in {r.area for r in transit_queries._wraps(spark, None).collect()}


PLACES = [
    ("De Vannes à Auray", "Auray"), ("  Du Bourg au Croisic \u00a0", "Croisic"), ("Des Monts aux Étangs bleus", "Étangs bleus"), ("De à Paris", "Paris"), ("Au fil de la Seine", None), ("De Vannes à pied", None),
    ("De Vannes à Auray, par la côte", None), ("Deçà au Nord", None), ("to Brest of Brittany", None), ("", None), ("De là\u2028à Brest", "Brest"), ("De Caen à X", None), ("De Caen à X ", None),
]


def test_destinations_are_found_in_every_line_by_the_names_rule(spark, tmp_path):
    import duckdb

    text_rows = [(1, "\n".join(p for p, _ in PLACES)), (2, "first line\nDe Vannes à Auray"), (3, None)]
    spark.createDataFrame(text_rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = text_queries.QUERIES["destination_lines"]
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert got == [(1, i, want) for i, (_, want) in enumerate(PLACES, 1)] + [(2, 1, None), (2, 2, "Auray")]
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.execute(sql).fetchall()) == got


def test_label_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 40), (50, 60)], "a long, b long")
    got = {r.node: r.component for r in graph.label_components(edges).collect()}
    assert got == {**{i: 0 for i in range(13)}, 40: 40, 50: 40, 60: 40}
