"""Joins of places and lines that stay small on large tables: what they give, and that no task sends or sorts all pairs."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from trailweave.operators import folds, forests, spatial, transit
from trailweave.plans import registry
from trailweave.sources import scans


def _plan(spark, data, name):
    return registry.QUERIES[name][0](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["station_trail_match", "match_gate", "multipart_match", "poi_within_radius", "section_gate", "connector_attach", "greedy_station_dedup"])
def test_matches_of_a_line_stay_in_its_task(spark, data, name):
    """No pair of a place and a line is sent by its place, nor sorted for an aggregation."""
    plan = _plan(spark, data, name)
    assert "SortAggregate" not in plan
    assert not re.search(r"Exchange hashpartitioning\(([^)]*, )?site#", plan)


def _nearest(px, py, line):
    """dist, fraction of the nearest point of a line's first nearest segment."""
    total = sum(math.dist(a, b) for a, b in zip(line, line[1:]))
    before, best = 0.0, None
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        size, deg = (x2 - x1) ** 2 + (y2 - y1) ** 2, math.dist((x1, y1), (x2, y2))
        t = min(1.0, max(0.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / size)) if size else 0.0
        dist = math.dist((px, py), (x1 + (x2 - x1) * t, y1 + (y2 - y1) * t))
        if best is None or dist < best[0] - 1e-13:
            best = dist, (before + deg * t) / total if total else 0.0
        before += deg
    return best


def test_lines_of_all_sizes_meet_all_places_beside_them(spark):
    """Long and short, upright and flat lines on both sides of zero, one walked there and back, one of no length."""
    draw = random.Random(4)
    lines = []
    for n in range(60):
        step, x, y = draw.choice((0.0005, 0.004, 0.03, 0.2)), draw.uniform(-0.3, 0.3), draw.uniform(-0.3, 0.3)
        line = [(x, y)]
        for _ in range(draw.randint(1, 12)):
            line.append((line[-1][0] + draw.uniform(-1, 1) * step * (n % 3 > 0), line[-1][1] + draw.uniform(-1, 1) * step * (n % 3 != 1)))
        lines.append(line + line[-2::-1] if n % 10 == 0 else line)
    lines.append([(0.01, 0.01), (0.01, 0.01)])
    places = [(i, draw.uniform(-0.4, 0.4), draw.uniform(-0.4, 0.4)) for i in range(400)]
    places += [(400 + i, *lines[i][1]) for i in range(50)]
    v = spark.createDataFrame([(r, s + 1, *p) for r, line in enumerate(lines) for s, p in enumerate(line)], "route long, seq long, lon double, lat double")
    got = spatial.match_to_lines(spark.createDataFrame(places, "site long, lon double, lat double"), v, 0.02)
    got = {(r.site, r.route): (r.dist_deg, r.fraction) for r in got.collect()}
    told = {(i, r): b for i, x, y in places for r, line in enumerate(lines) if (b := _nearest(x, y, line))[0] <= 0.02}
    assert got.keys() == told.keys() and len(told) > 200
    assert all(got[k] == pytest.approx(told[k], abs=1e-9) for k in told)


def test_a_lines_rows_have_one_home(spark):
    v = spark.createDataFrame([(r, s, r * 0.3 + s * 0.01, 0.001 * s) for r in range(3) for s in range(20)], "route long, seq long, lon double, lat double")
    m = spatial.match_to_lines(spark.createDataFrame([(i, i * 0.004, 0.001) for i in range(300)], "site long, lon double, lat double"), v, 0.01)
    assert [r.n for r in m.groupBy("route").agg(F.countDistinct("home").alias("n")).collect()] == [1, 1, 1]


def test_greedy_dedup_of_a_long_line(spark):
    """A fold that compared each place with all kept ones took a minute on these; the order need not be that of the fractions."""
    draw = random.Random(5)
    rows = [(r, o, o, str(draw.randrange(3)), round(o / 1500, 6) if r else draw.random() * 0.02, draw.random()) for r in range(2) for o in range(1500)]
    kept = {}
    for r, o, site, name, frac, dist in rows:
        mine = kept.setdefault(r, [])
        hit = next((i for i, k in enumerate(mine) if (k[1] == name and abs(frac - k[2]) < 500.0 / 111320.0) or abs(frac - k[2]) < 0.001), None)
        if hit is None:
            mine.append((site, name, frac, dist))
        elif dist < mine[hit][3]:
            mine[hit] = (site, name, frac, dist)
    got = folds.greedy_dedup(spark.createDataFrame(rows, "route long, ord long, site long, name string, frac double, dist double")).collect()
    assert sorted((g.route, g.slot, g.site) for g in got) == sorted((r, i, k[0]) for r, mine in kept.items() for i, k in enumerate(mine))


@pytest.mark.parametrize("name", ["never_closest_filter", "stations_kept"])
def test_searches_for_the_nearest_sort_no_pairs(spark, data, name):
    plan = _plan(spark, data, name)
    assert "SortAggregate" not in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*seq#", plan)


def test_nearest_places_by_ever_wider_cells(spark):
    """Places thick in one corner and thin elsewhere, two at one spot, vertices on them and beyond the radius."""
    draw = random.Random(6)
    places = [(i, draw.uniform(0, 0.02), draw.uniform(0, 0.02)) for i in range(300)] + [(300 + i, draw.uniform(-1, 1), draw.uniform(-1, 1)) for i in range(60)]
    places.append((999, *places[5][1:]))
    vertices = [(0, i, draw.uniform(-1, 1), draw.uniform(-1, 1)) for i in range(200)] + [(1, i, draw.uniform(0, 0.03), draw.uniform(0, 0.03)) for i in range(200)] + [(2, 0, *places[5][1:])]
    told = set()
    for r, _, x, y in vertices:
        d2, site = min(((x - px) ** 2 + (y - py) ** 2, i) for i, px, py in places)
        told |= {(r, site)} if d2 <= 0.1 * 0.1 else set()
    p = spark.createDataFrame([(r, *x) for r in range(3) for x in places], "route long, site long, lon double, lat double")
    got = spatial.ever_nearest(p, spark.createDataFrame(vertices, "route long, seq long, lon double, lat double"), "route", 0.1)
    assert {(g.route, g.site) for g in got.collect()} == told


@pytest.mark.parametrize("name", ["scan_stations", "scan_beds", "scan_landmarks"])
def test_scans_meet_boxes_in_small_cells(spark, data, name):
    """No pair of a row and a box is ranked in a window, and rows do not meet boxes in cells of a whole degree."""
    plan = _plan(spark, data, name)
    assert "row_number() windowspecdefinition(route" not in plan
    assert not re.search(r"Exchange hashpartitioning\(route#\d+L, (key|lat|lon)#", plan)


def test_scan_of_boxes_of_all_sizes(spark):
    """The first of a name by box and number, also where one number has two places, and a row on a box's edge."""
    draw = random.Random(7)
    boxes = []
    for r in range(30):
        x, y, w, h = draw.uniform(-3, 3), draw.uniform(-3, 3), draw.choice((0.001, 0.3, 5.0)), draw.choice((0.0, 0.05, 2.0))
        boxes += [(r, c, x + w * c, y, x + w * (c + 1), y + h) for c in range(3)]
    rows = [(draw.randrange(250), draw.choice("abc"), draw.uniform(-5, 5), draw.uniform(-5, 5)) for _ in range(600)]
    rows.append((1000, "edge", boxes[0][2] - 0.5, boxes[0][3]))
    told = {}
    for i, key, lat, lon in rows:
        for r, c, x0, y0, x1, y1 in boxes:
            if x0 - 0.5 <= lon <= x1 + 0.5 and y0 - 0.5 <= lat <= y1 + 0.5:
                told[r, key] = min(told.get((r, key), (9, 9)), (c, i))
    kind = "id long, key string, lat double, lon double"
    b = spark.createDataFrame(boxes, "route long, chunk int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = scans.scan(spark.createDataFrame(rows, kind), b, 0.5, ["key"], "id").collect()
    assert {(g.route, g.key): (g.chunk, g.id) for g in got} == told and len(got) == len(told)
    assert {(g.id, g.key, g.lat, g.lon) for g in got} <= set(rows)


def test_points_in_covered_cells_meet_no_ring(spark):
    """Ragged, upright and overlapping rings: every cell held whole lies inside its ring, and the union is what a check of every ring gives."""
    draw = random.Random(8)
    rings = []
    for n in range(40):
        x, y, k = draw.uniform(-0.2, 0.2), draw.uniform(-0.2, 0.2), draw.randint(3, 9)
        rings.append([(x + draw.uniform(0.01, 0.09) * math.cos(a * 6.2832 / k), y + draw.uniform(0.01, 0.09) * math.sin(a * 6.2832 / k)) for a in range(k)])
    rings.append([(0.3, 0.3), (0.36, 0.3), (0.36, 0.36), (0.3, 0.36)])
    points = [(i, draw.uniform(-0.3, 0.4), draw.uniform(-0.3, 0.4)) for i in range(3000)]

    def inside(x, y):
        def odd(ring):
            pairs = zip(ring, ring[1:] + ring[:1])
            return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in pairs) % 2

        return any(map(odd, rings))

    told = spark.createDataFrame([(n, [(y, x) for x, y in r]) for n, r in enumerate(rings)], "ring long, points array<struct<lat: double, lon: double>>")
    edges = forests.ring_edges(told)
    cells = [(c["_x"], c["_y"]) for c in forests.covered_cells(edges).collect()]
    assert len(cells) > 50
    for cx, cy in cells:
        assert all(inside((cx + a) * forests.RING_CELL, (cy + b) * forests.RING_CELL) for a in (0.001, 0.5, 0.999) for b in (0.001, 0.5, 0.999))
    got = forests.in_union(spark.createDataFrame([(0, *p) for p in points], "route long, i int, lon double, lat double"), edges)
    assert sorted(g.i for g in got.collect()) == [i for i, x, y in points if inside(x, y)]


def test_routes_at_places_by_kinds_of_stops(spark):
    """Stops with the same, with other and with no routes, by a check of every pair."""
    draw = random.Random(9)
    stops = [(s, draw.uniform(45, 45.05), draw.uniform(2, 2.05)) for s in range(60)]
    at = {(s, r) for s, *_ in stops if s % 7 for r in ((1, 2, 3) if s % 3 else draw.sample(range(9), 2))}
    places = [(i, draw.uniform(45, 45.05), draw.uniform(2, 2.05), "train" if i % 9 == 0 else "bus") for i in range(200)]
    told = {i: [-1] for i, *_, kind in places if kind == "train"}
    for i, lat, lon, kind in places:
        near = [s for s, a, b in stops if math.hypot((lat - a) * 111_320, (lon - b) * 77_400) <= 600]
        routes = sorted({r for s, r in at if s in near})
        if kind == "bus" and routes:
            told[i] = routes
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = transit.routes_at_places(frame(places, "site long, lat double, lon double, kind string"), frame(stops, "stop long, lat double, lon double"), frame(sorted(at), "stop long, route long"), 600.0)
    assert {g.site: g.routes for g in got.collect()} == told


@pytest.mark.parametrize("name", ["transit_line_names", "station_routes", "transport_connected"])
def test_places_meet_kinds_of_stops(spark, data, name):
    """Before their routes are listed, a place's stops are told once by kind."""
    assert re.search(r"Aggregate\(keys=\[site#\d+L, kind_of#\d+L\]", _plan(spark, data, name))


def test_samples_meet_places_in_the_task_of_their_line(spark, data):
    assert not re.search(r"Exchange hashpartitioning\(([^)]*, )?site#", _plan(spark, data, "refine_junction"))


def test_forward_paths_where_kilometres_rise_and_fall(spark):
    """The first node within a step's reach counts, also one far back where the kilometres fall again."""
    draw = random.Random(10)
    lines = [[(i, 6.0 * i + draw.random() * 5) for i in range(1, 40)], [(i, draw.uniform(0, 60)) for i in range(1, 40)]]
    told = []
    for line in lines:
        seen = {1: (line[0][1], None)}
        for i, km in line[1:]:
            prev = next((b for b, (at, _) in sorted(seen.items()) if 8 <= km - at <= 25), None)
            if prev is not None:
                seen[i] = (km, prev)
        path, at = [], 39 if 39 in seen else None
        while at:
            path, at = [at, *path], seen[at][1]
        told.append(path or None)
    rows = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n int, nodes array<struct<idx: int, km: double>>")
    got = rows.select("n", folds.forward_path(F.col("nodes"), F.lit(1), F.lit(39), 8.0, 25.0).alias("p")).orderBy("n").collect()
    assert [g.p for g in got] == told and told[0]


def test_pairs_of_a_round_trip_are_dealt_over_tasks(spark, data):
    assert re.search(r"Exchange hashpartitioning\(area#\d+, lo#\d+, hi#\d+, \d+\), REPARTITION_BY_NUM", _plan(spark, data, "round_trip"))
