"""Trails of relations and hikes as lines, on small cases worked out by hand or by a plain loop."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import folds, hikes, trails

ELEMENTS = "relation long, at int, type string, id long, members array<struct<type: string, ref: long>>, geometry array<struct<lat: double, lon: double>>"


def _fold(lines):
    """Lines of points joined by a plain loop: parts of points."""
    done, now = [], list(lines[0])
    for line in lines[1:]:
        line, end = list(line), now[-1]
        ahead, back = math.dist(end, line[0]), math.dist(end, line[-1])
        if back < ahead:
            line.reverse()
        if min(ahead, back) > 0.05:
            done.append(now)
            now = line
        else:
            now += line[1:] if line[0] == end else line
    return [*done, now]


def _vertices(spark, routes):
    rows = [(r, n, i, *p) for r, lines in routes.items() for n, line in enumerate(lines) for i, p in enumerate(line)]
    return spark.createDataFrame(rows, "route long, nth int, seq long, lon double, lat double")


def _parts(df, key="route"):
    out = {}
    for r in df.orderBy(key, "part", "seq").collect():
        out.setdefault(r[key], {}).setdefault(r.part, []).append((r.seq, (r.lon, r.lat)))
    for parts in out.values():
        for p in parts.values():
            assert [i for i, _ in p] == list(range(len(p)))
    return {k: [[q for _, q in v[i]] for i in sorted(v)] for k, v in out.items()}


def test_chained_equals_the_loop(spark):
    rng = random.Random(3)
    routes = {}
    for route in range(60):
        at, lines = (rng.random(), rng.random()), []
        for _ in range(rng.randint(1, 12)):
            step = rng.choice([0.0, 0.0, 0.01, 0.2])
            line = [(at[0] + step, at[1])]
            for _ in range(rng.randint(1, 4)):
                line.append((line[-1][0] + rng.choice([-0.01, 0.0, 0.02]), line[-1][1] + 0.01))
            at = line[-1]
            lines.append(line[::-1] if rng.random() < 0.5 else line)
        routes[route] = lines
    assert _parts(trails.chained(_vertices(spark, routes), ["route"], ["nth"])) == {r: _fold(x) for r, x in routes.items()}


def test_a_hundred_thousand_ways_of_one_route(spark):
    n = 100_000
    ways = spark.range(n).select(F.lit(1).cast("long").alias("route"), F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("t"))
    x = lambda flip: (F.col("pos") + F.when(F.col("t") == flip, 1).otherwise(0)) * 0.01
    ends = ways.select("route", "pos", x(True).alias("x1"), F.lit(0.0).alias("y1"), x(False).alias("x2"), F.lit(0.0).alias("y2"))
    got = folds.chain_ways(ends).agg(F.max("part").alias("part"), F.sum((F.col("flipped") == (F.col("pos") % 3 == 0)).cast("long")).alias("as_told")).first()
    assert got.part == 0 and got.as_told in (n, 0, n - 1)


def _way(relation, i, at, points):
    return (relation, at, "way", i, None, [(lat, lon) for lon, lat in points] if points is not None else None)


def _rel(relation, i, at, *members):
    return (relation, at, "relation", i, list(members), None)


W, R = "way", "relation"
A, B, C, D = [(0.0, 0.0), (0.1, 0.0)], [(0.2, 0.0), (0.1, 0.0)], [(0.2, 0.0), (0.3, 0.0), (0.4, 0.0)], [(2.0, 0.0), (2.01, 0.0)]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [
        _rel(1, 1, 0, (W, 11), (W, 12), (W, 99), (W, 13), ("node", 11)), _way(1, 11, 1, A), _way(1, 12, 2, B), _way(1, 13, 3, C), _way(1, 14, 4, D),  # a way of its own, one lacking, one not listed
        _rel(2, 2, 0, (R, 21), (R, 29), (R, 22), (W, 23)), _rel(2, 21, 1, (W, 11), (W, 12)), _rel(2, 22, 2, (W, 13), (W, 14)), _way(2, 11, 3, A), _way(2, 12, 4, B), _way(2, 13, 5, C[::-1]), _way(2, 14, 6, D), _way(2, 23, 7, D),
        _rel(3, 31, 0, (W, 11)), _way(3, 11, 1, A),  # no parent
        _rel(4, 4, 0, (W, 11)), _way(4, 11, 1, A[:1]), _way(4, 12, 2, None),  # no way of two points
        _rel(5, 5, 0, (R, 51)), _way(5, 11, 1, A),  # no child
        _rel(6, 6, 0, (W, 11)), _rel(6, 6, 1, (W, 12)), _way(6, 11, 2, A), _way(6, 12, 3, D), _way(6, 12, 4, B),  # the last of an id counts
        _rel(7, 7, 0), _rel(8, 8, 0, (W, 11), (W, 11)), _way(8, 11, 1, A),
    ]
    return spark.createDataFrame(rows, ELEMENTS)


def test_relation_trails(answers):
    got = _parts(trails.relation_trails(answers), "relation")
    whole = [(0.0, 0.0), (0.1, 0.0), (0.2, 0.0), (0.3, 0.0), (0.4, 0.0)]
    assert got == {1: [whole], 2: [whole], 6: [[(0.2, 0.0), (0.1, 0.0)]], 8: [[(0.0, 0.0), (0.1, 0.0), (0.0, 0.0)]]}  # relation 2's far way is spurious


def test_relation_errors(spark, answers):
    asked = spark.createDataFrame([(i,) for i in range(1, 10)], "relation long")
    assert {r.relation: r.error for r in trails.relation_errors(asked, answers).collect()} == {3: "relation not found", 4: "no ways", 5: "no geometry", 7: "no ways", 9: "relation not found"}


def test_relations_fuse_in_the_order_of_their_route(spark, answers):
    t = trails.relation_trails(answers)
    routes = spark.createDataFrame([(1, 0, 6), (1, 1, 1), (2, 0, 3), (3, 0, 1)], "route long, nth int, relation long")
    one = [(0.0, 0.0), (0.1, 0.0), (0.2, 0.0), (0.3, 0.0), (0.4, 0.0)]
    assert _parts(trails.fused(t, routes)) == {1: _fold([[(0.2, 0.0), (0.1, 0.0)], one]), 3: [one]}


def _trail(spark, parts, route=1):
    return spark.createDataFrame([(route, k, i, *map(float, p)) for k, part in enumerate(parts) for i, p in enumerate(part)], "route long, part long, seq long, lon double, lat double")


def _clip(spark, parts, *legs):
    cuts = spark.createDataFrame([(1, 7, i, float(a), float(b)) for i, (a, b) in enumerate(legs)], "route long, cut int, leg int, f0 double, f1 double")
    rows = hikes.clipped(hikes.placed_segments(_trail(spark, parts)), cuts).orderBy("leg", "part", "seq", "end").collect()
    return [(round(r.lon, 9), round(r.lat, 9)) for r in rows]


@pytest.mark.parametrize(
    ("parts", "legs", "want"),
    [
        ([[(0, 0), (1, 0), (2, 0)]], [(0.25, 0.75)], [(0.5, 0), (1, 0), (1.5, 0)]),
        ([[(0, 0), (1, 0), (2, 0)]], [(0.5, 1.0)], [(1, 0), (2, 0)]),  # a cut on a vertex
        ([[(0, 0), (1, 0), (2, 0)]], [(0.1, 0.2)], [(0.2, 0), (0.4, 0)]),  # within a segment
        ([[(0, 0), (1, 0)], [(1, 0), (2, 0)]], [(0.25, 0.75)], [(0.5, 0), (1, 0), (1.5, 0)]),  # the joint is kept once
        ([[(0, 0), (1, 0)], [(5, 0), (6, 0)]], [(0.25, 0.75)], [(0.5, 0), (1, 0), (5, 0), (5.5, 0)]),  # over a gap
        ([[(0, 0), (1, 0)], [(5, 0), (6, 0)]], [(0.0, 0.5)], [(0, 0), (1, 0)]),  # parts that are only touched stay out
        ([[(0, 0), (1, 0)], [(5, 0), (5, 0)], [(8, 0), (9, 0)]], [(0.25, 0.75)], [(0.5, 0), (1, 0), (5, 0), (8, 0), (8.5, 0)]),  # a part of no length is a point
        ([[(0, 0), (1, 0), (1, 0), (2, 0)]], [(0.25, 0.75)], [(0.5, 0), (1, 0), (1, 0), (1.5, 0)]),  # repeated vertices stay
        ([[(0, 0), (1, 0)]], [(0.5, 0.5)], []),
        ([[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]], [(0.875, 1.0), (0.0, 0.125)], [(0, 0.5), (0, 0), (0.5, 0)]),  # around
    ],
)
def test_clipped(spark, parts, legs, want):
    assert _clip(spark, parts, *legs) == want


def _haversine(a, b):
    (x1, y1), (x2, y2) = a, b
    p = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(p), math.sqrt(1 - p))


RING = [[(2.00, 48.00), (2.04, 48.00), (2.04, 48.04), (2.00, 48.04), (2.00, 48.00)]]


def _places(spark, fractions):
    return spark.createDataFrame([(1, i, float(f)) for i, f in enumerate(fractions, 1)], "route long, idx long, fraction double")


def _round_trip(spark, parts, fractions, lo, hi):
    t = _trail(spark, parts)
    seg = hikes.placed_segments(t)
    at = hikes.station_km(seg, _places(spark, fractions))
    return hikes.loop_lines(t, seg, at, hikes.loop_steps(t, at, lo, hi)).orderBy("step").collect()


def test_round_trip_of_a_ring(spark):
    steps = _round_trip(spark, RING, [0, 0.25, 0.5, 0.75], 2.0, 8.0)
    assert [(s.src, s.dst, s.wraps) for s in steps] == [(1, 2, False), (2, 3, False), (3, 1, True)] or steps[0].src == steps[-1].dst
    assert steps[0].src == steps[-1].dst and steps[-1].wraps and len(steps[-1].line) >= 2
    around = sum(_haversine(a, b) for a, b in zip(RING[0], RING[0][1:]))
    assert sum(s.km for s in steps) == pytest.approx(around, abs=0.06 * len(steps))
    for s in steps:
        line = [(p.lon, p.lat) for p in s.line]
        assert sum(_haversine(a, b) for a, b in zip(line, line[1:])) == pytest.approx(s.km, abs=0.051)


@pytest.mark.parametrize(
    ("parts", "fractions", "lo", "hi"),
    [([[(2.0, 48.0), (2.1, 48.0), (2.2, 48.0)]], [0, 0.5, 1], 4.0, 20.0), (RING, [0], 4.0, 20.0), (RING, [0, 0.5], 30.0, 40.0)],
)
def test_no_round_trip(spark, parts, fractions, lo, hi):
    assert _round_trip(spark, parts, fractions, lo, hi) == []


def test_steps_of_hikes_as_lines(spark):
    parts = [[(2.0, 48.0), (2.1, 48.0), (2.2, 48.0)], [(2.25, 48.0), (2.45, 48.0)]]
    t = _trail(spark, parts)
    seg = hikes.placed_segments(t)
    places = _places(spark, [0.0, 0.5, 1.0])
    at = hikes.station_km(seg, places)
    km = [r.km for r in at.orderBy("idx").collect()]
    first, gap, second = _haversine((2.0, 48), (2.2, 48)), _haversine((2.2, 48), (2.25, 48)), _haversine((2.25, 48), (2.45, 48))
    assert km == pytest.approx([0, first, first + second])  # between stations, only what a way holds counts
    nodes = at.withColumns({"train": F.lit(True), "hotel": F.lit(True), "routes": F.array(F.lit(-1).cast("long"))})
    steps = hikes.step_lines(seg, at, hikes.longest_hikes(nodes, 8.0, 25.0)).orderBy("step").collect()
    assert [(s.src, s.dst, s.km) for s in steps] == [(1, 2, round(first, 1)), (2, 3, round(second, 1))]
    assert [[p.lon for p in s.line] for s in steps] == [[2.0, 2.1, 2.2], [2.25, 2.45]]
    one = hikes.step_lines(seg, at, spark.createDataFrame([(1, 1, 3)], "route long, src long, dst long")).first()
    assert [p.lon for p in one.line] == [2.0, 2.1, 2.2, 2.25, 2.45] and gap > 0
