"""Junctions on foot, stations by commune, single routes, styles, dictionaries, settings, folding: small cases."""

from __future__ import annotations

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trailweave.functions import text as tx
from trailweave.operators import catalog, refine


def _trail(spark, parts):
    return spark.createDataFrame([(1, k, i, *map(float, p)) for k, part in enumerate(parts) for i, p in enumerate(part)], "route long, part long, seq long, lon double, lat double")


def test_trail_samples(spark):
    metre = 1 / 111194.92664455873  # of latitude
    line = _trail(spark, [[(2, 0), (2, 300 * metre), (2, 300 * metre), (2, 500 * metre)], [(3, 0), (3, 100 * metre)]])
    got = refine.trail_samples(line, 150.0).orderBy("k").collect()
    assert [(r.k, round(r.fraction, 6), r.lon, round(r.lat / metre)) for r in got] == [(0, 0, 2, 0), (1, 0.25, 2, 150), (2, 0.5, 2, 300), (3, 0.75, 2, 450), (4, 1.0, 3, 100)]
    assert refine.trail_samples(_trail(spark, [[(2, 1), (2, 1)]]), 150.0).count() == 0
    odd = refine.trail_samples(_trail(spark, [[(2, 0), (2, 200 * metre)]]), 150.0).orderBy("k").collect()
    assert [round(r.fraction, 6) for r in odd] == [0, 0.75, 1.0]


def test_stations_are_repicked_on_foot(spark):
    metre = 1 / 111194.92664455873
    samples = spark.createDataFrame([(1, k, k / 4, 2.0, k * 1000 * metre) for k in range(5)], "route long, k long, fraction double, lon double, lat double")
    place = lambda site, ord_, name, at, f: (1, site, ord_, name, at * metre, 2.0, f, 2.0, at * metre, 77.0)
    matched = spark.createDataFrame([place(1, 1, "a", 900, 0.2), place(2, 2, "b", 2100, 0.5), place(3, 3, "c", 2900, 0.7), place(4, 4, "d", 9000, 0.99), place(5, 5, "e", 4000, 1.0)], "route long, site long, ord long, name string, lat double, lon double, fraction double, jlon double, jlat double, dist_m double")
    found = refine.candidates(matched, samples, 1200.0)
    assert sorted((r.site, r.pos, r.k) for r in found.collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2), (2, 2, 3), (3, 0, 2), (3, 1, 3), (3, 2, 4), (5, 0, 3), (5, 1, 4)]
    answers = spark.createDataFrame([(1, 1, [None, 300.06, 200.04]), (1, 2, [500.0, 400.0, 400.0]), (1, 3, [1.0, 2.0]), (1, 4, [5.0]), (1, 5, [None, None])], "route long, site long, metres array<double>")
    got = refine.repicked(matched, found, answers).orderBy("ord").collect()
    assert [(r.site, r.ord, r.fraction, r.dist_m) for r in got] == [(1, 1, 0.5, 200.0), (2, 2, 0.5, 400.0), (3, 3, 0.7, 77.0), (4, 4, 0.99, 77.0), (5, 5, 1.0, 77.0)]
    kept = refine.refined(matched, samples, answers, 1200.0).orderBy("slot").collect()
    assert [(r.site, r.frac, r.dist) for r in kept] == [(1, 0.5, 200.0), (3, 0.7, 77.0), (4, 0.99, 77.0), (5, 1.0, 77.0)]  # both at 0.5: the nearer stays


def test_stations_by_commune(spark):
    records = spark.createDataFrame([(1, " ABC ", "64 "), (2, "ABC", "06088"), (3, "DEF", "2A004"), (4, "GHI", ""), (5, "", "75001"), (6, "JKL", "97411"), (7, "MNO", "75056"), (8, None, "1"), (9, "PQR", "7")], "ord long, libellecourt string, codeinsee string")
    stations = spark.createDataFrame([("ABC",), ("DEF",), ("GHI",), ("JKL",), ("MNO",), ("XXX",), (None,)], "code string")
    got = {r.code: (r.department, r.region, r.coastal) for r in catalog.placed_stations(stations, records).collect()}
    assert got == {"ABC": ("06", "Provence-Alpes-Côte d'Azur", True), "DEF": ("2A", "Corse", True), "GHI": ("", "", False), "JKL": ("974", "", False), "MNO": ("75", "Île-de-France", False), "XXX": ("", "", False), None: ("", "", False)}
    assert sum(len(c.split()) for c in catalog.REGIONS.values()) == 96


def test_routes_by_slug_and_kind(spark):
    routes = spark.createDataFrame([(2, "a", "late"), (1, "a", "first"), (3, "b", "b")], "ord long, slug string, name string")
    asked = spark.createDataFrame([("a",), ("a",), ("z",)], "slug string")
    assert [(r.slug, r.name) for r in catalog.by_slug(routes, asked).collect()] == [("a", "first")]
    pois = F.array(F.struct(F.lit("x").alias("name"), F.lit("hotel").alias("poi_type")), F.struct(F.lit("y").alias("name"), F.lit("train_station").alias("poi_type")))
    assert [p.name for p in spark.range(1).select(catalog.of_kind(pois, "train_station").alias("p")).first().p] == ["y"]
    assert not catalog.any_filter([], []) and catalog.any_filter(["r"], []) and catalog.any_filter([], ["t"])


def test_styles(spark):
    style = {"version": 8, "sources": {"world": {"url": "w"}, "grid": {"url": "g"}}, "layers": [{"id": "bg", "type": "background", "maxzoom": 3}, {"id": "l", "type": "line", "source": "world", "maxzoom": 5, "paint": {"x": [1, 2]}}, {"id": "g", "type": "line", "source": "grid"}, {"id": "n"}]}
    df = spark.createDataFrame([(json.dumps(style),), ("{}",), ('{"layers": []}',)], "t string").select(F.parse_json("t").alias("v"))
    got = df.select(F.to_json(catalog.world_layers(F.col("v"), "world")).alias("l"), F.to_json(catalog.world_sources(F.col("v"), "world")).alias("s")).collect()
    assert json.loads(got[0].l) == [{"id": "bg", "type": "background"}, {"id": "l", "type": "line", "source": "world", "paint": {"x": [1, 2]}}] and json.loads(got[0].s) == {"world": {"url": "w"}}
    assert [(r.l, r.s) for r in got[1:]] == [("[]", "{}")] * 2


def test_dictionaries_and_settings(spark):
    own, default = F.create_map(F.lit("a"), F.lit("A")), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("B"))
    assert spark.range(1).select(catalog.client_texts(own, default, ["a", "b", "c"]).alias("m")).first().m == {"a": "A", "b": "B", "c": "c"}
    text = F.lit("# A := 0\nAB := 1\n A := 2\nA:=  x y \t\nA := 4")
    assert spark.range(1).select(catalog.config_value(text, "A").alias("v")).first().v == "x y"
    with pytest.raises(Exception, match="cannot find B.D"):
        spark.range(1).select(catalog.config_value(text, "B.D").alias("v")).collect()


DOCUMENT = ["# head", "routes:", "  - ref: GR 1", "    name: one  # kept", "    image_prompt: |", "      old text", "      more", "    relation_id: 7", '  - ref: "GR 2"', "    name: two", "  - ref: GR 1", "    image_prompt: second"]


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("GR 1", [*DOCUMENT[:4], '    image_prompt: "new \\"x\\""', *DOCUMENT[7:]]),
        ("GR 2", [*DOCUMENT[:9], '    image_prompt: "new \\"x\\""', *DOCUMENT[9:]]),
        ("GR 3", DOCUMENT),
    ],
)
def test_point_update_keeps_all_other_lines(spark, ref, want):
    lines = spark.createDataFrame(list(enumerate(DOCUMENT)), "n int, line string")
    assert [r.line for r in catalog.point_update(lines, ref, "image_prompt", 'new "x"').orderBy("n").collect()] == want


def test_folding_follows_unicode(spark):
    texts = ["Été à Forêt — œuvre", "ﬁn ½ ①⑽ ㎏ ™ Å ﬀ…", "Ώρα ά ΐ", "Ёлка й", "Ǆ ạ̄ ấ", "plain", "", "日本ガ", "x" * 50 + "é", "a_b  - c--d -"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", tx.fold(F.col("t")).alias("f"), tx.slug(F.col("t")).alias("s")).collect()
    for r in got[:-1]:
        folded = "".join(c for c in unicodedata.normalize("NFD", r.t) if not "̀" <= c <= "ͯ").lower()
        plain = unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode().lower()
        slug = re.sub(r"[\s-]+", "-", re.sub(r"[^\w\s-]", "", plain, flags=re.ASCII)).strip("-")
        assert (r.f, r.s) == (folded, slug), r.t
    assert got[-1].f is None and got[-1].s is None
