"""Trails out of map relations: ways told apart and chained, children joined, relations fused.

Lines are vertex tables (..., seq, lon, lat), seq counted from 0. A line is turned or not by where the one
before it ends, which depends on one bit, whether that one was turned. What a line does to the bit is
one of four maps, and maps are composed by running sums over the lines in order: no state is carried
from line to line, and vertices are moved by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.geo import arc_m, degree_distance
from ..sources.shared import once
from .lines import drop_spurious


def turned(ends: DataFrame, key: list[str], order: list[str], gap_deg: float = CONFIG.gap_deg) -> DataFrame:
    """``ends`` (key, order, x1, y1, x2, y2, any others) with flipped, part and joined.

    In order, a line is turned if its far end is nearer to where the chain ends, the first never; a gap over the limit
    starts a new part, and joined tells that a line begins on the very end of the one before.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    old = {c: F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2")}
    turns = lambda x, y: degree_distance(x, y, F.col("x2"), F.col("y2")) < degree_distance(x, y, F.col("x1"), F.col("y1"))
    known = ends.withColumn("_plain", F.coalesce(turns(old["x2"], old["y2"]), F.lit(False))).withColumn("_other", F.coalesce(turns(old["x1"], old["y1"]), F.lit(False)))
    # Both the same: the line is turned or not whatever came before. Otherwise it keeps the bit or changes it.
    fixed = F.col("_plain") == F.col("_other")
    known = known.withColumn("_changes", F.sum(F.when(~fixed & F.col("_plain"), 1).otherwise(0)).over(so_far))
    since = F.last(F.when(fixed, F.struct("_plain", "_changes")), ignorenulls=True).over(so_far)
    known = known.withColumn("_since", since).withColumn("flipped", F.col("_since._plain") != ((F.col("_changes") - F.col("_since._changes")) % 2 == 1))
    before = F.lag("flipped").over(w)
    at = {c: F.when(before, old[f"{c}1"]).otherwise(old[f"{c}2"]) for c in "xy"}
    own = {c: F.when(F.col("flipped"), F.col(f"{c}2")).otherwise(F.col(f"{c}1")) for c in "xy"}
    gap = F.coalesce(degree_distance(at["x"], at["y"], own["x"], own["y"]) > gap_deg, F.lit(False))
    known = known.withColumn("_gap", gap).withColumn("joined", F.coalesce(~F.col("_gap") & (at["x"] == own["x"]) & (at["y"] == own["y"]), F.lit(False)))
    return known.withColumn("part", F.sum(F.col("_gap").cast("int")).over(so_far).cast("int")).drop("_plain", "_other", "_changes", "_since", "_gap")


def chained(lines: DataFrame, key: list[str], order: list[str], gap_deg: float = CONFIG.gap_deg) -> DataFrame:
    """key, part, seq, lon, lat: the lines (key, order, seq, lon, lat) of each key joined in order; a vertex that two share is kept once."""
    point = F.struct("lon", "lat")
    ends = lines.groupBy(*key, *order).agg(F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("b"), F.count(F.lit(1)).alias("n"))
    ends = ends.select(*key, *order, "n", F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))
    drop = F.col("joined").cast("int")
    before = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = turned(ends.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order)}).drop(*order), key, [f"_o{i}" for i in range(len(order))], gap_deg)
    told = told.withColumnsRenamed({"part": "_part", **{f"_o{i}": c for i, c in enumerate(order)}})
    told = told.withColumn("_from", F.coalesce(F.sum(F.col("n") - drop).over(before), F.lit(0)))
    met = lines.select(*key, *order, "seq", "lon", "lat").join(told.select(*key, *order, "n", "flipped", "joined", "_part", "_from"), [*key, *order])
    at = F.when(F.col("flipped"), F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq"))
    kept = met.withColumn("_at", at).where(~(F.col("joined") & (F.col("_at") == 0)))
    return kept.select(*key, F.col("_part").alias("part"), (F.col("_from") + F.col("_at") - drop).cast("long").alias("seq"), "lon", "lat")


def part_km(trails: DataFrame, key: list[str]) -> DataFrame:
    """key, part, km of trails (key, part, seq, lon, lat), by the arcsine form."""
    w = Window.partitionBy(*key, "part").orderBy("seq")
    step = arc_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return trails.withColumn("_m", F.coalesce(step, F.lit(0.0))).groupBy(*key, "part").agg((F.sum("_m") / 1000.0).alias("km"))


def without_spurious(trails: DataFrame, route: str) -> DataFrame:
    """Trails (route, part, seq, lon, lat) without parts that are short both in themselves and beside the longest one."""
    kept = drop_spurious(part_km(trails, [route]).withColumnRenamed(route, "route")).withColumnRenamed("route", route)
    return trails.join(kept.select(route, "part"), [route, "part"], "left_semi")


def _of_type(kind: str) -> Column:
    return F.filter("members", lambda m: m["type"] == kind)


def told_apart(elements: DataFrame) -> DataFrame:
    """``elements`` (relation, at, type, id, members, geometry, any others) that an answer about ``relation`` holds, with their role.

    The relation asked for is the parent, other relations are children; ways need two points; of equal ids the last one counts.
    """
    role = F.when((F.col("type") == "relation") & (F.col("id") == F.col("relation")), "parent").when(F.col("type") == "relation", "child").when((F.col("type") == "way") & (F.size("geometry") >= 2), "way")
    last = F.row_number().over(Window.partitionBy("relation", "role", "id").orderBy(F.desc("at")))
    return elements.withColumn("role", role).where("role is not null").withColumn("_n", last).where("_n = 1").drop("_n")


def relation_ways(told: DataFrame) -> DataFrame:
    """relation, child, pos, way: the ways of each relation in order, its own if it has no child relations, else its children's; ``told`` as told_apart gives it.

    ``child`` counts the children as the parent lists them; children and ways that the answer lacks are left out.
    """
    parents = told.where("role = 'parent'").select("relation", "members").withColumn("_children", _of_type("relation"))
    numbered = lambda t, kind, *more: t.select("relation", *more, F.posexplode(_of_type(kind)).alias("pos", "m")).select("relation", *more, "pos", F.col("m.ref").alias("way"))
    own = numbered(parents.where("coalesce(size(_children), 0) <= 0").withColumn("child", F.lit(0)), "way", "child")
    listed = parents.select("relation", F.posexplode("_children").alias("child", "c")).select("relation", "child", F.col("c.ref").alias("id"))
    theirs = told.where("role = 'child'").select("relation", "id", "members").join(listed, ["relation", "id"])
    return own.unionByName(numbered(theirs, "way", "child"))


def relation_trails(elements: DataFrame) -> DataFrame:
    """relation, part, seq, lon, lat: each relation's ways chained, children joined in order, spurious parts dropped.

    Defined cases: relations without a parent, or without a way, give no row (``relation_errors`` names them); a way that is listed
    twice is passed twice; null members and geometries are empty.
    """
    told = once(told_apart(elements))
    ways = told.where("role = 'way'").select("relation", F.col("id").alias("way"), "geometry")
    met = relation_ways(told).join(ways, ["relation", "way"])
    points = met.select("relation", "child", "pos", F.posexplode("geometry").alias("seq", "p")).select("relation", "child", "pos", "seq", "p.lon", "p.lat")
    lines = once(chained(once(points), ["relation", "child"], ["pos"])).withColumnRenamed("part", "line")
    return once(without_spurious(once(chained(lines, ["relation"], ["child", "line"])), "relation"))


def relation_errors(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """relation, error of those ``asked`` for that give no trail."""
    told = once(told_apart(elements).withColumn("geometry", F.lit(None)))
    parents = told.where("role = 'parent'").select("relation", (F.size(_of_type("relation")) > 0).alias("_super"))
    ways = told.where("role = 'way'").select("relation", F.col("id").alias("way"))
    found = relation_ways(told).join(ways, ["relation", "way"]).select("relation", F.lit(True).alias("_found")).distinct()
    met = asked.select("relation").distinct().join(parents, "relation", "left").join(found, "relation", "left").where("_found is null")
    error = F.when(F.col("_super").isNull(), "relation not found").when(F.col("_super"), "no geometry").otherwise("no ways")
    return met.select("relation", error.alias("error"))


def fused(trails: DataFrame, routes: DataFrame) -> DataFrame:
    """route, part, seq, lon, lat: the trails of a route's relations (route, nth, relation) joined in order."""
    met = routes.join(trails, "relation").withColumnRenamed("part", "line")
    return chained(met, ["route"], ["nth", "line"])
