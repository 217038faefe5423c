"""Folds over ordered arrays whose steps depend on what they gave before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from .trails import turned
from .transit import connected


def _ordered(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("rows"))


def chain_ways(ways: DataFrame) -> DataFrame:
    """route, pos, flipped, part of ways (route, pos, x1, y1, x2, y2) in order.

    A way is turned if its far end is nearer to where the chain ends, the first never; a gap over the
    limit starts a new part.
    """
    return turned(ways, ["route"], ["pos"]).select("route", "pos", "flipped", "part")


def greedy_dedup(places: DataFrame, by: tuple = ("route",)) -> DataFrame:
    """Places (``by``, ord, site, name, frac, dist) without duplicates, as ``by``, slot, site, frac, dist.

    In order, a place is a duplicate of the first kept one of its name nearby, or of any at about the
    same fraction; the nearer of both takes the slot. Kept places too far behind all that still come are
    set aside, so that a place is compared with those about it and not with the whole line.
    """
    near, same = 500.0 / CONFIG.degree_m, 0.001
    kept_kind = "array<struct<slot: int, site: bigint, name: string, frac: double, dist: double>>"
    item = lambda x, slot: F.struct(slot.cast("int").alias("slot"), x["site"].cast("bigint").alias("site"), x["name"].alias("name"), x["frac"].alias("frac"), x["dist"].alias("dist"))
    state = lambda n, open_, done: F.struct(n.alias("n"), open_.alias("open"), done.alias("done"))

    def merge(s, x):
        passed = lambda k: (x["low"] - k["frac"] >= near) & (x["low"] - k["frac"] >= same)
        gone = F.filter(s["open"], passed)
        kept, done = F.when(F.size(gone) > 0, F.filter(s["open"], lambda k: ~passed(k))).otherwise(s["open"]), F.when(F.size(gone) > 0, F.concat(s["done"], gone)).otherwise(s["done"])
        gap = lambda k: F.abs(x["frac"] - k["frac"])
        hit = lambda k: ((k["name"] == x["name"]) & (gap(k) < near)) | (gap(k) < same)
        at = F.get(F.filter(kept, hit), F.lit(0))["slot"]
        # Open places are in order of their slots; one that is replaced keeps its slot.
        replaced = F.transform(kept, lambda k: F.when((k["slot"] == at) & (x["dist"] < k["dist"]), item(x, k["slot"])).otherwise(k))
        return F.when(at.isNull(), state(s["n"] + 1, F.concat(kept, F.array(item(x, s["n"]))), done)).otherwise(state(s["n"], replaced, done))

    w = Window.partitionBy(*by).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = places.withColumn("low", F.min("frac").over(w))
    start = state(F.lit(0), F.array().cast(kept_kind), F.array().cast(kept_kind))
    rows = ahead.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "site", "name", "frac", "dist", "low"))).alias("rows"))
    done = rows.select(*by, F.explode(F.aggregate("rows", start, merge, lambda s: F.concat(s["done"], s["open"]))).alias("k"))
    return done.select(*by, "k.slot", "k.site", "k.frac", "k.dist")


def box_chunks(vertices: DataFrame, side: float) -> DataFrame:
    """route, chunk and bounds of runs of vertices whose box stays within ``side`` degrees; a run begins at the last vertex before it."""
    kind = "struct<a: double, b: double, c: double, d: double, x: double, y: double, n: int, out: array<struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>>>"
    box = lambda a, b, c, d: F.struct(a.alias("min_lon"), b.alias("min_lat"), c.alias("max_lon"), d.alias("max_lat"))

    def merge(s, v):
        x, y, first = v["lon"], v["lat"], s["n"] == 0
        a, b, c, d = F.least(s["a"], x), F.least(s["b"], y), F.greatest(s["c"], x), F.greatest(s["d"], y)
        over = ~first & ((c - a > side) | (d - b > side))
        pick = lambda grown, lone, pair: F.when(first, lone).when(over, pair).otherwise(grown)
        return F.struct(
            pick(a, x, F.least(s["x"], x)).alias("a"), pick(b, y, F.least(s["y"], y)).alias("b"), pick(c, x, F.greatest(s["x"], x)).alias("c"), pick(d, y, F.greatest(s["y"], y)).alias("d"),
            x.alias("x"), y.alias("y"), F.when(over, 2).otherwise(s["n"] + 1).alias("n"),
            F.when(over, F.concat(s["out"], F.array(box(s["a"], s["b"], s["c"], s["d"])))).otherwise(s["out"]).alias("out"),
        )

    zero = [F.lit(0.0).alias(c) for c in "abcdxy"]
    start = F.struct(*zero, F.lit(0).alias("n"), F.array().cast("array<struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>>").alias("out")).cast(kind)
    finish = lambda s: F.when(s["n"] >= 2, F.concat(s["out"], F.array(box(s["a"], s["b"], s["c"], s["d"])))).otherwise(s["out"])
    done = _ordered(vertices, "route", "seq", "lon", "lat").select("route", F.aggregate("rows", start, merge, finish).alias("boxes"))
    return done.select("route", F.posexplode("boxes").alias("chunk", "b")).select("route", "chunk", "b.*")


def longest_path(nodes: Column, min_km: float, max_km: float) -> Column:
    """struct(km, path) of the longest hike over ordered nodes (idx, km, train, hotel, routes); null if there is none.

    Steps go forward between ``min_km``, above 0, and ``max_km`` and join connected nodes; hikes start and end at
    trains; a node that was reached, a train too, is left only if it has a hotel. Of equal ways the one over the
    first node wins, of equal hikes the one that ends first. State: each node with its best distance (-1 if
    none) and its predecessor.
    """
    kind = "array<struct<idx: int, at: double, km: double, prev: int, train: boolean, hotel: boolean, routes: array<bigint>>>"

    def merge(seen, x):
        gap = lambda b: x["km"] - b["at"]
        ways = F.filter(seen, lambda b: (b["km"] >= 0) & (b["prev"].isNull() | b["hotel"]) & (gap(b) >= min_km) & (gap(b) <= max_km) & connected(b["routes"], x["routes"]))
        top = F.array_min(F.transform(ways, lambda b: F.struct((-(b["km"] + gap(b))).alias("less"), b["idx"].alias("idx"))))
        own = F.when(x["train"], F.lit(0.0)).otherwise(F.lit(-1.0))
        here = F.struct(x["idx"].alias("idx"), x["km"].alias("at"), F.coalesce(-top["less"], own).alias("km"), top["idx"].alias("prev"), x["train"].alias("train"), x["hotel"].alias("hotel"), x["routes"].alias("routes"))
        return F.concat(seen, F.array(here).cast(kind))

    def finish(seen):
        ends = F.filter(seen, lambda b: b["train"] & (b["km"] > 0))
        best = F.array_min(F.transform(ends, lambda b: F.struct((-b["km"]).alias("less"), b["idx"].alias("idx"))))
        return F.when(best.isNotNull(), F.struct((-best["less"]).alias("km"), _traced(seen, best["idx"]).alias("path")))

    return F.aggregate(nodes, F.array().cast(kind), merge, finish)


def _traced(seen: Column, last: Column) -> Column:
    """Numbers of the nodes that lead to ``last`` by their predecessors, over ordered nodes (idx, prev)."""
    start = F.struct(last.cast("int").alias("need"), F.array().cast("array<int>").alias("path"))
    back = lambda s, x: F.when(x["idx"] == s["need"], F.struct(x["prev"].alias("need"), F.concat(F.array(x["idx"]), s["path"]).alias("path"))).otherwise(s)
    return F.aggregate(F.reverse(seen), start, back, lambda s: s["path"])


def forward_path(nodes: Column, lo: Column, hi: Column, min_km: float, max_km: float) -> Column:
    """Numbers of the nodes on the longest forward path from ``lo`` to ``hi`` over ordered nodes (idx, km); null if none reaches ``hi``.

    Every path to a node is as long as the way to it, so the first node that reaches it stays its predecessor.
    State: the nodes reached, each with its predecessor.
    """
    kind = "array<struct<idx: int, km: double, prev: int>>"
    none = F.array().cast(kind)
    # On a line whose kilometres never fall, nodes more than a step behind are set aside and not looked at again.
    falls = F.coalesce(F.aggregate(nodes, F.struct(F.lit(False).alias("f"), F.lit(float("-inf")).alias("km")), lambda s, x: F.struct((s["f"] | (x["km"] < s["km"])).alias("f"), x["km"].alias("km")), lambda s: s["f"]), F.lit(True))
    state = lambda falls, near, done: F.struct(falls.alias("falls"), near.alias("near"), done.alias("done"))

    def merge(s, x):
        passed = lambda b: ~s["falls"] & (x["km"] - b["km"] > max_km)
        gone = F.filter(s["near"], passed)
        near, done = F.when(F.size(gone) > 0, F.filter(s["near"], lambda b: ~passed(b))).otherwise(s["near"]), F.when(F.size(gone) > 0, F.concat(s["done"], gone)).otherwise(s["done"])
        prev = F.filter(near, lambda b: (x["km"] - b["km"] >= min_km) & (x["km"] - b["km"] <= max_km))
        first = x["idx"] == lo
        here = F.array(F.struct(x["idx"].alias("idx"), x["km"].alias("km"), F.when(~first, F.get(prev, F.lit(0))["idx"]).alias("prev"))).cast(kind)
        return state(s["falls"], F.when(first | (F.size(prev) > 0), F.concat(near, here)).otherwise(near), done)

    some = F.filter(nodes, lambda x: (x["idx"] >= lo) & (x["idx"] <= hi))
    seen = F.aggregate(some, state(falls, none, none), merge, lambda s: F.concat(s["done"], s["near"]))
    # As a list of one, so that the way is worked out once.
    return F.get(F.filter(F.array(_traced(seen, hi)), lambda path: F.size(path) > 1), F.lit(0))
