"""Queries over map relations that follow from the events' lines: ways, children, chained trails, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..operators import trails
from .derive import VERTEX, rnd, vertex

#: Steps of a way and ways of a child relation; a child of some routes is moved away, so that a gap splits the trail.
STEPS, WAYS, MOVED_DEG = 6, 4, 0.3
CHILD_IDS = 1_000_000_000
POINT = "struct<lat: double, lon: double>"
MEMBER = "struct<type: string, ref: bigint>"


def _ways(spark, d):
    """relation, k, way, points of a route's ways: seven vertices each, the last of one being the first of the next, some turned around."""
    v = vertex(spark, d).select(F.col("route").alias("relation"), (F.col("seq") - 1).alias("n"), "lon", "lat")
    k = F.floor(F.col("n") / STEPS)
    each = v.withColumn("k", F.explode(F.when((F.col("n") % STEPS == 0) & (F.col("n") > 0), F.array(k, k - 1)).otherwise(F.array(k))))
    moved = (F.floor(F.col("k") / WAYS) == 1) & (F.col("relation") % 4 == 1)
    point = F.struct("n", (F.col("lat") + F.when(moved, MOVED_DEG).otherwise(0.0)).alias("lat"), "lon")
    w = each.groupBy("relation", "k").agg(F.sort_array(F.collect_list(point)).alias("p"))
    turned = (F.col("relation") * 7 + F.col("k") * 5) % 3 == 0
    points = F.transform(F.when(turned, F.reverse("p")).otherwise(F.col("p")), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return w.select("relation", "k", (F.col("relation") * 1000 + F.col("k")).alias("way"), points.alias("points"))


def elements(spark, d):
    """The elements of an answer about each route as a relation; some lack a way, a child or the relation itself."""
    w = _ways(spark, d).withColumn("child", F.floor(F.col("k") / WAYS))
    simple = F.col("relation") % 3 == 0
    child_id = CHILD_IDS + F.col("relation") * 100 + F.col("child")
    member = lambda kind, ref: F.struct(F.lit(kind).alias("type"), ref.alias("ref"))
    refs = lambda rows: F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"])
    row = lambda kind, i, members, geometry, at: F.struct(at.alias("at"), F.lit(kind).alias("type"), i.alias("id"), members.alias("members"), geometry.alias("geometry"))
    none_m, none_g = F.lit(None).cast(f"array<{MEMBER}>"), F.lit(None).cast(f"array<{POINT}>")
    ways = w.where((F.col("relation") + F.col("k")) % 11 != 0).select("relation", row("way", F.col("way"), none_m, F.col("points"), F.col("k")).alias("e"))
    with_member = w.withColumn("m", member("way", F.col("way")))
    own = with_member.where(simple).groupBy("relation").agg(refs(None).alias("members")).select("relation", row("relation", F.col("relation"), F.col("members"), none_g, F.lit(-1).cast("long")).alias("e"))
    children = with_member.where(~simple & ~((F.col("child") == 2) & (F.col("relation") % 5 == 0))).groupBy("relation", "child").agg(refs(None).alias("members"))
    children = children.select("relation", row("relation", child_id, F.col("members"), none_g, -2 - F.col("child")).alias("e"))
    listed = w.where(~simple).select("relation", "child").distinct().withColumn("k", F.col("child")).withColumn("m", member("relation", child_id))
    supers = listed.groupBy("relation").agg(refs(None).alias("members")).select("relation", row("relation", F.col("relation"), F.col("members"), none_g, F.lit(-1).cast("long")).alias("e"))
    parents = own.unionByName(supers).where("relation % 17 <> 0")
    return ways.unionByName(children).unionByName(parents).select("relation", "e.*")


def _trails(spark, d):
    """Parts of each relation's trail: vertices, length, and where they begin and end."""
    t = trails.relation_trails(elements(spark, d))
    km = trails.part_km(t, ["relation"])
    p = F.struct("lon", "lat")
    g = t.groupBy("relation", "part").agg(F.count(F.lit(1)).alias("n_points"), F.min_by(p, "seq").alias("a"), F.max_by(p, "seq").alias("b"), F.max("seq").alias("last_seq"))
    at = lambda x, c, name: rounded(F.col(f"{x}.{c}"), 6).alias(name)
    return g.join(km, ["relation", "part"]).select("relation", "part", "n_points", "last_seq", rounded(F.col("km"), 2).alias("km"), at("a", "lon", "lon1"), at("a", "lat", "lat1"), at("b", "lon", "lon2"), at("b", "lat", "lat2"))


def _fused(spark, d):
    """Routes of two relations each, the second at times before the first: how many parts and vertices their trails have together."""
    t = trails.relation_trails(elements(spark, d))
    r = vertex(spark, d).select(F.col("route").alias("relation")).distinct().select(F.floor(F.col("relation") / 2).alias("route"), (F.col("relation") % 2).alias("nth"), "relation")
    f = trails.fused(t, r)
    return f.groupBy("route").agg(F.max(F.col("part") + 1).alias("parts"), F.count(F.lit(1)).alias("n_points"))


def _errors(spark, d):
    """Relations that give no trail, and why."""
    asked = vertex(spark, d).select(F.col("route").alias("relation")).distinct()
    return trails.relation_errors(asked, elements(spark, d))


ELEMENTS = f"""{VERTEX}, e0 AS (SELECT route AS relation, seq-1 AS n, lon, lat FROM vertex), e1 AS (SELECT *, unnest(CASE WHEN n % {STEPS} = 0 AND n > 0 THEN [n // {STEPS}, n // {STEPS} - 1] ELSE [n // {STEPS}] END) AS k FROM e0),
e2 AS (SELECT relation, k, k // {WAYS} AS child, n, lon, lat + CASE WHEN (k // {WAYS}) = 1 AND relation % 4 = 1 THEN {MOVED_DEG}e0 ELSE 0e0 END AS lat, count(*) OVER (PARTITION BY relation, k) AS size FROM e1),
e3 AS (SELECT relation, CASE WHEN relation % 3 = 0 THEN 0 ELSE child END AS child, k, CASE WHEN (relation*7 + k*5) % 3 = 0 THEN -n ELSE n END AS n, lon, lat FROM e2
 WHERE size >= 2 AND (relation + k) % 11 <> 0 AND relation % 17 <> 0 AND NOT (relation % 3 <> 0 AND child = 2 AND relation % 5 = 0)),
l0 AS MATERIALIZED (SELECT relation AS g, relation*1000 + child AS key, k AS ord, row_number() OVER (PARTITION BY relation, child, k ORDER BY n) - 1 AS seq, lon, lat FROM e3)"""


def _chain_sql(name: str, source: str) -> str:
    """CTEs up to ``name`` (g, key, part, seq, lon, lat) for lines ``source`` (g, key, ord, seq, lon, lat): one recursion over the lines of a key in order."""
    gap = "sqrt((x-{0})*(x-{0})+(y-{1})*(y-{1}))"
    ahead, back = gap.format("x1", "y1"), gap.format("x2", "y2")
    return f"""{name}_e AS MATERIALIZED (SELECT g, key, ord, count(*) AS n, arg_min(lon, seq) AS x1, arg_min(lat, seq) AS y1, arg_max(lon, seq) AS x2, arg_max(lat, seq) AS y2, row_number() OVER (PARTITION BY g, key ORDER BY ord) AS i FROM {source} GROUP BY g, key, ord),
{name}_f(g, key, ord, n, i, x, y, flip, part, joined) AS (SELECT g, key, ord, n, i, x2, y2, false, 0, false FROM {name}_e WHERE i = 1
 UNION ALL SELECT g, key, ord, n, i, CASE WHEN b < a THEN x1 ELSE x2 END, CASE WHEN b < a THEN y1 ELSE y2 END, b < a, part + (least(a, b) > 0.05e0)::INT, least(a, b) <= 0.05e0 AND CASE WHEN b < a THEN x2 = x AND y2 = y ELSE x1 = x AND y1 = y END
 FROM (SELECT e.*, f.x, f.y, f.part, {ahead} AS a, {back} AS b FROM {name}_f f JOIN {name}_e e ON e.g = f.g AND e.key = f.key AND e.i = f.i + 1)),
{name}_o AS (SELECT *, coalesce(sum(n - joined::INT) OVER (PARTITION BY g, key, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {name}_f),
{name}_v AS (SELECT o.g, o.key, o.part, CASE WHEN flip THEN n - 1 - seq ELSE seq END AS pos, joined, start, lon, lat FROM {source} s JOIN {name}_o o ON o.g = s.g AND o.key = s.key AND o.ord = s.ord),
{name} AS MATERIALIZED (SELECT g, key, part, (start + pos - joined::INT)::BIGINT AS seq, lon, lat FROM {name}_v WHERE NOT (joined AND pos = 0))"""


_arc = "(12742000e0*asin(sqrt(pow(sin(radians(lat-plat)/2),2) + cos(radians(plat))*cos(radians(lat))*pow(sin(radians(lon-plon)/2),2))))"
TRAILS = f"""{ELEMENTS}, {_chain_sql('l1', 'l0')}, l2 AS MATERIALIZED (SELECT g, g AS key, (key % 1000)*1000 + part AS ord, seq, lon, lat FROM l1), {_chain_sql('l3', 'l2')},
m0 AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM l3 WINDOW w AS (PARTITION BY g, part ORDER BY seq)), m1 AS (SELECT g, part, sum(coalesce({_arc}, 0e0))/1000e0 AS km FROM m0 GROUP BY ALL),
m2 AS (SELECT *, max(km) OVER (PARTITION BY g) AS top, row_number() OVER (PARTITION BY g ORDER BY km DESC, part) AS rn FROM m1), m3 AS (SELECT g, part, km FROM m2 WHERE km >= 10 OR km >= 0.05e0*top OR rn = 1),
t AS MATERIALIZED (SELECT l3.*, m3.km FROM l3 JOIN m3 USING (g, part))"""

QUERIES = {
    "relation_trails": (
        _trails,
        f"WITH RECURSIVE {TRAILS}, x AS (SELECT g AS relation, part, count(*) AS n_points, max(seq) AS last_seq, any_value(km) AS km, {', '.join(f'arg_{f}({c}, seq) AS {c}{i}' for i, f in ((1, 'min'), (2, 'max')) for c in ('lon', 'lat'))} FROM t GROUP BY g, part) "
        f"SELECT relation, part, n_points, last_seq, {rnd('km', 2)} AS km, {', '.join(f'{rnd(c, 6)} AS {c}' for c in ('lon1', 'lat1', 'lon2', 'lat2'))} FROM x",
    ),
    "fused_trails": (
        _fused,
        f"WITH RECURSIVE {TRAILS}, n0 AS MATERIALIZED (SELECT g // 2 AS g, g // 2 AS key, (g % 2)*1000 + part AS ord, row_number() OVER (PARTITION BY g, part ORDER BY seq) - 1 AS seq, lon, lat FROM t), {_chain_sql('n1', 'n0')} SELECT g AS route, max(part) + 1 AS parts, count(*) AS n_points FROM n1 GROUP BY g",
    ),
    "relation_errors": (
        _errors,
        f"WITH {ELEMENTS} SELECT relation, CASE WHEN relation % 17 = 0 THEN 'relation not found' WHEN relation % 3 <> 0 THEN 'no geometry' ELSE 'no ways' END AS error FROM (SELECT DISTINCT relation FROM e0) WHERE relation NOT IN (SELECT g FROM l0)",
    ),
}
