"""Queries over trails of several parts: distances of stations, hikes as lines, round trips as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..operators import hikes
from .derive import SITE, VERTEX, hav, rnd, site, vertex

#: Vertices of a part, and the kilometres of a step on these lines.
PART, STEP_KM, LOOP_PART, LOOP_KM = 25, (2.0, 8.0), 20, (4.0, 20.0)


def _parts(vertices, size: int, shared):
    """Vertices (route, n from 0, lon, lat) dealt into parts of ``size``; where ``shared`` a part ends on the vertex that the next one begins with."""
    here = F.struct(F.floor(F.col("n") / size).alias("part"), (F.col("n") % size).alias("seq"))
    before = F.struct((F.floor(F.col("n") / size) - 1).alias("part"), F.lit(size).cast("long").alias("seq"))
    both = F.when(shared & (F.col("n") % size == 0) & (F.col("n") > 0), F.array(here, before)).otherwise(F.array(here))
    return vertices.select("route", F.explode(both).alias("p"), "lon", "lat").select("route", "p.part", "p.seq", "lon", "lat")


def _parts_sql(source: str, size: int, shared: str) -> str:
    return f"SELECT route, n // {size} AS part, n % {size} AS seq, lon, lat FROM {source} UNION ALL SELECT route, n // {size} - 1, {size}, lon, lat FROM {source} WHERE {shared} AND n % {size} = 0 AND n > 0"


def _trail(spark, d):
    v = vertex(spark, d).select("route", (F.col("seq") - 1).alias("n"), "lon", "lat")
    return _parts(v, PART, F.col("route") % 2 == 0)


def _stations(trail):
    """Six to nine stations of each line, in order, unevenly spread."""
    r, i = F.col("route"), F.col("idx")
    n = 6 + r % 4
    each = trail.select("route").distinct().withColumn("idx", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    train = (r + i) % 4 != 3
    routes = F.when(train, F.array(F.lit(-1).cast("long"))).otherwise(F.array(r % 3, 10 + r % 2))
    return each.select("route", "idx", ((i - 0.5 + (r * 7 + i * 3) % 10 / 25.0) / n).alias("fraction"), train.alias("train"), (i % 2 == 0).alias("hotel"), routes.alias("routes"))


TRAIL = f"{VERTEX}, v0 AS (SELECT route, seq-1 AS n, lon, lat FROM vertex), trail AS ({_parts_sql('v0', PART, 'route % 2 = 0')})"
STATIONS = """st AS (SELECT *, (idx - 0.5e0 + ((route*7 + idx*3) % 10)/25e0)/(6 + route % 4) AS fraction, (route + idx) % 4 <> 3 AS train, idx % 2 = 0 AS hotel, CASE WHEN (route + idx) % 4 <> 3 THEN [-1::BIGINT] ELSE [route % 3, 10 + route % 2] END AS routes
 FROM (SELECT route, unnest(range(1, 7 + route % 4)) AS idx FROM (SELECT DISTINCT route FROM trail)))"""
SEGMENTS = """s0 AS (SELECT *, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, lead(seq, 2) OVER w IS NULL AS last FROM trail WINDOW w AS (PARTITION BY route, part ORDER BY seq)),
s1 AS (SELECT route, part, seq, lon AS x1, lat AS y1, x2, y2, last, sqrt((x2-lon)*(x2-lon) + (y2-lat)*(y2-lat)) AS deg FROM s0 WHERE x2 IS NOT NULL),
s2 AS (SELECT *, sum(deg) OVER (PARTITION BY route, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM s1), s3 AS (SELECT route, part, max(upto) AS len FROM s2 GROUP BY ALL),
s4 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY route ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS pfrom, sum(len) OVER (PARTITION BY route) AS total FROM s3),
seg AS (SELECT s2.*, pfrom, total, pfrom+upto AS at2, pfrom+upto-deg AS at1 FROM s2 JOIN s4 USING (route, part))"""


def _clip_sql(name: str, cuts: str) -> str:
    """CTEs up to ``name`` (route, src, dst, leg, part, seq, e, lon, lat) for cuts (route, src, dst, leg, f0, f1)."""
    t = lambda at: f"CASE WHEN deg > 0 THEN ({at}-at1)/deg ELSE 0e0 END"
    on = lambda c, at: f"({c}1+({c}2-{c}1)*({t(at)}))"
    return f"""{name}_m AS (SELECT c.src, c.dst, c.leg, s.*, f0*total AS a, f1*total AS b FROM {cuts} c JOIN seg s ON s.route = c.route AND f0 < f1 AND at2 > f0*total AND at1 < f1*total),
{name}_p AS (SELECT route, src, dst, leg, part, seq, 0 AS e, CASE WHEN at1 >= a THEN x1 ELSE {on('x', 'a')} END AS lon, CASE WHEN at1 >= a THEN y1 ELSE {on('y', 'a')} END AS lat, at1 <= a OR at1 <= pfrom AS opens FROM {name}_m
 UNION ALL SELECT route, src, dst, leg, part, seq, 1, CASE WHEN at2 <= b THEN x2 ELSE {on('x', 'b')} END, CASE WHEN at2 <= b THEN y2 ELSE {on('y', 'b')} END, false FROM {name}_m WHERE last OR at2 >= b),
{name}_l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM {name}_p WINDOW w AS (PARTITION BY route, src, dst ORDER BY leg, part, seq, e)),
{name} AS (SELECT route, src, dst, leg, part, seq, e, lon, lat FROM {name}_l WHERE NOT coalesce(opens AND lon = plon AND lat = plat, false))"""


def _km_sql(name: str, points: str) -> str:
    """A CTE ``name`` (route, src, dst, km, n_points, lon1, lat1, lon2, lat2) of clipped points."""
    return f"""{name}_w AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM {points} WINDOW w AS (PARTITION BY route, src, dst ORDER BY leg, part, seq, e)),
{name} AS (SELECT route, src, dst, sum(coalesce({hav('plat', 'plon', 'lat', 'lon')}, 0e0))/1000e0 AS km, count(*) AS n_points, {', '.join(f"arg_{f}({c}, (leg, part, seq, e)) AS {c}{i}" for i, f in ((1, 'min'), (2, 'max')) for c in ('lon', 'lat'))} FROM {name}_w GROUP BY ALL)"""


STATION_KM = f"""{SEGMENTS}, k0 AS (SELECT route, idx AS src, idx AS dst, 0 AS leg, lag(fraction) OVER (PARTITION BY route ORDER BY idx) AS f0, fraction AS f1 FROM st), {_clip_sql('k1', 'k0')}, {_km_sql('k2', 'k1')},
sk AS (SELECT st.*, sum(coalesce(k2.km, 0e0)) OVER (PARTITION BY st.route ORDER BY idx ROWS UNBOUNDED PRECEDING) AS km FROM st LEFT JOIN k2 ON k2.route = st.route AND k2.src = st.idx)"""


def _told(df, *keys):
    at = hikes.described(F.col("line"))
    return df.select(*keys, "km", *at).select(*keys, "km", "n_points", *(rounded(F.col(c), 6).alias(c) for c in ("lon1", "lat1", "lon2", "lat2")))


TOLD = "n_points, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in ("lon1", "lat1", "lon2", "lat2"))


def _station_km(spark, d):
    """How far along its line each station is, over parts and the gaps between them."""
    t = _trail(spark, d)
    return hikes.station_km(hikes.placed_segments(t), _stations(t)).select("route", "idx", rounded(F.col("km"), 3).alias("km"))


def _hike_lines(spark, d):
    """The steps of each line's longest hikes, as lines between their stations."""
    t = _trail(spark, d)
    seg, st = hikes.placed_segments(t), _stations(t)
    at = hikes.station_km(seg, st)
    nodes = at.join(st.select("route", "idx", "train", "hotel", "routes"), ["route", "idx"])
    return _told(hikes.step_lines(seg, at, hikes.longest_hikes(nodes, *STEP_KM)), "route", "hike", "step", "src", "dst")


_BETWEEN = "BETWEEN {}e0 AND {}e0".format(*STEP_KM)
HIKE_LINES_SQL = f"""WITH RECURSIVE {TRAIL}, {STATIONS}, {STATION_KM}, sq AS (SELECT * REPLACE (round_even(km*262144e0, 0)/262144e0 AS km) FROM sk),
ce AS (SELECT a.route, a.idx AS src, b.idx AS dst FROM sq a JOIN sq b ON a.route = b.route AND a.idx < b.idx AND b.km-a.km {_BETWEEN} AND list_has_any(a.routes, b.routes)), two AS (SELECT route, src AS a, dst AS b FROM ce UNION SELECT route, dst, src FROM ce),
r(route, n, m) AS (SELECT DISTINCT route, a, a FROM two UNION SELECT t.route, t.b, r.m FROM r JOIN two t ON t.route = r.route AND t.a = r.n), comp AS (SELECT route, n AS idx, min(m) AS hike FROM r GROUP BY ALL),
f(route, k, fold) AS (SELECT DISTINCT route, 0::BIGINT, []::STRUCT(idx BIGINT, at0 DOUBLE, km DOUBLE, path BIGINT[], train BOOLEAN, hotel BOOLEAN, routes BIGINT[])[] FROM sq
 UNION ALL SELECT route, idx, list_append(fold, {{'idx': idx, 'at0': km, 'km': CASE WHEN top IS NOT NULL THEN -top.less WHEN train THEN 0e0 ELSE -1e0 END, 'path': CASE WHEN top IS NOT NULL THEN list_append(top.path, idx) ELSE [idx] END, 'train': train, 'hotel': hotel, 'routes': routes}})
 FROM (SELECT n.*, f.fold, list_sort(list_transform(list_filter(f.fold, lambda b: b.km >= 0 AND (len(b.path) = 1 OR b.hotel) AND n.km-b.at0 {_BETWEEN} AND list_has_any(b.routes, n.routes)), lambda b: {{'less': -(b.km+n.km-b.at0), 'idx': b.idx, 'path': b.path}}))[1] AS top FROM f JOIN sq n ON n.route = f.route AND n.idx = f.k+1)),
ends AS (SELECT f.route, unnest(fold) AS s FROM f JOIN (SELECT route, max(k) AS k FROM f GROUP BY route) USING (route, k)), best AS (SELECT e.route, hike, arg_min(s, (-s.km, s.idx)) AS s FROM ends e JOIN comp ON comp.route = e.route AND comp.idx = s.idx WHERE s.train AND s.km > 0 GROUP BY ALL),
steps AS (SELECT route, hike, step, p[step] AS src, p[step+1] AS dst FROM (SELECT route, hike, s.path AS p, unnest(range(1, len(s.path))) AS step FROM best)),
cuts AS (SELECT x.route, src, dst, 0 AS leg, a.fraction AS f0, b.fraction AS f1, b.km-a.km AS way FROM steps x JOIN sk a ON a.route = x.route AND a.idx = src JOIN sk b ON b.route = x.route AND b.idx = dst), {_clip_sql('h1', 'cuts')}, {_km_sql('h2', 'h1')}
SELECT x.route, x.hike, x.step, x.src, x.dst, round_even(way*10e0, 0)/10e0 AS km, {TOLD} FROM steps x JOIN cuts USING (route, src, dst) JOIN h2 USING (route, src, dst)"""


def _ring(spark, d):
    """A ring of each nation's customers, closed, in parts that share their ends."""
    s = site(spark, d)
    n = F.count("site").over(hikes.Window.partitionBy("area"))
    i = F.row_number().over(hikes.Window.partitionBy("area").orderBy("site")) - 1
    each = s.select(F.col("area").cast("long").alias("route"), i.cast("long").alias("i"), n.alias("c"))
    each = each.withColumn("n", F.explode(F.when(F.col("i") == 0, F.array(F.col("i"), F.col("c"))).otherwise(F.array("i"))))
    angle = F.col("i") * (2 * 3.141592653589793) / F.col("c")
    v = each.select("route", "n", (2.0 + F.col("route") * 0.5 + 0.12 * F.cos(angle)).alias("lon"), (44.0 + 0.09 * F.sin(angle)).alias("lat"))
    return _parts(v, LOOP_PART, F.lit(True))


RING = f"""{SITE}, r0 AS (SELECT area::BIGINT AS route, row_number() OVER (PARTITION BY area ORDER BY site) - 1 AS i, count(*) OVER (PARTITION BY area) AS c FROM site), r1 AS (SELECT *, unnest(CASE WHEN i = 0 THEN [i, c] ELSE [i] END) AS n FROM r0),
v0 AS (SELECT route, n, 2e0 + route*0.5e0 + 0.12e0*cos(i*6.283185307179586e0/c) AS lon, 44e0 + 0.09e0*sin(i*6.283185307179586e0/c) AS lat FROM r1), trail AS ({_parts_sql('v0', LOOP_PART, 'true')})"""
LOOP_STATIONS = "st AS (SELECT route, idx, (idx - 0.7e0)/8e0 AS fraction FROM (SELECT DISTINCT route FROM trail), range(1, 9) t(idx))"


def _loop_lines(spark, d):
    """The best round trip of each ring, as lines: forward steps, then the step around over the ring's end and start."""
    t = _ring(spark, d)
    seg = hikes.placed_segments(t)
    st = t.select("route").distinct().withColumn("idx", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long")))).withColumn("fraction", (F.col("idx") - 0.7) / 8.0)
    at = hikes.station_km(seg, st)
    return _told(hikes.loop_lines(t, seg, at, hikes.loop_steps(t, at, *LOOP_KM)), "route", "step", "src", "dst", "wraps")


_LOOP = "BETWEEN {}e0 AND {}e0".format(*LOOP_KM)
LOOP_LINES_SQL = f"""WITH RECURSIVE {RING}, {LOOP_STATIONS}, {STATION_KM},
e0 AS (SELECT route, arg_min(lon, (part, seq)) AS ax, arg_min(lat, (part, seq)) AS ay, arg_max(lon, (part, seq)) AS bx, arg_max(lat, (part, seq)) AS byy FROM trail GROUP BY route),
c AS (SELECT route, sum({hav('y1', 'x1', 'y2', 'x2')})/1000e0 AS around FROM seg JOIN e0 USING (route) WHERE {hav('ay', 'ax', 'byy', 'bx')} <= 1000 GROUP BY route),
w AS (SELECT h.route, l.idx AS lo, h.idx AS hi, l.km AS a FROM sk h JOIN sk l ON h.route = l.route AND h.idx > l.idx JOIN c ON c.route = h.route WHERE around-(h.km-l.km) {_LOOP}),
r(route, lo, idx, km) AS (SELECT route, lo, lo, a FROM w UNION SELECT b.route, r.lo, b.idx, b.km FROM r JOIN sk b ON b.route = r.route AND b.idx > r.idx AND b.km-r.km {_LOOP}),
best AS (SELECT w.route, arg_min(w.lo, (w.hi, w.lo)) AS lo, arg_min(w.hi, (w.hi, w.lo)) AS hi FROM w JOIN r ON r.route = w.route AND r.lo = w.lo AND r.idx = w.hi GROUP BY w.route),
pred AS (SELECT b.route, b.lo, b.idx, min(a.idx) AS prev FROM r a JOIN r b ON a.route = b.route AND a.lo = b.lo AND b.idx > a.idx AND b.km-a.km {_LOOP} GROUP BY ALL),
back(route, lo, idx, path) AS (SELECT route, lo, hi, [hi] FROM best UNION ALL SELECT p.route, p.lo, p.prev, list_prepend(p.prev, back.path) FROM back JOIN pred p ON p.route = back.route AND p.lo = back.lo AND p.idx = back.idx),
paths AS (SELECT best.route, back.path FROM best JOIN back ON back.route = best.route AND back.lo = best.lo AND back.idx = best.lo),
steps AS (SELECT route, step, path[step] AS src, CASE WHEN step = len(path) THEN path[1] ELSE path[step+1] END AS dst, step = len(path) AS wraps FROM (SELECT route, path, unnest(range(1, len(path)+1)) AS step FROM paths)),
x AS (SELECT s.*, a.fraction AS fa, b.fraction AS fb, b.km-a.km + CASE WHEN wraps THEN around ELSE 0e0 END AS way FROM steps s JOIN c ON c.route = s.route JOIN sk a ON a.route = s.route AND a.idx = src JOIN sk b ON b.route = s.route AND b.idx = dst),
cuts AS (SELECT route, src, dst, 0 AS leg, fa AS f0, CASE WHEN wraps THEN 1e0 ELSE fb END AS f1 FROM x UNION ALL SELECT route, src, dst, 1, 0e0, fb FROM x WHERE wraps), {_clip_sql('h1', 'cuts')}, {_km_sql('h2', 'h1')}
SELECT x.route, x.step, x.src, x.dst, x.wraps, round_even(way*10e0, 0)/10e0 AS km, {TOLD} FROM x JOIN h2 USING (route, src, dst)"""

QUERIES = {
    "station_km": (_station_km, f"WITH {TRAIL}, {STATIONS}, {STATION_KM} SELECT route, idx, {rnd('km', 3)} AS km FROM sk"),
    "hike_lines": (_hike_lines, HIKE_LINES_SQL),
    "loop_lines": (_loop_lines, LOOP_LINES_SQL),
}
