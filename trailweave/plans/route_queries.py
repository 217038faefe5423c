"""Queries over lines: lengths, profiles, samples, sections, matches, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.geo import rounded
from ..operators import folds, lines, spatial
from .derive import SITE, VERTEX, hav, rnd, site, vertex

STEPS = f"""{VERTEX}, step AS (SELECT route, seq, lon, lat, elev,
  coalesce({hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0e0) AS step_m,
  coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0e0) AS step_deg,
  coalesce(elev - lag(elev) OVER w, 0e0) AS d_elev FROM vertex WINDOW w AS (PARTITION BY route ORDER BY seq)),
stepped AS (SELECT *, sum(step_m) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING)/1000e0 AS dist_km,
  60e0 * CASE WHEN step_m > 0 AND abs(d_elev)/step_m >= 0.1e0 AND d_elev > 0 THEN d_elev/300e0
              WHEN step_m > 0 AND abs(d_elev)/step_m >= 0.1e0 AND d_elev < 0 THEN -d_elev/450e0
              ELSE step_m/1000e0/4e0 END AS step_min FROM step),
timed AS (SELECT *, sum(step_min) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING) AS time_min FROM stepped)"""

SLOPE = "CASE WHEN step_m > 0 THEN d_elev/step_m*100e0 ELSE 0e0 END"


def _summary(spark, d):
    s = lines.elevation_summary(vertex(spark, d))
    return s.select(
        "route", rounded(F.col("km"), 1).alias("km"), rounded(F.col("minutes"), 1).alias("minutes"), rounded(F.col("top"), 1).alias("top"),
        rounded(F.col("bottom"), 1).alias("bottom"), rounded(F.col("gain"), 1).alias("gain"), rounded(F.col("loss"), 1).alias("loss"),
        lines.difficulty(F.col("gain"), F.col("km")).alias("difficulty"),
    )


SUMMARY_SQL = f"""WITH RECURSIVE {STEPS}, fold(route, seq, gain, loss, pending) AS (
  SELECT route, 1::BIGINT, 0e0::DOUBLE, 0e0::DOUBLE, 0e0::DOUBLE FROM (SELECT DISTINCT route FROM vertex)
  UNION ALL
  SELECT f.route, f.seq + 1,
    f.gain + CASE WHEN f.pending >= 0 AND f.pending + s.d_elev < 0 AND f.pending >= 5 THEN f.pending ELSE 0e0 END,
    f.loss + CASE WHEN f.pending <= 0 AND f.pending + s.d_elev > 0 AND -f.pending >= 5 THEN -f.pending ELSE 0e0 END,
    CASE WHEN (f.pending >= 0 AND f.pending + s.d_elev < 0) OR (f.pending <= 0 AND f.pending + s.d_elev > 0) THEN s.d_elev ELSE f.pending + s.d_elev END
  FROM fold f JOIN step s ON s.route = f.route AND s.seq = f.seq + 1),
ended AS (SELECT route, arg_max(gain + CASE WHEN pending >= 5 THEN pending ELSE 0e0 END, seq) AS gain, arg_max(loss + CASE WHEN -pending >= 5 THEN -pending ELSE 0e0 END, seq) AS loss FROM fold GROUP BY route),
agg AS (SELECT route, max(dist_km) AS km, max(time_min) AS minutes, max(elev) AS top, min(elev) AS bottom FROM timed GROUP BY route)
SELECT route, {rnd("km", 1)} AS km, {rnd("minutes", 1)} AS minutes, {rnd("top", 1)} AS top, {rnd("bottom", 1)} AS bottom, {rnd("gain", 1)} AS gain, {rnd("loss", 1)} AS loss,
  CASE WHEN km <= 0 THEN 'easy' WHEN gain < 500 AND gain/km < 30 THEN 'easy' WHEN gain < 1000 AND gain/km < 50 THEN 'moderate' WHEN gain < 1500 AND gain/km < 70 THEN 'difficult' ELSE 'very_difficult' END AS difficulty
FROM agg JOIN ended USING (route)"""


def _length(spark, d):
    return lines.length_km(vertex(spark, d)).select("route", rounded(F.col("length_km"), 1).alias("length_km"), rounded(F.col("length_deg"), 4).alias("length_deg"), "n_vertices")


def _bbox(spark, d):
    b = lines.bounds(vertex(spark, d))
    return b.select("route", *(rounded(F.col(c), 5).alias(c) for c in b.columns[1:]))


def _circular(spark, d):
    return lines.circular(vertex(spark, d))


def _cumulative(spark, d):
    t = lines.with_time(vertex(spark, d))
    return t.select("route", "seq", rounded(F.col("dist_km"), 3).alias("dist_km"), rounded(F.col("time_min"), 1).alias("time_min"))


def _slopes(spark, d):
    s = lines.with_steps(vertex(spark, d)).where("seq > 1").withColumn("slope", F.when(F.col("step_m") > 0, F.col("d_elev") / F.col("step_m") * 100).otherwise(F.lit(0.0)))
    a = F.abs("slope")
    band = F.when(a >= 15, "very steep").when(a >= 10, "steep").when(a >= 5, "moderate").otherwise("gentle")
    return s.withColumn("band", band).groupBy("route", "band").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("slope"), 2).alias("mean_slope"))


def _resample(spark, d):
    r = lines.resample(vertex(spark, d), 500.0)
    return r.select("route", "k", rounded(F.col("dist_m"), 1).alias("dist_m"), *(rounded(F.col(c), 4).alias(c) for c in ("lon", "lat", "elev")))


RESAMPLE_SQL = f"""WITH {STEPS}, seg AS (SELECT route, seq, lon, lat, elev, dist_km*1000e0 AS b, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(elev) OVER w AS elev0, lag(dist_km*1000e0) OVER w AS a FROM timed WINDOW w AS (PARTITION BY route ORDER BY seq)),
grown AS (SELECT *, unnest(generate_series(CASE WHEN seq = 2 THEN 0 ELSE floor(a/500e0)::BIGINT + 1 END, floor(b/500e0)::BIGINT)) AS k FROM seg WHERE a IS NOT NULL),
hit AS (SELECT route, k, k*500e0 AS dist_m, CASE WHEN b > a THEN (k*500e0 - a)/(b - a) ELSE 0e0 END AS t, lon, lat, elev, lon0, lat0, elev0 FROM grown),
tail AS (SELECT route, max(b) AS b, arg_max(lon, seq) AS lon, arg_max(lat, seq) AS lat, arg_max(elev, seq) AS elev FROM seg GROUP BY route),
every AS (SELECT route, k, dist_m, lon0 + (lon - lon0)*t AS lon, lat0 + (lat - lat0)*t AS lat, elev0 + (elev - elev0)*t AS elev FROM hit
  UNION ALL SELECT route, floor(b/500e0)::BIGINT + 1, b, lon, lat, elev FROM tail WHERE b - floor(b/500e0)*500e0 > 1e0)
SELECT route, k::BIGINT AS k, {rnd("dist_m", 1)} AS dist_m, {rnd("lon", 4)} AS lon, {rnd("lat", 4)} AS lat, {rnd("elev", 4)} AS elev FROM every"""

FROM_KM, TO_KM = 10.0, 40.0


def _section(spark, d):
    s = lines.section(vertex(spark, d), FROM_KM, TO_KM)
    return s.select("route", *(rounded(F.col(c), 1).alias(c) for c in ("gain", "loss", "minutes")), "n", rounded(F.col("from_km"), 2).alias("from_km"), rounded(F.col("to_km"), 2).alias("to_km"))


def _at(km: str) -> str:
    return f"greatest(1, least(coalesce(max(seq) FILTER (WHERE dist_km <= {km}), 1), max(seq) - 1))"


SECTION_SQL = f"""WITH {STEPS}, ends AS (SELECT route, {_at("10e0")} AS a, {_at("40e0")} AS b FROM timed GROUP BY route),
part AS (SELECT t.*, a, CASE WHEN seq > a THEN d_elev ELSE 0e0 END AS moved FROM timed t JOIN ends USING (route) WHERE seq BETWEEN a AND b + 1)
SELECT route, {rnd("sum(greatest(moved, 0e0))", 1)} AS gain, {rnd("sum(greatest(-moved, 0e0))", 1)} AS loss, {rnd("(max(time_min) - min(time_min))", 1)} AS minutes, count(*) AS n,
  {rnd("min(dist_km)", 2)} AS from_km, {rnd("max(dist_km)", 2)} AS to_km FROM part GROUP BY route"""


def _slice(spark, d):
    """Profile between two distances with distance and time from its start."""
    t = lines.with_time(vertex(spark, d))
    targets = t.select("route").distinct().select("route", F.explode(F.array(F.lit(FROM_KM), F.lit(TO_KM))).alias("target_km"))
    e = lines.as_of(t, targets).groupBy("route").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    w = Window.partitionBy("route").orderBy("seq")
    s = t.join(e, "route").where("seq between a and b + 1")
    return s.select("route", "seq", *(rounded(F.col(c) - F.first(c).over(w), 2).alias(c) for c in ("dist_km", "time_min")))


SLICE_SQL = f"""WITH {STEPS}, ends AS (SELECT route, {_at("10e0")} AS a, {_at("40e0")} AS b FROM timed GROUP BY route),
part AS (SELECT t.* FROM timed t JOIN ends USING (route) WHERE seq BETWEEN a AND b + 1)
SELECT route, seq, {rnd("(dist_km - first_value(dist_km) OVER w)", 2)} AS dist_km, {rnd("(time_min - first_value(time_min) OVER w)", 2)} AS time_min FROM part WINDOW w AS (PARTITION BY route ORDER BY seq)"""


def _ticks(spark, d):
    """Distance at every 120 minutes: between the first sample at or after the tick and the one before."""
    t = lines.with_time(vertex(spark, d))
    w = Window.partitionBy("route").orderBy("seq")
    s = t.select("route", "seq", "dist_km", "time_min", F.lag("dist_km").over(w).alias("d0"), F.lag("time_min").over(w).alias("t0")).where("t0 is not null")
    first, last = F.floor(F.col("t0") / 120) + 1, F.floor(F.col("time_min") / 120)
    s = s.withColumn("tick", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    part = (F.col("tick") * 120 - F.col("t0")) / (F.col("time_min") - F.col("t0"))
    return s.select("route", "tick", rounded(F.col("d0") + (F.col("dist_km") - F.col("d0")) * part, 3).alias("dist_km"))


TICKS_SQL = f"""WITH {STEPS}, s AS (SELECT route, seq, dist_km, time_min, lag(dist_km) OVER w AS d0, lag(time_min) OVER w AS t0 FROM timed WINDOW w AS (PARTITION BY route ORDER BY seq)),
g AS (SELECT *, unnest(generate_series(floor(t0/120e0)::BIGINT + 1, floor(time_min/120e0)::BIGINT)) AS tick FROM s WHERE t0 IS NOT NULL)
SELECT route, tick, {rnd("(d0 + (dist_km - d0)*((tick*120e0 - t0)/(time_min - t0)))", 3)} AS dist_km FROM g"""


def _nearest_sample(spark, d):
    t = lines.with_steps(vertex(spark, d)).withColumn("target", F.explode(F.array(*(F.lit(float(x)) for x in (0, 12.5, 25, 1000)))))
    return t.groupBy("route", "target").agg(F.min_by("seq", F.struct(F.abs(F.col("dist_km") - F.col("target")), "seq")).alias("seq"))


def _hover(spark, d):
    """Place and elevation at 15 km, between the as-of vertex and the next."""
    t = lines.with_steps(vertex(spark, d))
    w = Window.partitionBy("route").orderBy("seq")
    nxt = t.select("route", "seq", "dist_km", "lon", "lat", "elev", *(F.lead(c).over(w).alias(f"{c}2") for c in ("dist_km", "lon", "lat", "elev")))
    at = lines.as_of(t, t.select("route").distinct().withColumn("target_km", F.lit(15.0)))
    j = nxt.join(at, ["route", "seq"])
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("target_km") - F.col("dist_km")) / F.nullif(F.col("dist_km2") - F.col("dist_km"), F.lit(0.0))))
    return j.select("route", "seq", *(rounded(F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.coalesce(f, F.lit(0.0)), 4).alias(c) for c in ("lon", "lat", "elev")))


_f = "coalesce(greatest(0e0, least(1e0, (15e0 - dist_km)/nullif(dist_km2 - dist_km, 0e0))), 0e0)"
HOVER_SQL = f"""WITH {STEPS}, ends AS (SELECT route, {_at("15e0")} AS seq FROM timed GROUP BY route),
n AS (SELECT route, seq, dist_km, lon, lat, elev, lead(dist_km) OVER w AS dist_km2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(elev) OVER w AS elev2 FROM timed WINDOW w AS (PARTITION BY route ORDER BY seq))
SELECT route, seq, {rnd(f"(lon + (lon2 - lon)*{_f})", 4)} AS lon, {rnd(f"(lat + (lat2 - lat)*{_f})", 4)} AS lat, {rnd(f"(elev + (elev2 - elev)*{_f})", 4)} AS elev FROM n JOIN ends USING (route, seq)"""

RADIUS_DEG = 0.01


def _match(spark, d):
    m = spatial.match_to_lines(site(spark, d), vertex(spark, d), RADIUS_DEG)
    return m.select("site", "route", rounded(F.col("dist_m"), 1).alias("dist_m"), rounded(F.col("fraction"), 6).alias("fraction"))


MATCH = f"""{SITE}, {VERTEX}, seg0 AS (SELECT route, seq, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM vertex WINDOW w AS (PARTITION BY route ORDER BY seq)),
seg AS (SELECT *, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS deg FROM seg0 WHERE x2 IS NOT NULL),
run AS (SELECT *, coalesce(sum(deg) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before, sum(deg) OVER (PARTITION BY route) AS total FROM seg),
met AS (SELECT site, kind, s.lon AS px, s.lat AS py, r.*, CASE WHEN deg > 0 THEN least(1e0, greatest(0e0, ((s.lon-x1)*(x2-x1)+(s.lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) ELSE 0e0 END AS t
  FROM site s JOIN run r ON s.lon BETWEEN least(x1,x2)-0.01e0 AND greatest(x1,x2)+0.01e0 AND s.lat BETWEEN least(y1,y2)-0.01e0 AND greatest(y1,y2)+0.01e0),
far AS (SELECT *, sqrt(pow(px-(x1+(x2-x1)*t),2)+pow(py-(y1+(y2-y1)*t),2)) AS dist FROM met),
hit AS (SELECT *, row_number() OVER (PARTITION BY site, route ORDER BY dist, seq) AS rn FROM far WHERE dist <= 0.01e0),
matched AS (SELECT site, kind, route, dist*111320e0*(1e0+cos(radians(py)))/2 AS dist_m, CASE WHEN total > 0 THEN (before+deg*t)/total ELSE 0e0 END AS fraction FROM hit WHERE rn = 1)"""


def _gate(spark, d):
    """Matches within a limit that depends on the kind, of routes that have two trains or more."""
    s = site(spark, d).withColumn("train", F.col("kind") == "train").withColumn("most_m", F.when(F.col("kind") == "bus", 400.0).otherwise(F.lit(900.0)))
    m = spatial.match_to_lines(s, vertex(spark, d), RADIUS_DEG, carried=("train", "most_m")).where("dist_m <= most_m")
    # The first by fraction and then by site: the sites at the least fraction, of which there are few, and of them the least.
    same = m.groupBy("home", "route", "fraction").agg(F.count_if("train").alias("trains"), F.count(F.lit(1)).alias("places"), F.min("site").alias("site"))
    n = same.groupBy("home", "route").agg(F.sum("trains").alias("trains"), F.sum("places").alias("places"), F.min_by("site", "fraction").alias("first_site"))
    return n.where(F.col("trains") >= CONFIG.least_trains).drop("home")


GATE_SQL = f"""WITH {MATCH} SELECT route, count(*) FILTER (WHERE kind = 'train') AS trains, count(*) AS places, arg_min(site, (fraction, site)) AS first_site
FROM matched WHERE dist_m <= CASE WHEN kind = 'bus' THEN 400e0 ELSE 900e0 END GROUP BY route HAVING count(*) FILTER (WHERE kind = 'train') >= 2"""


def _ever_nearest(spark, d):
    one = F.lit(1).alias("all")
    return spatial.ever_nearest(site(spark, d).select(one, "site", "lon", "lat"), vertex(spark, d).select(one, F.struct("route", "seq").alias("seq"), "lon", "lat"), "all", 0.02).select("site")


EVER_SQL = f"""WITH {SITE}, {VERTEX}, met AS (SELECT route, seq, site, pow(v.lon-s.lon,2)+pow(v.lat-s.lat,2) AS d2 FROM vertex v JOIN site s ON abs(v.lon-s.lon) <= 0.02e0 AND abs(v.lat-s.lat) <= 0.02e0),
r AS (SELECT *, row_number() OVER (PARTITION BY route, seq ORDER BY d2, site) AS rn FROM met WHERE d2 <= 0.02e0*0.02e0) SELECT DISTINCT site FROM r WHERE rn = 1"""


def _dedup(spark, d):
    m = spatial.match_to_lines(site(spark, d), vertex(spark, d), RADIUS_DEG)
    w = Window.partitionBy("home", "route").orderBy("fraction", "site")
    named = m.withColumn("name", (F.col("site") % 5).cast("string")).withColumn("ord", F.row_number().over(w))
    kept = folds.greedy_dedup(named.select("home", "route", "ord", "site", "name", F.col("fraction").alias("frac"), F.col("dist_m").alias("dist")), ("home", "route"))
    return kept.select("route", "slot", "site", rounded(F.col("frac"), 6).alias("frac"), rounded(F.col("dist"), 1).alias("dist"))


def _ways(spark, d):
    """Ways of five vertices, every third written backwards."""
    v = vertex(spark, d).withColumn("pos", F.floor((F.col("seq") - 1) / 5))
    w = v.groupBy("route", "pos").agg(F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"))
    back = F.col("pos") % 3 == 1
    one, two = F.when(back, F.col("b")).otherwise(F.col("a")), F.when(back, F.col("a")).otherwise(F.col("b"))
    return w.select("route", "pos", one["lon"].alias("x1"), one["lat"].alias("y1"), two["lon"].alias("x2"), two["lat"].alias("y2"))


def _chain(spark, d):
    return folds.chain_ways(_ways(spark, d))


CHAIN_SQL = f"""WITH RECURSIVE {VERTEX}, w0 AS (SELECT route, (seq-1)//5 AS pos, arg_min(lon, seq) AS ax, arg_min(lat, seq) AS ay, arg_max(lon, seq) AS bx, arg_max(lat, seq) AS byy FROM vertex GROUP BY ALL),
way AS (SELECT route, pos, CASE WHEN pos%3=1 THEN bx ELSE ax END AS x1, CASE WHEN pos%3=1 THEN byy ELSE ay END AS y1, CASE WHEN pos%3=1 THEN ax ELSE bx END AS x2, CASE WHEN pos%3=1 THEN ay ELSE byy END AS y2 FROM w0),
c(route, pos, flipped, part, x, y) AS (SELECT route, pos, false, 0, x2, y2 FROM way WHERE pos = 0
 UNION ALL SELECT n.route, n.pos, n.back < n.ahead, c2, CASE WHEN n.back < n.ahead THEN n.x1 ELSE n.x2 END, CASE WHEN n.back < n.ahead THEN n.y1 ELSE n.y2 END
 FROM (SELECT w.*, part + CASE WHEN least(sqrt(pow(w.x1-c.x,2)+pow(w.y1-c.y,2)), sqrt(pow(w.x2-c.x,2)+pow(w.y2-c.y,2))) > 0.05e0 THEN 1 ELSE 0 END AS c2,
   sqrt((w.x1-c.x)*(w.x1-c.x)+(w.y1-c.y)*(w.y1-c.y)) AS ahead, sqrt((w.x2-c.x)*(w.x2-c.x)+(w.y2-c.y)*(w.y2-c.y)) AS back FROM c JOIN way w ON w.route = c.route AND w.pos = c.pos + 1) n)
SELECT route, pos::BIGINT AS pos, flipped, part::INT AS part FROM c"""


def _chunks(spark, d):
    c = folds.box_chunks(vertex(spark, d), 0.03)
    return c.select("route", "chunk", *(rounded(F.col(x), 5).alias(x) for x in ("min_lon", "min_lat", "max_lon", "max_lat")))


CHUNKS_SQL = f"""WITH RECURSIVE {VERTEX}, c(route, seq, chunk, a, b, cc, dd, x, y) AS (SELECT route, seq, 0, lon, lat, lon, lat, lon, lat FROM vertex WHERE seq = 1
 UNION ALL SELECT v.route, v.seq, c.chunk + CASE WHEN o THEN 1 ELSE 0 END, CASE WHEN o THEN least(px, v.lon) ELSE na END, CASE WHEN o THEN least(py, v.lat) ELSE nb END, CASE WHEN o THEN greatest(px, v.lon) ELSE nc END, CASE WHEN o THEN greatest(py, v.lat) ELSE nd END, v.lon, v.lat
 FROM (SELECT v.route, v.seq, v.lon, v.lat, c.chunk, c.x AS px, c.y AS py, least(c.a, v.lon) AS na, least(c.b, v.lat) AS nb, greatest(c.cc, v.lon) AS nc, greatest(c.dd, v.lat) AS nd,
   (greatest(c.cc, v.lon)-least(c.a, v.lon) > 0.03e0 OR greatest(c.dd, v.lat)-least(c.b, v.lat) > 0.03e0) AS o FROM c JOIN vertex v ON v.route = c.route AND v.seq = c.seq + 1) v JOIN (SELECT 1) one ON true CROSS JOIN LATERAL (SELECT v.chunk) c)
SELECT route, chunk::INT AS chunk, {rnd("arg_max(a, seq)", 5)} AS min_lon, {rnd("arg_max(b, seq)", 5)} AS min_lat, {rnd("arg_max(cc, seq)", 5)} AS max_lon, {rnd("arg_max(dd, seq)", 5)} AS max_lat FROM c GROUP BY route, chunk"""


def _gap_parts(spark, d):
    """Parts that begin after a step of over 40 km, without spurious ones."""
    s = lines.with_steps(vertex(spark, d))
    w = Window.partitionBy("route").orderBy("seq")
    gap = F.col("step_m") > 1500
    p = s.withColumn("part", F.sum(gap.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.groupBy("route", "part").agg((F.sum(F.when(gap, 0.0).otherwise(F.col("step_m"))) / 1000.0).alias("km"), F.count(F.lit(1)).alias("n"))
    return lines.drop_spurious(p).select("route", "part", rounded(F.col("km"), 2).alias("km"), "n")


GAP_SQL = f"""WITH {STEPS}, p AS (SELECT *, sum((step_m > 1500)::BIGINT) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM step),
q AS (SELECT route, part, sum(CASE WHEN step_m > 1500 THEN 0e0 ELSE step_m END)/1000e0 AS km, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT *, max(km) OVER (PARTITION BY route) AS top, row_number() OVER (PARTITION BY route ORDER BY km DESC, part) AS rn FROM q)
SELECT route, part::BIGINT AS part, {rnd("km", 2)} AS km, n FROM r WHERE km >= 10 OR km >= 0.05e0*top OR rn = 1"""


def _substring(spark, d):
    """Kilometres between fractions 0.25 and 0.75 of each line, measured in degrees, cut within segments."""
    v = vertex(spark, d)
    s = spatial.segments(v)
    a, b = F.col("total_deg") * 0.25, F.col("total_deg") * 0.75
    t = lambda at: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("before_deg")) / F.nullif(F.col("seg_deg"), F.lit(0.0))))
    s = s.withColumn("t0", F.coalesce(t(a), F.lit(0.0))).withColumn("t1", F.coalesce(t(b), F.lit(0.0))).where("t1 > t0")
    at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col(t)
    from ..functions.geo import haversine_m

    return s.groupBy("route").agg(rounded(F.sum(haversine_m(at("y", "t0"), at("x", "t0"), at("y", "t1"), at("x", "t1"))) / 1000, 2).alias("km"), F.count(F.lit(1)).alias("segments"))


SUBSTRING_SQL = f"""WITH {MATCH.split(", met AS")[0]}, c AS (SELECT *, coalesce(greatest(0e0, least(1e0, (total*0.25e0-before)/nullif(deg,0e0))), 0e0) AS t0, coalesce(greatest(0e0, least(1e0, (total*0.75e0-before)/nullif(deg,0e0))), 0e0) AS t1 FROM run)
SELECT route, {rnd("(sum(" + hav("(y1+(y2-y1)*t0)", "(x1+(x2-x1)*t0)", "(y1+(y2-y1)*t1)", "(x1+(x2-x1)*t1)") + ")/1000e0)", 2)} AS km, count(*) AS segments FROM c WHERE t1 > t0 GROUP BY route"""


def _concat_profiles(spark, d):
    """Steps of twenty vertices joined into one profile: running offsets of distance and time by step."""
    t = lines.with_time(vertex(spark, d)).withColumn("step", F.floor((F.col("seq") - 1) / 20))
    tot = t.groupBy("route", "step").agg((F.max("dist_km") - F.min("dist_km")).alias("km"), (F.max("time_min") - F.min("time_min")).alias("minutes"))
    w = Window.partitionBy("route").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    off = lambda c: rounded(F.coalesce(F.sum(c).over(w), F.lit(0.0)), 3)
    return tot.select("route", "step", off("km").alias("from_km"), off("minutes").alias("from_min"))


CONCAT_SQL = f"""WITH {STEPS}, t AS (SELECT route, (seq-1)//20 AS step, max(dist_km)-min(dist_km) AS km, max(time_min)-min(time_min) AS minutes FROM timed GROUP BY ALL)
SELECT route, step::BIGINT AS step, {rnd("coalesce(sum(km) OVER w, 0e0)", 3)} AS from_km, {rnd("coalesce(sum(minutes) OVER w, 0e0)", 3)} AS from_min FROM t WINDOW w AS (PARTITION BY route ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

_box = ", ".join(f"{rnd(f'{f}({c})', 5)} AS {f}_{c}" for f, c in (("min", "lon"), ("min", "lat"), ("max", "lon"), ("max", "lat")))
_ends = "SELECT route, arg_min(lon, seq) AS ax, arg_min(lat, seq) AS ay, arg_max(lon, seq) AS bx, arg_max(lat, seq) AS byy FROM vertex GROUP BY route"
QUERIES = {
    "route_elevation_summary": (_summary, SUMMARY_SQL),
    "polyline_length": (_length, f"WITH {STEPS} SELECT route, {rnd('(sum(step_m)/1000e0)', 1)} AS length_km, {rnd('sum(step_deg)', 4)} AS length_deg, count(*) AS n_vertices FROM step GROUP BY route"),
    "route_bbox": (_bbox, f"WITH {VERTEX} SELECT route, {_box} FROM vertex GROUP BY route"),
    "circular_flag": (_circular, f"WITH {VERTEX}, e AS ({_ends}) SELECT route, sqrt(pow(bx-ax,2)+pow(byy-ay,2)) < 0.05e0 AS is_circular, {hav('ay', 'ax', 'byy', 'bx')} <= 1000 AS is_loop FROM e"),
    "cumulative_distance": (_cumulative, f"WITH {STEPS} SELECT route, seq, {rnd('dist_km', 3)} AS dist_km, {rnd('time_min', 1)} AS time_min FROM timed"),
    "slope_bands": (
        _slopes,
        f"WITH {STEPS}, s AS (SELECT route, {SLOPE} AS slope FROM step WHERE seq > 1), b AS (SELECT *, CASE WHEN abs(slope) >= 15 THEN 'very steep' WHEN abs(slope) >= 10 THEN 'steep' WHEN abs(slope) >= 5 THEN 'moderate' ELSE 'gentle' END AS band FROM s) "
        f"SELECT route, band, count(*) AS n, {rnd('avg(slope)', 2)} AS mean_slope FROM b GROUP BY ALL",
    ),
    "resample_fixed_step": (_resample, RESAMPLE_SQL),
    "section_stats": (_section, SECTION_SQL),
    "section_slice": (_slice, SLICE_SQL),
    "time_tick_inverse": (_ticks, TICKS_SQL),
    "nearest_sample": (_nearest_sample, f"WITH {STEPS}, t AS (SELECT *, unnest([0e0, 12.5e0, 25e0, 1000e0]) AS target FROM timed) SELECT route, target, arg_min(seq, (abs(dist_km-target), seq)) AS seq FROM t GROUP BY ALL"),
    "hover_interpolate": (_hover, HOVER_SQL),
    "station_trail_match": (_match, f"WITH {MATCH} SELECT site, route, {rnd('dist_m', 1)} AS dist_m, {rnd('fraction', 6)} AS fraction FROM matched"),
    "match_gate": (_gate, GATE_SQL),
    "never_closest_filter": (_ever_nearest, EVER_SQL),
    "greedy_station_dedup": (_dedup, None),
    "chain_ways": (_chain, CHAIN_SQL),
    "bbox_chunks": (_chunks, CHUNKS_SQL),
    "drop_spurious_parts": (_gap_parts, GAP_SQL),
    "substring_length": (_substring, SUBSTRING_SQL),
    "step_profile_concat": (_concat_profiles, CONCAT_SQL),
}
