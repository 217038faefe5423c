"""Queries over stops, journeys, station codes and step graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import degree_distance, degrees_to_m, flat_m, haversine_m, rounded
from ..operators import folds, transit
from ..operators.catalog import first_wins
from ..operators.spatial import band_join, dealt
from .derive import GSTOP, SITE, STOP_TIME, TRIP, gstop, hav, rnd, site, stop_time, table, trip

RADIUS = 2000.0
BAND = f"{SITE}, {GSTOP}, band AS (SELECT site, kind, stop, sqrt(pow((s.lat-g.lat)*111320e0,2)+pow((s.lon-g.lon)*77400e0,2)) AS dist_m FROM site s JOIN gstop g ON abs(s.lat-g.lat) <= 0.02e0 AND abs(s.lon-g.lon) <= 0.03e0)"
AT_STOPS = f"{TRIP}, {STOP_TIME}, at_stop AS (SELECT DISTINCT stop, route FROM stop_time JOIN trip USING (trip))"
AT_PLACES = f"{BAND}, {AT_STOPS}, pr AS (SELECT site, list_sort(list(DISTINCT route)) AS routes FROM band JOIN at_stop USING (stop) WHERE dist_m <= 2000e0 AND kind = 'bus' GROUP BY site UNION ALL SELECT site, [-1::BIGINT] FROM site WHERE kind = 'train')"


def _band(spark, d):
    b = band_join(site(spark, d), gstop(spark, d).select("stop", "lat", "lon"), RADIUS)
    return b.select("site", "stop", rounded(F.col("dist_m"), 1).alias("dist_m"))


def _at_stops(spark, d):
    r = transit.routes_at_stops(stop_time(spark, d), trip(spark, d))
    return r.groupBy("stop").agg(F.count(F.lit(1)).alias("n_routes"), F.min("route").alias("first_route"), F.sum("route").alias("sum_routes"))


def _at_places(spark, d):
    return transit.routes_at_places(site(spark, d), gstop(spark, d).select("stop", "lat", "lon"), transit.routes_at_stops(stop_time(spark, d), trip(spark, d)), RADIUS)


def _places_flat(spark, d):
    return _at_places(spark, d).select("site", F.array_join(F.transform("routes", lambda r: r.cast("string")), ",").alias("routes"))


def _names(spark, d):
    names = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("route"), F.col("c_mktsegment").alias("name"))
    n = transit.line_names(_at_places(spark, d), names)
    return n.select("site", F.array_join("lines", "|").alias("lines"))


def _connected(spark, d):
    """Linked pairs of places by nation. Places with the same routes count as one class, so pairs of places are never listed."""
    p = _at_places(spark, d).join(site(spark, d).select("site", "area"), "site").where("size(routes) > 0")
    classes = p.groupBy("area", "routes").agg(F.count(F.lit(1)).alias("n"))
    side = lambda r, n: classes.select("area", F.explode("routes").alias("route"), F.col("routes").alias(r), F.col("n").alias(n))
    met = side("ra", "na").join(side("rb", "nb"), ["area", "route"]).where("ra < rb").select("area", "ra", "rb", "na", "nb").distinct()
    links = met.select("area", (F.col("na") * F.col("nb")).alias("links")).unionByName(classes.select("area", F.expr("n * (n - 1) div 2").alias("links")))
    return links.groupBy("area").agg(F.sum("links").alias("links")).where("links > 0")


def _codes(spark, d):
    c = table(spark, d, "customer")
    uic = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("87"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.lpad(F.col("c_custkey").cast("string"), 8, "8")).otherwise(F.col("c_custkey").cast("string"))
    return c.select(F.explode(transit.station_codes(F.upper(F.substring("c_mktsegment", 1, 3)), uic)).alias("code")).distinct()


_uic = "CASE WHEN c_custkey % 3 = 0 THEN '87' || c_custkey WHEN c_custkey % 3 = 1 THEN lpad(c_custkey::VARCHAR, 8, '8') ELSE c_custkey::VARCHAR END"
CODES = f"""u AS (SELECT upper(substr(c_mktsegment,1,3)) AS tri, {_uic} AS uic FROM customer), codes AS (
SELECT tri AS code FROM u UNION SELECT uic FROM u UNION SELECT substr(uic,1,7) FROM u WHERE length(uic) = 8
UNION SELECT substr(uic,3) FROM u WHERE starts_with(uic,'87') AND length(uic) >= 4 UNION SELECT '87' || uic FROM u WHERE NOT (starts_with(uic,'87') AND length(uic) >= 4) AND length(uic) <= 6)"""


def _known(spark, d):
    p = site(spark, d).withColumn("code", F.concat(F.lit("87"), (F.col("site") * 7 % 4001).cast("string")))
    return transit.keep_known(p, _codes(spark, d)).select("site", "kind", "code")


def _first_wins(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return first_wins(l, ["l_partkey"], "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_quantity", "l_discount", "l_tax").select("l_partkey", "l_orderkey", "l_linenumber")


def _feeds(spark, d):
    """Stops of the feeds (orders by status) that line items refer to; a feed without an address is left out."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")  # noqa: E741
    used = l.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return o.join(used, "o_orderkey", "left_semi").where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("feeds"), F.countDistinct("o_custkey").alias("owners"))


def _metrics(spark, d):
    s = site(spark, d)
    la, lo = F.col("lat"), F.col("lon")
    return s.select("site", rounded(haversine_m(F.lit(44.0), F.lit(2.5), la, lo), 1).alias("great_circle"), rounded(flat_m(la - 44.0, lo - 2.5), 1).alias("flat"), rounded(degree_distance(F.lit(2.5), F.lit(44.0), lo, la), 5).alias("degrees"), rounded(degrees_to_m(degree_distance(F.lit(2.5), F.lit(44.0), lo, la), la), 1).alias("mean_scale"))


def _nodes(spark, d):
    """Stations along one line for each nation: suppliers in order of key, kilometres from their places."""
    w = Window.partitionBy("area").orderBy("stop")
    g = gstop(spark, d).withColumn("idx", F.row_number().over(w)).withColumn("km", F.col("idx") * 6.0 + (F.col("stop") * 13 % 7))
    train = (F.col("stop") % 3) != 1
    routes = F.when(train, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(F.col("stop") % 4, F.col("stop") % 7 + 10).cast("array<bigint>"))
    return g.select("area", "idx", "km", train.alias("train"), (F.col("stop") % 2 == 0).alias("hotel"), routes.alias("routes"))


NODES = f"{GSTOP}, node AS (SELECT area, row_number() OVER (PARTITION BY area ORDER BY stop) AS idx, stop FROM gstop), nodes AS (SELECT area, idx, idx*6e0 + (stop*13 % 7) AS km, stop % 3 <> 1 AS train, stop % 2 = 0 AS hotel, CASE WHEN stop % 3 <> 1 THEN [-1::BIGINT] ELSE [(stop % 4)::BIGINT, (stop % 7 + 10)::BIGINT] END AS routes FROM node)"


def _edges(spark, d):
    """Steps of 8 to 25 km: stations meet in kilometre bands of the longest step."""
    n = _nodes(spark, d)
    a = n.select("area", F.col("idx").alias("src"), F.col("km").alias("a")).withColumn("band", F.explode(F.array(F.floor(F.col("a") / 25), F.floor(F.col("a") / 25) + 1)))
    b = n.select("area", F.col("idx").alias("dst"), F.col("km").alias("b")).withColumn("band", F.floor(F.col("b") / 25))
    return a.join(b, ["area", "band"]).where("src < dst and b - a between 8 and 25").select("area", "src", "dst", (F.col("b") - F.col("a")).alias("km"))


def _components(spark, d):
    """Stations per component of the steps' graph, by least label over at most as many rounds as a line has stations."""
    from ..operators.graph import label_components

    e = _edges(spark, d)
    node = lambda c: F.struct("area", F.col(c).alias("idx"))
    counted = label_components(e.select(node("src").alias("a"), node("dst").alias("b"))).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    return counted.select((F.col("component.area") * 100000 + F.col("component.idx")).alias("component"), "nodes")


COMPONENTS_SQL = f"""WITH RECURSIVE {NODES}, e AS (SELECT a.area*100000+a.idx AS a, b.area*100000+b.idx AS b FROM nodes a JOIN nodes b ON a.area = b.area AND a.idx < b.idx AND b.km-a.km BETWEEN 8 AND 25),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT DISTINCT a, a FROM two UNION SELECT t.b, r.m FROM r JOIN two t ON t.a = r.n),
c AS (SELECT n, min(m) AS component FROM r GROUP BY n) SELECT component, count(*) AS nodes FROM c GROUP BY component"""


def _constrained(spark, d):
    """Steps between stations that are both trains or share a bus route."""
    n = _nodes(spark, d)
    end = lambda idx, routes: n.select("area", F.col("idx").alias(idx), F.col("routes").alias(routes))
    e = _edges(spark, d).join(end("src", "ra"), ["area", "src"]).join(end("dst", "rb"), ["area", "dst"])
    return e.where(transit.connected(F.col("ra"), F.col("rb"))).select("area", "src", "dst")


CONSTRAINED = f"{NODES}, ce AS (SELECT a.area, a.idx AS src, b.idx AS dst FROM nodes a JOIN nodes b ON a.area = b.area AND a.idx < b.idx AND b.km-a.km BETWEEN 8 AND 25 AND list_has_any(a.routes, b.routes))"


def _hikes(spark, d):
    """The longest hike of each component of the constrained steps, with its stations."""
    from ..operators.graph import label_components

    e = _constrained(spark, d)
    node = lambda c: F.struct("area", F.col(c).alias("idx"))
    part = label_components(e.select(node("src").alias("a"), node("dst").alias("b"))).select("node.area", "node.idx", F.col("component.idx").alias("component"))
    n = _nodes(spark, d).join(part, ["area", "idx"]).groupBy("area", "component").agg(F.sort_array(F.collect_list(F.struct("idx", "km", "train", "hotel", "routes"))).alias("nodes"))
    return n.select("area", "component", folds.longest_path(F.col("nodes"), 8.0, 25.0).alias("hike")).where("hike is not null").select("area", "component", "hike.*")


def _longest(spark, d):
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return _hikes(spark, d).select("area", "component", rounded(F.col("km"), 1).alias("km"), path.alias("path"))


def _hike_steps(spark, d):
    """The steps of the longest hikes in order, each with its way along the line."""
    at = _nodes(spark, d)
    rest = F.size("path") - 1
    pairs = F.arrays_zip(F.slice("path", F.lit(1), rest).alias("src"), F.slice("path", F.lit(2), rest).alias("dst"))
    steps = _hikes(spark, d).select("area", "component", F.posexplode(pairs).alias("step", "s")).select("area", "component", (F.col("step") + 1).alias("step"), "s.src", "s.dst")
    place = lambda idx, km: at.select("area", F.col("idx").alias(idx), F.col("km").alias(km))
    met = steps.join(place("src", "a"), ["area", "src"]).join(place("dst", "b"), ["area", "dst"])
    return met.select("area", "component", "step", "src", "dst", rounded(F.col("b") - F.col("a"), 1).alias("km"))


# The same fold over a line's stations in order: a list of what was reached grows by one station a round.
HIKES = f"""WITH RECURSIVE {CONSTRAINED}, two AS (SELECT area, src AS a, dst AS b FROM ce UNION SELECT area, dst, src FROM ce),
r(area, n, m) AS (SELECT DISTINCT area, a, a FROM two UNION SELECT t.area, t.b, r.m FROM r JOIN two t ON t.area = r.area AND t.a = r.n), comp AS (SELECT area, n AS idx, min(m) AS component FROM r GROUP BY ALL),
f(area, k, st) AS (SELECT DISTINCT area, 0::BIGINT, []::STRUCT(idx BIGINT, at0 DOUBLE, km DOUBLE, path BIGINT[], train BOOLEAN, hotel BOOLEAN, routes BIGINT[])[] FROM nodes
 UNION ALL SELECT area, idx, list_append(st, {{'idx': idx, 'at0': km, 'km': CASE WHEN top IS NOT NULL THEN -top.less WHEN train THEN 0e0 ELSE -1e0 END, 'path': CASE WHEN top IS NOT NULL THEN list_append(top.path, idx) ELSE [idx] END, 'train': train, 'hotel': hotel, 'routes': routes}})
 FROM (SELECT n.*, f.st, list_sort(list_transform(list_filter(f.st, lambda b: b.km >= 0 AND (len(b.path) = 1 OR b.hotel) AND n.km-b.at0 BETWEEN 8 AND 25 AND list_has_any(b.routes, n.routes)), lambda b: {{'less': -(b.km+n.km-b.at0), 'idx': b.idx, 'path': b.path}}))[1] AS top FROM f JOIN nodes n ON n.area = f.area AND n.idx = f.k+1)),
ends AS (SELECT f.area, unnest(st) AS s FROM f JOIN (SELECT area, max(k) AS k FROM f GROUP BY area) USING (area, k)),
best AS (SELECT e.area, component, arg_min(s, (-s.km, s.idx)) AS s FROM ends e JOIN comp ON comp.area = e.area AND comp.idx = s.idx WHERE s.train AND s.km > 0 GROUP BY ALL)"""


def _wraps(spark, d):
    """Pairs of stations whose way around the loop, circumference less the way between, is a step; and the longest total.

    Whether steps lead from one to the other is not looked at here, but in ``round_trip``.
    """
    n = _nodes(spark, d)
    c = n.groupBy("area").agg((F.max("km") + 6).alias("around"))
    # The way around is a step for stations in two bands of 25 km of the way between.
    least = F.floor((F.col("a") + F.col("around") - 25) / 25 - 1e-9)
    lo = n.join(c, "area").select("area", "around", F.col("idx").alias("lo"), F.col("km").alias("a")).withColumn("band", F.explode(F.array(least, least + 1)))
    hi = n.select("area", F.col("idx").alias("hi"), F.col("km").alias("b"), F.floor(F.col("km") / 25).alias("band"))
    wrap = F.col("around") - (F.col("b") - F.col("a"))
    w = lo.join(hi, ["area", "band"]).where("hi > lo").withColumn("wrap", wrap).where("wrap between 8 and 25")
    return w.groupBy("area").agg(F.count(F.lit(1)).alias("wraps"), F.max(F.col("b") - F.col("a") + F.col("wrap")).alias("best_total"), F.min_by(F.struct("lo", "hi"), F.struct(-(F.col("b") - F.col("a")), "lo", "hi")).alias("p")).select("area", "wraps", "best_total", "p.lo", "p.hi")


def _round_trip(spark, d):
    """Wrap pairs whose high station steps reach from the low one, and by nation the first of the longest loops with its path.

    Both sides of a pair meet in kilometre bands of the way between them; a loop is as long as the way around.
    """
    n = _nodes(spark, d)
    c = n.groupBy("area").agg((F.max("km") + 6).alias("around"), F.sort_array(F.collect_list(F.struct("idx", "km"))).alias("nodes"))
    around = c.select("area", "around")
    least = F.floor((F.col("a") + F.col("around") - 25) / 25)
    lo = n.join(around, "area").select("area", "around", F.col("idx").alias("lo"), F.col("km").alias("a")).withColumn("band", F.explode(F.array(least, least + 1)))
    hi = n.select("area", F.col("idx").alias("hi"), F.col("km").alias("b"), F.floor(F.col("km") / 25).alias("band"))
    w = lo.join(hi, ["area", "band"]).where("hi > lo and around - (b - a) between 8 and 25").select("area", "around", "lo", "hi")
    # Each pair's way is long work on a small row: pairs are dealt over the tasks, and the way worked out once.
    w = dealt(w.join(c.select("area", "nodes"), "area"), "area", "lo", "hi")
    w = w.withColumn("path", F.explode(F.array_compact(F.array(folds.forward_path(F.col("nodes"), F.col("lo"), F.col("hi"), 8.0, 25.0)))))
    best = w.groupBy("area").agg(F.count(F.lit(1)).alias("wraps"), F.min_by(F.struct("around", "lo", "hi", "path"), F.struct("hi", "lo")).alias("p"))
    return best.select("area", "wraps", F.col("p.around").alias("total_km"), "p.lo", "p.hi", F.array_join(F.transform("p.path", lambda x: x.cast("string")), ">").alias("path"))


ROUND_TRIP_SQL = f"""WITH RECURSIVE {NODES}, c AS (SELECT area, max(km)+6 AS around FROM nodes GROUP BY area),
w AS (SELECT h.area, l.idx AS lo, h.idx AS hi, l.km AS a FROM nodes h JOIN nodes l ON h.area = l.area AND h.idx > l.idx JOIN c ON c.area = h.area WHERE around-(h.km-l.km) BETWEEN 8 AND 25),
r(area, lo, idx, km) AS (SELECT area, lo, lo, a FROM w UNION SELECT b.area, r.lo, b.idx, b.km FROM r JOIN nodes b ON b.area = r.area AND b.idx > r.idx AND b.km-r.km BETWEEN 8 AND 25),
best AS (SELECT w.area, count(*) AS wraps, arg_min(w.lo, (w.hi, w.lo)) AS lo, arg_min(w.hi, (w.hi, w.lo)) AS hi FROM w JOIN r ON r.area = w.area AND r.lo = w.lo AND r.idx = w.hi GROUP BY w.area),
pred AS (SELECT b.area, b.lo, b.idx, min(a.idx) AS prev FROM r a JOIN r b ON a.area = b.area AND a.lo = b.lo AND b.idx > a.idx AND b.km-a.km BETWEEN 8 AND 25 GROUP BY ALL),
back(area, lo, idx, path) AS (SELECT area, lo, hi, hi::VARCHAR FROM best UNION ALL SELECT p.area, p.lo, p.prev, p.prev || '>' || back.path FROM back JOIN pred p ON p.area = back.area AND p.lo = back.lo AND p.idx = back.idx)
SELECT best.area, wraps, around AS total_km, best.lo, hi, path FROM best JOIN c ON c.area = best.area JOIN back ON back.area = best.area AND back.lo = best.lo AND back.idx = best.lo"""


QUERIES = {
    "gtfs_band_join": (_band, f"WITH {BAND} SELECT site, stop, {rnd('dist_m', 1)} AS dist_m FROM band WHERE dist_m <= 2000e0"),
    "stop_route_set": (_at_stops, f"WITH {AT_STOPS} SELECT stop, count(*) AS n_routes, min(route) AS first_route, sum(route)::BIGINT AS sum_routes FROM at_stop GROUP BY stop"),
    "station_routes": (_places_flat, f"WITH {AT_PLACES} SELECT site, array_to_string(routes, ',') AS routes FROM pr"),
    "transit_line_names": (
        _names,
        f"WITH {AT_PLACES}, e AS (SELECT site, unnest(routes) AS route FROM pr), n AS (SELECT site, CASE WHEN route >= 0 THEN coalesce(c_mktsegment, route::VARCHAR) END AS line FROM e LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON c_custkey = route) "
        "SELECT site, coalesce(string_agg(line, '|' ORDER BY line), '') AS lines FROM n GROUP BY site",
    ),
    "transport_connected": (
        _connected,
        f"WITH {AT_PLACES}, p AS (SELECT pr.site, area, routes FROM pr JOIN site USING (site)) SELECT a.area, count(*) AS links FROM p a JOIN p b ON a.area = b.area AND a.site < b.site WHERE list_has_any(a.routes, b.routes) GROUP BY a.area",
    ),
    "code_set_expand": (_codes, f"WITH {CODES} SELECT code FROM codes"),
    "code_semi_join": (_known, f"WITH {SITE}, {CODES}, p AS (SELECT *, '87' || (site*7 % 4001) AS code FROM site) SELECT site, kind, code FROM p WHERE kind = 'bus' OR code IN (SELECT code FROM codes)"),
    "first_wins_dedup": (
        _first_wins,
        "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_quantity, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1",
    ),
    "feed_restriction": (_feeds, "SELECT o_orderstatus, count(*) AS feeds, count(DISTINCT o_custkey) AS owners FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderstatus <> 'P' GROUP BY o_orderstatus"),
    "haversine_variants": (
        _metrics,
        f"WITH {SITE} SELECT site, {rnd(hav('44e0', '2.5e0', 'lat', 'lon'), 1)} AS great_circle, {rnd('sqrt(pow((lat-44e0)*111320e0,2)+pow((lon-2.5e0)*77400e0,2))', 1)} AS flat, {rnd('sqrt((lon-2.5e0)*(lon-2.5e0)+(lat-44e0)*(lat-44e0))', 5)} AS degrees, "
        f"{rnd('(sqrt((lon-2.5e0)*(lon-2.5e0)+(lat-44e0)*(lat-44e0))*111320e0*(1e0+cos(radians(lat)))/2)', 1)} AS mean_scale FROM site",
    ),
    "step_graph": (_edges, f"WITH {NODES} SELECT a.area, a.idx AS src, b.idx AS dst, b.km-a.km AS km FROM nodes a JOIN nodes b ON a.area = b.area AND a.idx < b.idx AND b.km-a.km BETWEEN 8 AND 25"),
    "step_components": (_components, COMPONENTS_SQL),
    "longest_hike": (_longest, f"{HIKES} SELECT area, component, {rnd('s.km', 1)} AS km, array_to_string(s.path, '>') AS path FROM best"),
    "hike_steps": (
        _hike_steps,
        f"{HIKES}, p AS (SELECT area, component, s.path AS p, unnest(range(1, len(s.path))) AS step FROM best) SELECT p.area, component, step, p[step] AS src, p[step+1] AS dst, {rnd('(b.km-a.km)', 1)} AS km FROM p JOIN nodes a ON a.area = p.area AND a.idx = p[step] JOIN nodes b ON b.area = p.area AND b.idx = p[step+1]",
    ),
    "round_trip": (_round_trip, ROUND_TRIP_SQL),
    "best_loop_total": (
        _wraps,
        f"WITH {NODES}, c AS (SELECT area, max(km)+6 AS around FROM nodes GROUP BY area), w AS (SELECT h.area, l.idx AS lo, h.idx AS hi, h.km-l.km AS fwd, around-(h.km-l.km) AS wrap FROM nodes h JOIN nodes l ON h.area = l.area AND h.idx > l.idx JOIN c ON c.area = h.area) "
        "SELECT area, count(*) AS wraps, max(fwd+wrap) AS best_total, arg_min(lo, (-fwd, lo, hi)) AS lo, arg_min(hi, (-fwd, lo, hi)) AS hi FROM w WHERE wrap BETWEEN 8 AND 25 GROUP BY area",
    ),
}
