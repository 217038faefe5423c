"""Queries that give whole documents of routes: tracks, sections, features, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, lines
from .derive import SITE, site, vertex
from .hike_queries import TRAIL, _trail
from .route_queries import STEPS

#: A section's ends in kilometres, and every how many vertices the profile has a sample.
FROM_KM, TO_KM, SAMPLES = 2.0, 6.0, 3
#: Places of a route: those whose number leaves its own by this.
PLACES = 149


def _routes(spark, d):
    return vertex(spark, d).select("route").distinct().select("route", F.concat(F.lit("GR <"), "route", F.lit('> "Été" & co')).alias("name"), F.when(F.col("route") % 2 == 0, F.concat(F.lit("from A & B, "), "route")).alias("description"))


def _places(spark, d):
    kind = F.when(F.col("kind") == "train", "train_station").otherwise("bus_stop")
    url = F.when(F.col("site") % 5 == 0, F.concat(F.lit("https://x/?a=1&b="), "site"))
    return site(spark, d).select((F.col("site") % PLACES).alias("route"), F.col("site").alias("ord"), F.concat("name", F.lit(" <\\é>")).alias("name"), "lat", "lon", kind.alias("poi_type"), url.alias("url"))


def _track(spark, d):
    """Each line as a track: waypoints, segments by part, elevations by running index, some void or lacking."""
    e = vertex(spark, d).where("seq <= 60").select("route", (F.col("seq") - 1).alias("i"), F.when(F.col("elev") >= 20, F.col("elev")).alias("ele"))
    return documents.track_documents(_routes(spark, d), documents.with_elevation(_trail(spark, d), e), _places(spark, d))


def _features(spark, d):
    """Each line with its places as a feature collection."""
    return documents.feature_documents(_routes(spark, d), _trail(spark, d), _places(spark, d))


def _section(spark, d):
    """The stretch of each line from 2 to 6 km as a track; elevations are those of the profile's sample before."""
    timed = lines.with_time(vertex(spark, d)).select("route", "seq", "lon", "lat", "elev", "dist_km")
    ends = timed.select("route").distinct().select("route", F.explode(F.array(F.lit(FROM_KM), F.lit(TO_KM))).alias("target_km"))
    span = lines.as_of(timed, ends).groupBy("route").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    some = timed.join(span, "route").where("seq between a and b + 1").drop("a", "b")
    profile = timed.where(F.col("seq") % SAMPLES == 1).select("route", (F.floor((F.col("seq") - 1) / SAMPLES) + 1).alias("seq"), "dist_km", F.col("elev").alias("ele"))
    found = lines.as_of(profile, some.select("route", F.col("dist_km").alias("target_km")).distinct()).withColumnRenamed("seq", "n").withColumnRenamed("target_km", "dist_km")
    met = some.join(found, ["route", "dist_km"], "left").join(profile.select("route", F.col("seq").alias("n"), "ele"), ["route", "n"], "left")
    title = F.concat(F.lit("GR "), "route", F.lit(" — km 2 → km 6"))
    return documents.section_documents(met.select(F.col("route").alias("section"), title.alias("title"), "seq", "lon", "lat", "ele")).select(F.col("section").alias("route"), "gpx")


def _profile(spark, d):
    """Each line's profile as one text, with the places' positions, here the thousandths of their number."""
    p = lines.with_time(vertex(spark, d)).select("route", "seq", "dist_km", F.col("elev").alias("elev_m"), "time_min")
    at = _places(spark, d).select("route", (F.col("ord") * 7919 % 100003 / 10000.0).alias("km"))
    return documents.elevation_documents(p, at)


def _joined_profile(spark, d):
    """Steps of twenty vertices, each measured from its own start, joined into one profile; step 1 of some lines is missing."""
    t = lines.with_time(vertex(spark, d)).withColumn("step", F.floor((F.col("seq") - 1) / 20))
    w = lines.Window.partitionBy("route", "step")
    own = t.select(F.col("route").alias("hike"), "step", "seq", (F.col("dist_km") - F.min("dist_km").over(w)).alias("dist_km"), F.col("elev").alias("elev_m"), (F.col("time_min") - F.min("time_min").over(w)).alias("time_min"))
    return documents.profile_documents(own.where("not (step = 1 and hike % 4 = 0)")).select(F.col("hike").alias("route"), "json")


def _fixed(v: str, digits: int) -> str:
    n = f"round_even(abs({v})*1e{digits}, 0)::BIGINT"
    return f"(CASE WHEN {v} < 0 AND {n} > 0 THEN '-' ELSE '' END || ({n} // {10**digits})::VARCHAR || '.' || lpad(({n} % {10**digits})::VARCHAR, {digits}, '0'))"


_esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_point = lambda tag, inner: f"'<{tag} lat=\"' || {_fixed('lat', 6)} || '\" lon=\"' || {_fixed('lon', 6)} || '\">' || {inner} || '</{tag}>'"
_ele = f"coalesce('<ele>' || {_fixed('ele', 1)} || '</ele>', '')"
_pair = f"'[' || {_fixed('lon', 6)} || ', ' || {_fixed('lat', 6)} || ']'"
_head = documents.XML.replace("\n", "' || chr(10) || '") + f'<gpx version="1.1" creator="{documents.CREATOR}" xmlns="{documents.TRACKS}">'
ROUTES = f"""rt AS (SELECT route, 'GR <' || route || '> "Été" & co' AS name, CASE WHEN route % 2 = 0 THEN 'from A & B, ' || route END AS description FROM (SELECT DISTINCT route FROM vertex)),
pl AS (SELECT site % {PLACES} AS route, site AS ord, name || ' <\\é>' AS name, lat, lon, CASE WHEN kind = 'train' THEN 'train_station' ELSE 'bus_stop' END AS poi_type, CASE WHEN site % 5 = 0 THEN 'https://x/?a=1&b=' || site END AS url FROM site)"""
TRACK_SQL = f"""WITH {SITE}, {TRAIL}, {ROUTES}, i AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY part, seq) - 1 AS i FROM trail), v AS (SELECT i.*, CASE WHEN e.elev >= 20 THEN e.elev END AS ele FROM i LEFT JOIN vertex e ON e.route = i.route AND e.seq <= 60 AND e.seq - 1 = i.i),
p AS (SELECT route, part, '<trkseg>' || string_agg({_point('trkpt', _ele)}, '' ORDER BY seq) || '</trkseg>' AS t FROM v GROUP BY ALL), t AS (SELECT route, string_agg(t, '' ORDER BY part) AS t FROM p GROUP BY route),
w AS (SELECT route, string_agg({_point('wpt', "'<name>' || " + _esc('name') + " || '</name>'")}, '' ORDER BY ord) AS w FROM pl WHERE poi_type = 'train_station' GROUP BY route)
SELECT route, '{_head}<metadata><name>' || {_esc('name')} || '</name><desc>' || {_esc("coalesce(description, '')")} || '</desc></metadata>' || coalesce(w, '') || '<trk><name>' || {_esc('name')} || '</name>' || coalesce(t, '') || '</trk></gpx>' AS gpx FROM rt LEFT JOIN t USING (route) LEFT JOIN w USING (route)"""
FEATURES_SQL = f"""WITH {SITE}, {TRAIL}, {ROUTES}, p AS (SELECT route, part, '[' || string_agg({_pair}, ', ' ORDER BY seq) || ']' AS t FROM trail GROUP BY ALL), t AS (SELECT route, count(*) AS n, string_agg(t, ', ' ORDER BY part) AS t FROM p GROUP BY route),
f AS (SELECT route, string_agg(', {{"type": "Feature", "properties": {{"feature_type": "poi", "poi_type": ' || to_json(poi_type)::VARCHAR || ', "name": ' || to_json(name)::VARCHAR || coalesce(', "url": ' || to_json(url)::VARCHAR, '') || '}}, "geometry": {{"type": "Point", "coordinates": ' || {_pair} || '}}}}', '' ORDER BY ord) AS f FROM pl GROUP BY route)
SELECT route, '{{"type": "FeatureCollection", "features": [{{"type": "Feature", "properties": {{"id": "' || route || '", "name": ' || to_json(name)::VARCHAR || ', "feature_type": "trail"}}, "geometry": ' || CASE WHEN n = 1 THEN '{{"type": "LineString", "coordinates": ' || t || '}}' ELSE '{{"type": "MultiLineString", "coordinates": [' || t || ']}}' END || '}}' || coalesce(f, '') || ']}}' AS geojson FROM rt JOIN t USING (route) LEFT JOIN f USING (route)"""
SECTION_SQL = f"""WITH {STEPS}, n AS (SELECT route, max(seq) AS n FROM timed GROUP BY route), s AS (SELECT t.route, greatest(1, least(max(seq) FILTER (WHERE dist_km <= {FROM_KM}), any_value(n) - 1)) AS a, greatest(1, least(max(seq) FILTER (WHERE dist_km <= {TO_KM}), any_value(n) - 1)) AS b FROM timed t JOIN n USING (route) GROUP BY t.route),
q AS (SELECT route, (seq-1)//{SAMPLES} + 1 AS k, dist_km AS at_, elev AS ele FROM timed WHERE seq % {SAMPLES} = 1), m AS (SELECT route, max(k) AS m FROM q GROUP BY route),
v AS (SELECT t.route, t.seq, lon, lat, greatest(1, least((SELECT max(k) FROM q WHERE q.route = t.route AND at_ <= t.dist_km), m - 1)) AS k FROM timed t JOIN s USING (route) JOIN m USING (route) WHERE seq BETWEEN a AND b + 1)
SELECT v.route, '{_head}' || chr(10) || '  <trk>' || chr(10) || '    <name>GR ' || v.route || ' — km 2 → km 6</name>' || chr(10) || '    <trkseg>' || chr(10) || string_agg('      ' || {_point('trkpt', _ele)} || chr(10), '' ORDER BY seq) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' AS gpx FROM v LEFT JOIN q ON q.route = v.route AND q.k = v.k GROUP BY v.route"""
_array = lambda c, digits, order: f"'[' || string_agg({_fixed(c, digits)}, ', ' ORDER BY {order}) || ']'"
PROFILE_SQL = f"""WITH {SITE}, {STEPS}, p AS (SELECT route, {_array('dist_km', 3, 'seq')} AS d, {_array('elev', 1, 'seq')} AS e, {_array('time_min', 1, 'seq')} AS t FROM timed GROUP BY route), a AS (SELECT site % {PLACES} AS route, site*7919 % 100003/10000e0 AS km FROM site), b AS (SELECT route, {_array('km', 3, 'km')} AS a FROM a GROUP BY route)
SELECT route, '{{"distances_km": ' || d || ', "elevations_m": ' || e || ', "times_min": ' || t || ', "station_positions_km": ' || coalesce(a, '[]') || '}}' AS json FROM p LEFT JOIN b USING (route)"""
JOINED_SQL = f"""WITH {STEPS}, o AS (SELECT route, (seq-1)//20 AS step, seq, dist_km - min(dist_km) OVER (PARTITION BY route, (seq-1)//20) AS d, elev, time_min - min(time_min) OVER (PARTITION BY route, (seq-1)//20) AS t FROM timed), k AS (SELECT * FROM o WHERE NOT (step = 1 AND route % 4 = 0)),
l AS (SELECT route, step, arg_max(d, seq) AS d, arg_max(t, seq) AS t FROM k GROUP BY ALL), m AS (SELECT route, step, coalesce(sum(d) OVER w, 0e0) AS fd, coalesce(sum(t) OVER w, 0e0) AS ft FROM l WINDOW w AS (PARTITION BY route ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT k.route, k.step, seq, k.d + fd AS d, elev, k.t + ft AS t FROM k JOIN m USING (route, step)), p AS (SELECT route, {_array('d', 3, 'step, seq')} AS d, {_array('elev', 1, 'step, seq')} AS e, {_array('t', 1, 'step, seq')} AS t FROM x GROUP BY route), b AS (SELECT route, {_array('fd', 3, 'step')} AS b FROM m WHERE step > 0 GROUP BY route)
SELECT route, '{{"distances_km": ' || d || ', "elevations_m": ' || e || ', "times_min": ' || t || ', "step_boundaries_km": ' || coalesce(b, '[]') || ', "station_positions_km": []}}' AS json FROM p LEFT JOIN b USING (route)"""

QUERIES = {
    "track_gpx": (_track, TRACK_SQL),
    "section_gpx": (_section, SECTION_SQL),
    "route_geojson": (_features, FEATURES_SQL),
    "profile_json": (_profile, PROFILE_SQL),
    "joined_profile_json": (_joined_profile, JOINED_SQL),
}
