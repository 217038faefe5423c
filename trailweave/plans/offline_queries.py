"""Queries over files without a network, stations that stay, samples of trails and phrases of landmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import text as tx
from ..functions.geo import arc_m, rounded
from ..operators import lines, offline, spatial
from .catalog_queries import TOP, _top_landmarks
from .derive import SITE, VERTEX, hav, rnd, site, table, vertex
from .grid_queries import COLS, COVER, ROWS, _cover_rows
from .route_queries import MATCH, RADIUS_DEG

LAYERS = ("france", "contours", "hillshade")
BASE = [("base/france", 400), ("base/contours", 100), ("base/hillshade", 26)]


def _files(spark):
    """The grid's files, with sizes that follow from the square and the layer."""
    cell = spark.range(COLS * ROWS * 3).select((F.col("id") % 3).alias("l"), F.floor(F.col("id") / 3 % ROWS).cast("int").alias("row"), F.floor(F.col("id") / (3 * ROWS)).cast("int").alias("col"))
    layer = F.element_at(F.array(*(F.lit(x) for x in LAYERS)), (F.col("l") + 1).cast("int"))
    path = F.concat(F.lit("grid/"), F.col("col").cast("string"), F.lit("_"), F.col("row").cast("string"), F.lit("/"), layer)
    return cell.select("col", "row", "l", path.alias("path"), (F.col("col") * 1000 + F.col("row") * 10 + F.col("l") + 5).cast("long").alias("size"))


def _present(spark):
    """Files of every third square are there, of every other third one layer of an older size; one base file."""
    f, turn = _files(spark), (F.col("col") + F.col("row")) % 3
    grid = f.where((turn == 0) | ((turn == 1) & (F.col("l") == 1))).select("path", F.when(turn == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return grid.unionByName(spark.range(1).select(F.lit("base/france").alias("path"), F.lit(400).cast("long").alias("size")))


FILES = """cells AS (SELECT i % 3 AS l, (i // 3 % 8)::INT AS row, (i // 24)::INT AS col FROM range(288) t(i)),
files AS (SELECT col, row, l, 'grid/' || col || '_' || row || '/' || ['france','contours','hillshade'][l+1] AS path, (col*1000+row*10+l+5)::BIGINT AS size FROM cells),
present AS (SELECT path, CASE WHEN (col+row) % 3 = 1 THEN size+1 ELSE size END AS size FROM files WHERE (col+row) % 3 = 0 OR ((col+row) % 3 = 1 AND l = 1) UNION ALL SELECT 'base/france', 400),
base(path, size) AS (VALUES ('base/france', 400), ('base/contours', 100), ('base/hillshade', 26)),
needed AS (SELECT route, path, size FROM cover JOIN files USING (col, row))"""


def _missing(spark, d):
    """What each line still has to fetch: files that are absent or of another size."""
    return offline.to_download(vertex(spark, d), offline.needed_files(_cover_rows(spark, d), _files(spark)), BASE, _present(spark))


MISSING_SQL = f"""WITH {COVER}, {FILES}, every AS (SELECT * FROM needed UNION ALL SELECT route, path, size FROM (SELECT DISTINCT route FROM vertex) CROSS JOIN base)
SELECT route, count(*) FILTER (WHERE p.path IS NULL) AS files, sum(CASE WHEN p.path IS NULL THEN e.size ELSE 0 END)::BIGINT AS bytes FROM every e LEFT JOIN present p ON p.path = e.path AND p.size = e.size GROUP BY route"""


def _freed(spark, d):
    """What the removal of one of the lines with an even number would free."""
    return offline.freed_by_removal(offline.needed_files(_cover_rows(spark, d).where("route % 2 = 0"), _files(spark)))


FREED_SQL = f"""WITH {COVER}, {FILES}, kept AS (SELECT *, count(*) OVER (PARTITION BY path) AS users FROM needed WHERE route % 2 = 0)
SELECT route, count(*) FILTER (WHERE users = 1) AS files, sum(CASE WHEN users = 1 THEN size ELSE 0 END)::BIGINT AS bytes FROM kept GROUP BY route"""


def _collected(spark, d):
    """Present files that go once only lines whose number ends in 5 remain."""
    return offline.unreferenced(_present(spark), offline.needed_files(_cover_rows(spark, d).where("route % 10 = 5"), _files(spark)), BASE)


COLLECTED_SQL = f"""WITH {COVER}, {FILES}, kept AS (SELECT path FROM needed WHERE route % 10 = 5)
SELECT DISTINCT path, size FROM present WHERE path NOT IN (SELECT path FROM kept) AND (path NOT LIKE 'base/%' OR (SELECT count(*) FROM kept) = 0)"""


def _kept(spark, d):
    """Candidates of each line that are the nearest one to some vertex within 5 km; a lone candidate stays."""
    v = vertex(spark, d)
    s = site(spark, d).withColumns({"at_lon": F.col("lon"), "at_lat": F.col("lat")})
    m = spatial.match_to_lines(s, v, RADIUS_DEG, carried=("at_lon", "at_lat"))
    ord_ = F.row_number().over(Window.partitionBy("home", "route").orderBy("fraction", "site")).alias("ord")
    some = m.select("home", "route", ord_, "site", F.col("at_lon").alias("lon"), F.col("at_lat").alias("lat"))
    return spatial.nearest_kept(some, spatial.homed_lines(v, spatial.home_side(RADIUS_DEG)), CONFIG.station_radius_m, ("home", "route")).select("route", "site", "ord")


KEPT_SQL = f"""WITH {MATCH}, cand AS (SELECT route, site, s.lon, s.lat, row_number() OVER (PARTITION BY route ORDER BY fraction, site)::INT AS ord, count(*) OVER (PARTITION BY route) AS n FROM matched JOIN site s USING (site)),
near AS (SELECT route, seq, site, v.lat AS vlat, pow(v.lon-c.lon,2)+pow(v.lat-c.lat,2) AS d2, row_number() OVER (PARTITION BY route, seq ORDER BY pow(v.lon-c.lon,2)+pow(v.lat-c.lat,2), ord) AS rn FROM vertex v JOIN cand c USING (route)),
won AS (SELECT DISTINCT route, site FROM near WHERE rn = 1 AND sqrt(d2)*111320e0*(1e0+cos(radians(vlat)))/2 <= 5000e0)
SELECT route, site, ord FROM cand c WHERE n = 1 OR EXISTS (SELECT 1 FROM won w WHERE w.route = c.route AND w.site = c.site)"""


def _samples(spark, d):
    """A sample every 150 m along lines of parts of 25 vertices, as shares of the whole length, and the end."""
    parts = vertex(spark, d).withColumn("part", F.floor((F.col("seq") - 1) / 25))
    s = lines.sample_shares(parts, CONFIG.refine_step_m)
    return s.select("route", "k", *(rounded(F.col(c), 6).alias(c) for c in ("share", "lon", "lat")))


SAMPLES_SQL = f"""WITH {VERTEX}, p AS (SELECT *, (seq-1)//25 AS part FROM vertex),
l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(part) OVER w AS part0 FROM p WINDOW w AS (PARTITION BY route ORDER BY seq)),
m AS (SELECT *, CASE WHEN part = part0 THEN {hav('lat0', 'lon0', 'lat', 'lon')} ELSE 0e0 END AS step FROM l),
c AS (SELECT *, sum(step) OVER (PARTITION BY route ORDER BY seq) AS b FROM m),
a AS (SELECT *, lag(b) OVER (PARTITION BY route ORDER BY seq) AS a, max(b) OVER (PARTITION BY route) AS total FROM c),
g AS (SELECT *, unnest(generate_series(CASE WHEN a = 0 THEN 0 ELSE floor(a/150e0)::BIGINT + 1 END, floor(b/150e0)::BIGINT)) AS k FROM a WHERE b > a),
every AS (SELECT route, k, k*150e0/total AS share, lon0 + (lon-lon0)*((k*150e0-a)/(b-a)) AS lon, lat0 + (lat-lat0)*((k*150e0-a)/(b-a)) AS lat FROM g
  UNION ALL SELECT route, floor(total/150e0)::BIGINT + 1, 1e0, lon, lat FROM (SELECT route, max(b) AS total, arg_max(lon, seq) AS lon, arg_max(lat, seq) AS lat FROM c GROUP BY route) WHERE total > 0 AND floor(total/150e0)*150e0/total < 1e0 - 1e-9)
SELECT route, k::BIGINT AS k, {rnd('share', 6)} AS share, {rnd('lon', 6)} AS lon, {rnd('lat', 6)} AS lat FROM every"""

_KINDS = [*tx.LANDMARK_PROSE, "wind_mill"]


def _prose(spark, d):
    """The first three parts of each brand as landmarks in words; every third part has no name."""
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"), kind.alias("kind"))
    t = _top_landmarks(spark, d).where("rank <= 3").join(p, "p_partkey")
    g = t.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "kind"))).alias("marks"))
    return g.select("p_brand", tx.landmark_prose(F.col("marks")).alias("phrase"))


PROSE_SQL = f"""WITH {TOP}, prose(kind, words) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in tx.LANDMARK_PROSE.items())}),
m AS (SELECT p_brand, rank, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name, [{", ".join(f"'{k}'" for k in _KINDS)}][p_partkey % {len(_KINDS)} + 1] AS mark FROM t WHERE rank <= 3),
w AS (SELECT p_brand, rank, CASE WHEN name <> '' THEN name || ' (' || coalesce(words, replace(mark, '_', ' ')) || ')' ELSE words END AS told FROM m LEFT JOIN prose ON prose.kind = m.mark)
SELECT p_brand, coalesce(string_agg(told, ', ' ORDER BY rank), '') AS phrase FROM w GROUP BY p_brand"""


def _ways(spark, d):
    """Kilometres of ways of five vertices, arcsine form."""
    v = vertex(spark, d).withColumn("way", F.floor((F.col("seq") - 1) / 5))
    w = Window.partitionBy("route", "way").orderBy("seq")
    step = F.coalesce(arc_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return v.withColumn("step", step).groupBy("route", "way").agg(rounded(F.sum("step") / 1000.0, 6).alias("km"))


WAYS_SQL = f"""WITH {VERTEX}, w AS (SELECT route, (seq-1)//5 AS way, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM vertex WINDOW w AS (PARTITION BY route, (seq-1)//5 ORDER BY seq))
SELECT route, way::BIGINT AS way, {rnd("(coalesce(sum(12742000e0*asin(sqrt(pow(sin(radians(lat-lat0)/2),2) + cos(radians(lat0))*cos(radians(lat))*pow(sin(radians(lon-lon0)/2),2)))), 0e0)/1000e0)", 6)} AS km FROM w GROUP BY route, way"""


def _kinds(spark, d):
    """The transport kind of each event read as a stop's tags."""
    k, t = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    given = lambda on, key, value: F.when(on, F.struct(F.lit(key).alias("key"), value.alias("value")))
    rail = F.when(t == "view", "station").when(t == "click", "halt").otherwise("tram_stop")
    pairs = F.filter(F.array(given(t.isin("view", "click", "error"), "railway", rail), given(k % 3 == 0, "highway", F.lit("bus_stop")), given(k % 2 == 0, "public_transport", F.lit("platform")), given(k % 5 == 0, "bus", F.lit("yes"))), lambda x: x.isNotNull())
    return table(spark, d, "events").select("event_id", tx.transport_kind(F.map_from_entries(pairs)).alias("kind"))


KINDS_SQL = """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'train' WHEN k % 3 = 0 THEN 'bus' WHEN k % 2 = 0 AND k % 5 = 0 THEN 'bus' ELSE 'train' END AS kind
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)"""


def _count_texts(spark, d):
    """Sites of each area by kind, as one text."""
    n = site(spark, d).groupBy("area", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("area").agg(tx.kind_counts(F.collect_list(F.struct("kind", "n"))).alias("counts"))


COUNTS_SQL = f"WITH {SITE}, n AS (SELECT area, kind, count(*) AS n FROM site GROUP BY 1, 2) SELECT area, string_agg(n || ' ' || kind, ', ' ORDER BY kind) AS counts FROM n GROUP BY area"

QUERIES = {
    "download_missing": (_missing, MISSING_SQL),
    "freed_by_removal": (_freed, FREED_SQL),
    "collected_files": (_collected, COLLECTED_SQL),
    "stations_kept": (_kept, KEPT_SQL),
    "trail_samples": (_samples, SAMPLES_SQL),
    "landmark_prose": (_prose, PROSE_SQL),
    "way_arc_km": (_ways, WAYS_SQL),
    "transport_kinds": (_kinds, KINDS_SQL),
    "poi_count_texts": (_count_texts, COUNTS_SQL),
}
