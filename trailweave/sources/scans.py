"""Scans of map elements: stations, beds, landmarks and forests, by boxes with a margin.

Each takes rows of ``readers.elements`` and keeps what a scan of its kind asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..operators import spatial

# The tag values that scans ask for, and their margins in degrees.
BEDS = ("hotel", "guest_house", "hostel", "camp_site")
LANDMARKS = {
    "historic": ("castle", "monument", "ruins", "memorial", "archaeological_site", "fort", "tower", "wayside_cross"),
    "tourism": ("attraction", "viewpoint"),
    "natural": ("peak", "cliff", "cave_entrance", "waterfall"),
    "man_made": ("lighthouse", "tower"),
}
STATION_MARGIN, BED_MARGIN, LANDMARK_MARGIN = 0.05, 0.03, 0.02


def _tag(key: str):
    return F.col("tags")[key]


def placed(rows: DataFrame) -> DataFrame:
    """Rows with a place: their own, else that of their centre; others go."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    at = {c: F.when(own, F.col(c)).otherwise(F.col(f"center.{c}")) for c in ("lat", "lon")}
    return rows.withColumns(at).where("lat is not null and lon is not null")


def stations(rows: DataFrame) -> DataFrame:
    """Nodes of stations and halts in service, of bus stops and of platforms for buses."""
    served = (F.coalesce(_tag("disused"), F.lit("")) != "yes") & (F.coalesce(_tag("abandoned"), F.lit("")) != "yes")
    train = _tag("railway").isin("station", "halt") & served
    bus = (_tag("highway") == "bus_stop") | ((_tag("public_transport") == "platform") & (_tag("bus") == "yes"))
    return rows.where(F.col("type") == "node").where(train | bus)


def accommodation(rows: DataFrame) -> DataFrame:
    """id, name, lat, lon, poi_type, url of named places to sleep: camping for camp sites, else hotel."""
    some = placed(rows.where(F.col("type").isin("node", "way") & _tag("tourism").isin(*BEDS) & (_tag("name") != "")))
    kind = F.when(_tag("tourism") == "camp_site", "camping").otherwise("hotel")
    return some.select("id", _tag("name").alias("name"), "lat", "lon", kind.alias("poi_type"), first_filled(_tag("website"), _tag("contact:website")).alias("url"))


def landmarks(rows: DataFrame) -> DataFrame:
    """id, name, kind, lat, lon, elevation_m of sights; the kind is the first of four tags that says something."""
    asked = F.lit(False)
    for key, kinds in LANDMARKS.items():
        asked = asked | F.coalesce(_tag(key).isin(*kinds), F.lit(False))
    some = placed(rows.where(F.col("type").isin("node", "way") & asked))
    height = _tag("ele").try_cast("double").try_cast("int")
    return some.select("id", F.trim(F.coalesce(_tag("name"), F.lit(""))).alias("name"), first_filled(*(_tag(k) for k in LANDMARKS)).alias("kind"), "lat", "lon", height.alias("elevation_m"))


def forests(rows: DataFrame) -> DataFrame:
    """id, ring, points of wooded areas: a way's own ring, or each member's; rings have four points or more."""
    wood = rows.where(F.col("type").isin("way", "relation")).where((_tag("landuse") == "forest") | (_tag("natural") == "wood"))
    own = F.size(F.coalesce("geometry", F.array().cast("array<struct<lat: double, lon: double>>"))) > 0
    rings = F.when(own, F.array("geometry")).otherwise(F.col("members.geometry"))
    return wood.select("id", F.posexplode(rings).alias("ring", "points")).where(F.size("points") >= 4)


def in_boxes(rows: DataFrame, boxes: DataFrame, margin: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` (lat, lon) in each of ``boxes`` (route, min_lon, min_lat, max_lon, max_lat, any others) widened by ``margin`` degrees, and the rows at all homes.

    A route's boxes and the rows beside them meet in the task of the route's home, and there on cells of a quarter of its tile.
    """
    side, whole = 4 * margin, Window.partitionBy("route")
    low = {f"_{f.__name__}_{c}": f(f"{f.__name__}_{c}").over(whole) for f in (F.min, F.max) for c in ("lon", "lat")}
    lines = boxes.withColumns(low)
    homes = spatial.with_homes(lines.select("route", *(F.col(c).alias(c[1:]) for c in low)), side)
    b = lines.drop(*low).join(homes.select("route", "_lx", "_ly", "home").distinct(), "route")
    b, p = spatial.dealt(b, "home"), spatial.dealt(spatial.at_homes(rows.withColumns({"px": F.col("lon"), "py": F.col("lat")}), homes, side, margin), "home")
    cell = lambda v, l: F.floor(v / (F.pow(F.lit(2.0), F.col(l)) * margin))
    span = lambda c, l: F.explode(F.sequence(cell(F.col(f"min_{c}") - margin, l), cell(F.col(f"max_{c}") + margin, l)))
    b = b.withColumn("_x", span("lon", "_lx")).withColumn("_y", span("lat", "_ly")).drop("_lx", "_ly")
    met = p.withColumn("_x", cell(F.col("px"), "_lx")).withColumn("_y", cell(F.col("py"), "_ly")).drop("_lx", "_ly", "px", "py").join(b, ["home", "_x", "_y"])
    inside = F.col("lon").between(F.col("min_lon") - margin, F.col("max_lon") + margin) & F.col("lat").between(F.col("min_lat") - margin, F.col("max_lat") + margin)
    return met.where(inside).drop("_x", "_y"), p.drop("_lx", "_ly", "px", "py")


def scan(rows: DataFrame, boxes: DataFrame, margin: float, keys: list, order: str) -> DataFrame:
    """home and ``rows`` in any of a route's ``boxes`` (route, chunk, the box): of each key of a route the first by chunk, then by ``order``.

    The first is found by numbers of fixed width, so that nothing is sorted; what else it says is looked up then.
    """
    place = [c for c in ("lat", "lon") if c not in keys]
    names = [*keys, order, *place]
    met, there = in_boxes(rows.dropDuplicates(names), boxes, margin)
    first = met.groupBy("home", "route", *keys, "chunk").agg(F.min(order).alias("_o"), *(F.min_by(c, order).alias(c) for c in place)).withColumnRenamed("_o", order)
    first = first.groupBy("home", "route", *keys).agg(*(F.min_by(c, "chunk").alias(c) for c in (order, *place)), F.min("chunk").alias("_n")).withColumnRenamed("_n", "chunk")
    there = there.withColumnsRenamed({c: f"_{c}" for c in names}).withColumnRenamed("home", "_home").hint("shuffle_hash")
    same = F.col("home") == F.col("_home")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return first.join(there, same).drop("_home", *(f"_{c}" for c in names))


def landmark_key():
    """What tells landmarks apart: the kind and the place to five decimals."""
    return F.format_string("%s:%.5f,%.5f", "kind", "lat", "lon")


def feed_urls(spark: SparkSession, path: str) -> DataFrame:
    """resource_id, url of the timetable feeds at hand in a list of datasets; the last of an id wins."""
    sets = spark.read.schema("resources array<struct<id: bigint, format: string, is_available: boolean, url: string>>").json(path, multiLine=True)
    each = sets.select(F.monotonically_increasing_id().alias("n"), F.posexplode("resources").alias("at", "r"))
    some = each.where("r.format = 'GTFS' and r.is_available and r.id <> 0 and r.url <> ''")
    return some.groupBy(F.col("r.id").alias("resource_id")).agg(F.max_by("r.url", F.struct("n", "at")).alias("url"))
