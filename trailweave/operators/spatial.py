"""Joins of places by distance: grid-keyed bands, nearest points of lines, polygons, grid covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.geo import degrees_to_m, flat_m, foot

#: Height of the bands of latitude in which points meet the edges of polygons.
BAND_DEG = 0.1


def _around(cell: Column) -> Column:
    return F.explode(F.sequence(cell - 1, cell + 1))


def band_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Rows of both sides within the radius, dist_m added; both have lat and lon, the right's become rlat and rlon.

    The right side goes to the nine cells around its own, so each pair meets once on an equal key.
    """
    dlat, dlon = radius_m / CONFIG.degree_m, radius_m / CONFIG.degree_lon_m
    cell = lambda c, size: F.floor(F.col(c) / size)
    a = left.withColumn("_y", cell("lat", dlat)).withColumn("_x", cell("lon", dlon))
    b = right.withColumnRenamed("lat", "rlat").withColumnRenamed("lon", "rlon")
    b = b.withColumn("_y", _around(cell("rlat", dlat))).withColumn("_x", _around(cell("rlon", dlon)))
    met = a.join(b, ["_x", "_y"]).withColumn("dist_m", flat_m(F.col("lat") - F.col("rlat"), F.col("lon") - F.col("rlon")))
    return met.where(F.col("dist_m") <= radius_m).drop("_x", "_y")


def segments(vertices: DataFrame, by: tuple = ("route",), parts: tuple = ()) -> DataFrame:
    """``by``, ``parts``, seq, x1, y1, x2, y2, seg_deg, before_deg, total_deg of a vertex table; none leads from one of the ``parts`` to the next."""
    w, line = Window.partitionBy(*by).orderBy("seq"), Window.partitionBy(*by)
    same = F.lit(True)
    for c in parts:
        same = same & F.lead(c).over(w).eqNullSafe(F.col(c))
    nxt = vertices.select(*by, *parts, "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.when(same, F.lead("lon").over(w)).alias("x2"), F.lead("lat").over(w).alias("y2")).where("x2 is not null")
    size = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    nxt = nxt.withColumn("seg_deg", size)
    before = F.coalesce(F.sum("seg_deg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return nxt.withColumn("before_deg", before).withColumn("total_deg", F.sum("seg_deg").over(line))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in tasks by ``keys``, in so many that one holds a small share whatever the rows weigh: what they meet weighs far more.

    The session is told that joins by these keys and more may stay in such tasks.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism), *keys)


def _home(lx: Column, ly: Column, tx: Column, ty: Column) -> Column:
    """One number for a tile and its classes of width and height."""
    return ((lx * 64 + ly).cast("long") * (1 << 24) + (tx + (1 << 23))) * (1 << 24) + (ty + (1 << 23))


def home_side(radius_deg: float) -> float:
    """Side of the least homes for lines that are matched within a radius."""
    return 2 * radius_deg


def with_homes(rows: DataFrame, side: float) -> DataFrame:
    """``rows`` (min_lon, min_lat, max_lon, max_lat, any others) with home: the tile that holds a box's low corner.

    Tiles of a class are ``side`` degrees times a power of two wide and high, the least that are no smaller than the box.
    """
    level = lambda a, b: F.greatest(F.lit(0), F.ceil(F.log2((F.col(b) - F.col(a)) / side))).cast("int")
    tile = lambda c, l: F.floor(F.col(c) / (F.pow(F.lit(2.0), F.col(l)) * side))
    rows = rows.withColumn("_lx", level("min_lon", "max_lon")).withColumn("_ly", level("min_lat", "max_lat"))
    return rows.withColumn("home", _home(F.col("_lx"), F.col("_ly"), tile("min_lon", "_lx"), tile("min_lat", "_ly")))


def at_homes(points: DataFrame, boxes: DataFrame, side: float, pad: float) -> DataFrame:
    """``points`` (px, py, any others) with _lx, _ly and home, once for each home whose boxes may hold it or pass within ``pad``; ``boxes`` have _lx and _ly of all classes."""
    classes = boxes.select("_lx", "_ly").distinct().agg(F.collect_list(F.struct("_lx", "_ly"))).scalar()
    size = lambda l: F.pow(F.lit(2.0), F.col(l)) * side
    pad = pad * (1 + 1e-6) + 1e-9
    tiles = lambda c, l: F.explode(F.sequence(F.floor((F.col(c) - pad) / size(l)) - 1, F.floor((F.col(c) + pad) / size(l))))
    each = points.withColumn("_c", F.explode(classes)).select(*points.columns, "_c._lx", "_c._ly").withColumn("_tx", tiles("px", "_lx")).withColumn("_ty", tiles("py", "_ly"))
    return each.withColumn("home", _home(F.col("_lx"), F.col("_ly"), F.col("_tx"), F.col("_ty"))).drop("_tx", "_ty")


def homed_lines(vertices: DataFrame, side: float) -> DataFrame:
    """``vertices`` (route, lon, lat, any others) with the home of their line."""
    line = Window.partitionBy("route")
    box = {f"{f.__name__}_{c}": f(c).over(line) for f in (F.min, F.max) for c in ("lon", "lat")}
    return with_homes(vertices.withColumns(box), side).drop(*box)


def match_to_lines(places: DataFrame, vertices: DataFrame, radius_deg: float, carried: tuple = (), parts: tuple = ()) -> DataFrame:
    """Nearest point of every line within ``radius_deg`` of each place: home, site, route, dist_deg, fraction, jlon, jlat, dist_m, also the columns of the places that are ``carried`` and of the nearest segment's ``parts``.

    A line and the places beside it meet in the task of the line's home, so all rows of a line are there, and what
    is asked by (home, route) or (home, route, site) needs no shuffle of them. Within, segments go to the cells that
    their padded boxes touch, places to their own; of distances that agree to 2^-42 of the radius the first segment's
    counts. The fraction is measured in degrees along the line.
    """
    side = home_side(radius_deg)
    cell = lambda v: F.floor(v / radius_deg)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - radius_deg), cell(F.greatest(a, b) + radius_deg)))
    lines = homed_lines(vertices, side)
    s = segments(dealt(lines.select("home", "route", *parts, "seq", "lon", "lat"), "home"), ("home", "route"), parts)
    s = s.withColumn("_x", span(F.col("x1"), F.col("x2"))).withColumn("_y", span(F.col("y1"), F.col("y2")))
    p = places.select("site", *carried, F.col("lon").alias("px"), F.col("lat").alias("py"))
    p = dealt(at_homes(p, lines, side, radius_deg).drop("_lx", "_ly"), "home").withColumn("_x", cell(F.col("px"))).withColumn("_y", cell(F.col("py")))
    t = foot(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    met = p.join(s, ["home", "_x", "_y"]).withColumn("t", t)
    met = met.withColumn("jlon", F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("t")).withColumn("jlat", F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("t"))
    met = met.withColumn("dist_deg", F.sqrt(F.pow(F.col("px") - F.col("jlon"), F.lit(2)) + F.pow(F.col("py") - F.col("jlat"), F.lit(2)))).where(F.col("dist_deg") <= radius_deg)
    met = met.withColumn("fraction", F.when(F.col("total_deg") > 0, (F.col("before_deg") + F.col("seg_deg") * F.col("t")) / F.col("total_deg")).otherwise(F.lit(0.0)))
    met = met.withColumn("dist_m", degrees_to_m(F.col("dist_deg"), F.col("py")))
    # Distance and place in one number, so that the aggregation holds numbers of fixed width and sorts nothing.
    rank = (F.col("dist_deg") / radius_deg * float(1 << 42)).cast("long") * (1 << 20) + F.least(F.col("seq"), F.lit((1 << 20) - 1))
    return met.withColumn("_r", rank).groupBy("home", "site", *carried, "route").agg(*(F.min_by(c, "_r").alias(c) for c in ("dist_deg", "fraction", "jlon", "jlat", "dist_m", *parts)))


def _nearest(vertices: DataFrame, places: DataFrame, keys: list, radius_deg: float, parts: tuple) -> DataFrame:
    """``keys``, seq, vx, vy, rank, d2 of ``vertices`` (``keys``, seq, vx, vy): the first by d2 and rank of the ``places`` (``keys``, rank, px, py) within the radius, null if there is none.

    The search goes from the smallest of the radii, ``parts`` of the whole, to the whole one; a vertex that has found a
    place meets no more. A vertex meets the four cells that its box touches, a place lies in one, so that where
    places are many a vertex is compared with few of them. Both sides stay in the tasks that they come in.
    """
    found = vertices.withColumn("rank", F.lit(None).cast(places.schema["rank"].dataType)).withColumn("d2", F.lit(None).cast("double"))
    v = [*keys, "seq", "vx", "vy"]
    for n in parts:
        r = radius_deg / n
        cell = lambda x: F.floor(x / (2 * r))  # noqa: B023, E731
        around = lambda c: F.when(F.col("rank").isNull(), F.sequence(cell(F.col(c) - r * (1 + 1e-9)), cell(F.col(c) + r * (1 + 1e-9))))  # noqa: B023, E731
        open_ = found.withColumnsRenamed({"rank": "_rank", "d2": "_d2"}).withColumn("rank", F.col("_rank"))
        open_ = open_.withColumn("_x", F.explode_outer(around("vx"))).withColumn("_y", F.explode_outer(around("vy"))).drop("rank")
        p = places.withColumn("_x", cell(F.col("px"))).withColumn("_y", cell(F.col("py")))
        d2 = F.pow(F.col("vx") - F.col("px"), F.lit(2)) + F.pow(F.col("vy") - F.col("py"), F.lit(2))
        met = open_.join(p, [*keys, "_x", "_y"], "left").withColumn("d2", F.coalesce("_d2", F.when(d2 <= r * r, d2))).withColumn("rank", F.when(F.col("d2").isNotNull(), F.coalesce("_rank", "rank")))
        found = met.groupBy(*v, "d2").agg(F.min("rank").alias("rank")).groupBy(*v).agg(F.min_by("rank", "d2").alias("rank"), F.min("d2").alias("d2"))
    return found


def ever_nearest(places: DataFrame, vertices: DataFrame, key: str, radius_deg: float) -> DataFrame:
    """key, site of the places (key, site, ...) that are the nearest of their key to some vertex within the radius.

    Vertices are dealt by tiles of eight radii, places to all tiles within the radius, and meet there by ever wider cells.
    """
    tile = lambda x: F.floor(x / (8 * radius_deg))
    near = lambda c: F.explode(F.sequence(tile(F.col(c) - radius_deg * (1 + 1e-9)), tile(F.col(c) + radius_deg * (1 + 1e-9))))
    v = vertices.select(key, "seq", F.col("lon").alias("vx"), F.col("lat").alias("vy"))
    v = dealt(v.withColumn("_tx", tile(F.col("vx"))).withColumn("_ty", tile(F.col("vy"))), "_tx", "_ty")
    p = places.select(key, F.col("site").alias("rank"), F.col("lon").alias("px"), F.col("lat").alias("py"))
    p = dealt(p.withColumn("_tx", near("px")).withColumn("_ty", near("py")), "_tx", "_ty")
    found = _nearest(v, p, ["_tx", "_ty", key], radius_deg, (64, 16, 4, 1))
    return found.where("rank is not null").select(key, F.col("rank").alias("site")).distinct()


def nearest_kept(candidates: DataFrame, vertices: DataFrame, radius_m: float, by: tuple = ("route",)) -> DataFrame:
    """Candidates (``by``, ord, site, lon, lat) that are their route's nearest one to some vertex within ``radius_m``.

    Nearness is compared in degrees, of equals the first by ``ord`` counts, and the metres follow from the
    vertex's latitude. A route's lone candidate stays wherever it is. ``ord`` numbers a route's candidates. Both are
    tables by ``by``, which may begin with the home that ``vertices`` are dealt by.
    """
    widest = 2 * radius_m / CONFIG.degree_m
    v = dealt(vertices.select(*by, "seq", F.col("lon").alias("vx"), F.col("lat").alias("vy")), by[0])
    p = candidates.select(*by, F.col("ord").alias("rank"), F.col("lon").alias("px"), F.col("lat").alias("py"))
    best = _nearest(v, p, list(by), widest, (64, 1)).where(degrees_to_m(F.sqrt("d2"), F.col("vy")) <= radius_m)
    won = best.select(*by, F.col("rank").alias("ord")).distinct()
    many = candidates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).join(won.withColumn("_won", F.lit(True)), [*by, "ord"], "left")
    return many.where("_n = 1 or _won").select(*candidates.columns)


def inside(points: DataFrame, edges: DataFrame) -> DataFrame:
    """point, poly for each point (area, point, px, py) inside a polygon given by edges (area, poly, x1, y1, x2, y2): crossings to the right are odd.

    Points meet only edges that pass their band of latitude, so that work follows the edges beside them.
    """
    band = lambda c: F.floor(c / BAND_DEG)
    passed = edges.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    met = points.withColumn("_band", band(F.col("py"))).join(passed, ["area", "_band"])
    above = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    x = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = met.groupBy("point", "poly").agg(F.count_if(above & (F.col("px") < x)).alias("n"))
    return crossed.where("n % 2 = 1").select("point", "poly")


def grid_cover(boxes: DataFrame, key: str, west: float, south: float, east: float, north: float, cols: int, rows: int, pad: float = CONFIG.grid_pad_deg) -> DataFrame:
    """key, col, row of the grid squares that each padded box (min_lon ...) touches; a box outside has none."""
    w, h = (east - west) / cols, (north - south) / rows
    clamp = lambda v, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), v))
    x0, x1 = clamp(F.col("min_lon") - pad, west, east), clamp(F.col("max_lon") + pad, west, east)
    y0, y1 = clamp(F.col("min_lat") - pad, south, north), clamp(F.col("max_lat") + pad, south, north)
    number = lambda v, lo, size, n: F.least(F.lit(n - 1), F.floor((v - lo) / size).cast("int"))
    some = (x0 < x1) & (y0 < y1)
    span = lambda a, b: F.when(some, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    out = boxes.select(key, x0.alias("_x0"), span(number(y0, south, h, rows), number(y1, south, h, rows)).alias("_r"), span(number(x0, west, w, cols), number(x1, west, w, cols)).alias("_c"))
    return out.select(key, "_c", F.explode("_r").alias("row")).select(key, F.explode("_c").alias("col"), "row")


def split_boxes(boxes: DataFrame, key: str, side: float) -> DataFrame:
    """key, row, col and bounds of equal cells no wider than ``side``, row by row."""
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / side).cast("int"))
    cut = boxes.withColumn("ny", n("min_lat", "max_lat")).withColumn("nx", n("min_lon", "max_lon"))
    cut = cut.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    at = lambda a, b, i, n: F.col(a) + (F.col(b) - F.col(a)) * i / F.col(n)
    return cut.select(
        key, "row", "col", at("min_lat", "max_lat", F.col("row"), "ny").alias("south"), at("min_lon", "max_lon", F.col("col"), "nx").alias("west"),
        at("min_lat", "max_lat", F.col("row") + 1, "ny").alias("north"), at("min_lon", "max_lon", F.col("col") + 1, "nx").alias("east"),
    )
