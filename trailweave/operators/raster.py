"""Elevation rasters as blocks of samples: heights of places, windows of map tiles, tile pyramids.

A tile covers one degree from (lat0, lon0) with ``side`` samples each way, rows from north to south, and shares its
outermost samples with its neighbours. Blocks hold a stretch of one row and one sample more, so that
the four samples around a place lie in two blocks of one tile; a place meets just those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bilinear, rgb_channels

#: Steps between samples that a block covers.
BLOCK = 256
VOID = -32768
# The latitude where the square map ends, and how far a box's east and south edge is drawn in.
MOST_LAT, EDGE = 85.051129, 1e-11
_PI = 3.141592653589793


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """lat0, lon0, side, row, block, samples of rows (lat0, lon0, row from the north, samples with null where void) of tiles."""
    side = F.size("samples")
    starts = F.sequence(F.lit(0), F.greatest(side - 2, F.lit(0)), F.lit(block))
    each = rows.select("lat0", "lon0", side.alias("side"), "row", "samples", F.posexplode(starts).alias("block", "_s"))
    return each.select("lat0", "lon0", "side", "row", "block", F.slice("samples", F.col("_s") + 1, F.lit(block + 1)).alias("samples"))


def tile_corner(name: Column) -> tuple[Column, Column]:
    """lat0 and lon0 of a tile by its name, such as N45E006."""
    number = lambda i, sign, minus: F.regexp_extract(name, r"^([NS])(\d{2})([EW])(\d{3})", i).cast("int") * F.when(F.regexp_extract(name, r"^([NS])(\d{2})([EW])(\d{3})", sign) == minus, -1).otherwise(1)
    return number(2, 1, "S"), number(4, 3, "W")


def heights(places: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``places`` (lat, lon, any others) with ``height`` between the four samples around; null without a tile or beside a void.

    Tiles may differ in resolution; what a place reads of a tile follows from the tile's side.
    """
    sides = blocks.groupBy("lat0", "lon0").agg(F.max("side").alias("_side"))
    p = places.select("lat", "lon").distinct().withColumn("lat0", F.floor("lat").cast("int")).withColumn("lon0", F.floor("lon").cast("int")).join(sides, ["lat0", "lon0"])
    north, east = (F.col("lat") - F.col("lat0")) * (F.col("_side") - 1), (F.col("lon") - F.col("lon0")) * (F.col("_side") - 1)
    low = lambda x: F.least(F.floor(x).cast("int"), F.col("_side") - 2)
    p = p.withColumn("_r", low(north)).withColumn("_c", low(east)).withColumn("_fy", north - F.col("_r")).withColumn("_fx", east - F.col("_c"))
    p = p.withColumn("block", F.floor(F.col("_c") / block).cast("int")).withColumn("_south", F.col("_side") - 1 - F.col("_r"))
    both = p.withColumn("row", F.explode(F.array(F.col("_south"), F.col("_south") - 1)))
    at = F.col("_c") - F.col("block") * block
    sample = lambda i: F.coalesce(F.try_element_at("samples", at + i), F.lit(VOID)).cast("double")
    met = both.join(blocks, ["lat0", "lon0", "row", "block"]).withColumn("_w", sample(1)).withColumn("_e", sample(2))
    of = lambda c, south: F.max(F.when((F.col("row") == F.col("_south")) == F.lit(south), F.col(c)))
    four = met.groupBy("lat", "lon", "_fx", "_fy").agg(of("_w", False).alias("nw"), of("_e", False).alias("ne"), of("_w", True).alias("sw"), of("_e", True).alias("se"))
    value = bilinear(F.col("nw"), F.col("ne"), F.col("sw"), F.col("se"), F.col("_fx"), F.lit(1.0) - F.col("_fy"))
    return places.join(four.select("lat", "lon", value.alias("height")), ["lat", "lon"], "left").select(*places.columns, "height")


def _x(lon: Column, n: Column) -> Column:
    return F.least(n - 1, F.greatest(F.lit(0.0), F.floor((lon + 180.0) / 360.0 * n))).cast("long")


def _y(lat: Column, n: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.least(n - 1, F.greatest(F.lit(0.0), F.floor((F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * _PI)) * n))).cast("long")


def pyramid(boxes: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """z, x, y of every map tile that touches one of ``boxes`` (min_lon, min_lat, max_lon, max_lat), once each; a box whose west lies east of its east goes around."""
    split = F.when(F.col("min_lon") > F.col("max_lon"), F.array(F.struct(F.lit(-180.0).alias("w"), F.col("max_lon").alias("e")), F.struct(F.col("min_lon").alias("w"), F.lit(180.0).alias("e")))).otherwise(F.array(F.struct(F.col("min_lon").alias("w"), F.col("max_lon").alias("e"))))
    b = boxes.select("min_lat", "max_lat", F.inline(split)).withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    n = F.pow(F.lit(2.0), F.col("z"))
    clamp = lambda v, most: F.least(F.lit(most), F.greatest(F.lit(-most), v))
    west, east = _x(clamp(F.col("w"), 180.0), n), _x(clamp(F.col("e"), 180.0) - EDGE, n)
    top, bottom = _y(clamp(F.col("max_lat"), MOST_LAT), n), _y(clamp(F.col("min_lat"), MOST_LAT) + EDGE, n)
    rows = b.select("z", west.alias("a"), F.greatest(west, east).alias("b"), F.sequence(top, F.greatest(top, bottom)).alias("ys"))
    return rows.select("z", F.explode(F.sequence("a", "b")).alias("x"), "ys").select("z", "x", F.explode("ys").alias("y")).distinct()


def window_places(tiles: DataFrame, size: int) -> DataFrame:
    """z, x, y, i, j, lat, lon: the centres of a tile's ``size`` by ``size`` pixels, i from the north and j from the west."""
    n = F.pow(F.lit(2.0), F.col("z"))
    each = tiles.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    lon = (F.col("x") + (F.col("j") + 0.5) / size) / n * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh(_PI * (1 - 2 * (F.col("y") + (F.col("i") + 0.5) / size) / n))))
    return each.withColumn("lat", lat).withColumn("lon", lon)


def coded_windows(tiles: DataFrame, blocks: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """z, x, tms_y (counted from the south), pixels: each tile's heights as red, green and blue bytes, row by row; 0 m where there is no height."""
    p = heights(window_places(tiles, size), blocks, block)
    code = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in rgb_channels(F.coalesce("height", F.lit(0.0)))))
    each = p.select("z", "x", "y", (F.col("i") * size + F.col("j")).alias("at"), code.alias("code"))
    whole = each.groupBy("z", "x", "y").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("p"))
    return whole.select("z", "x", (F.pow(F.lit(2.0), F.col("z")).cast("long") - 1 - F.col("y")).alias("tms_y"), F.unhex(F.array_join(F.transform("p", lambda a: a["code"]), "")).alias("pixels"))
