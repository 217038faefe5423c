"""Queries over elevation tiles that the embeddings give, eight samples each way: heights of places, coded map tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..operators import raster
from .derive import rnd, site, table

SIDE, BLOCK, PIXELS, ZOOMS = 8, 4, 4, (5, 7)


def _corner(k):
    return (F.pmod(k, F.lit(120)) - 60).cast("int"), (F.pmod(F.floor(k / 120), F.lit(340)) - 170).cast("int")


def _rows(spark, d):
    """Rows of tiles: an embedding in thousandths, under -300 void; of one corner the embedding of least number."""
    lat0, lon0 = _corner(F.col("vec_id"))
    e = table(spark, d, "embeddings").groupBy(lat0.alias("lat0"), lon0.alias("lon0")).agg(F.min_by("embedding", "vec_id").alias("e"))
    sample = lambda x: F.when(F.floor(x.cast("double") * 1000.0) >= -300, F.floor(x.cast("double") * 1000.0)).cast("int")
    e = e.withColumn("e", F.transform("e", sample)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return e.select("lat0", "lon0", "row", F.slice("e", F.col("row") * SIDE + 1, F.lit(SIDE)).alias("samples"))


def _heights(spark, d):
    """Heights of places spread over the tiles; null where there is no tile, or beside a void."""
    lat0, lon0 = _corner(F.col("site") * 31 % 600)
    s = site(spark, d).select("site", (lat0 + (F.col("site") * 7919 % 10007) / 10007.0).alias("lat"), (lon0 + (F.col("site") * 104729 % 10009) / 10009.0).alias("lon"))
    return raster.heights(s, raster.blocks_of(_rows(spark, d), BLOCK), BLOCK).select("site", rounded(F.col("height"), 3).alias("height"))


def _windows(spark, d):
    """Map tiles over every fiftieth elevation tile at three zooms, coded as colours."""
    lat0, lon0 = _corner(F.col("vec_id"))
    boxes = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(lon0.cast("double").alias("min_lon"), lat0.cast("double").alias("min_lat"), (lon0 + 1.0).alias("max_lon"), (lat0 + 1.0).alias("max_lat"))
    w = raster.coded_windows(raster.pyramid(boxes, *ZOOMS), raster.blocks_of(_rows(spark, d), BLOCK), PIXELS, BLOCK)
    return w.select("z", "x", "tms_y", F.lower(F.hex("pixels")).alias("pixels"))


_lat0, _lon0 = "(({0}) % 120 - 60)", "((({0})//120) % 340 - 170)"
TILES = f"tile AS (SELECT {_lat0.format('vec_id')}::INT AS lat0, {_lon0.format('vec_id')}::INT AS lon0, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1, 2)"


def _height_sql(source: str) -> str:
    """CTEs up to ``h``: ``source`` (lat, lon, any others) with height."""
    at = lambda row, col: f"(CASE WHEN floor(e[(({row})*8+{col}+1)::INT]::DOUBLE*1000e0) >= -300 THEN floor(e[(({row})*8+{col}+1)::INT]::DOUBLE*1000e0) END)"
    return f"""h0 AS (SELECT s.*, e, (lat-lat0)*7 AS north, (lon-lon0)*7 AS east FROM {source} s LEFT JOIN tile ON lat0 = floor(lat)::INT AND lon0 = floor(lon)::INT),
h1 AS (SELECT *, least(floor(north), 6)::INT AS r, least(floor(east), 6)::INT AS c FROM h0), h2 AS (SELECT *, north-r AS fy, east-c AS fx, {at('6-r', 'c')} AS nw, {at('6-r', '(c+1)')} AS ne, {at('7-r', 'c')} AS sw, {at('7-r', '(c+1)')} AS se FROM h1),
h AS (SELECT *, (nw*(1-fx)+ne*fx)*(1-(1e0-fy)) + (sw*(1-fx)+se*fx)*(1e0-fy) AS height FROM h2)"""


_n = "pow(2e0, z)"
_yy = lambda lat: f"floor((0.5e0 - ln((1+sin(radians({lat})))/(1-sin(radians({lat}))))/(4*3.141592653589793e0))*{_n})::BIGINT"
WINDOWS_SQL = f"""WITH {TILES}, b AS (SELECT {_lon0.format('vec_id')} AS w, {_lat0.format('vec_id')} AS s, unnest([5, 6, 7]) AS z FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT z, floor((w+180e0)/360e0*{_n})::BIGINT AS x0, floor((w+1-1e-11+180e0)/360e0*{_n})::BIGINT AS x1, {_yy('(s+1e0)')} AS y0, {_yy('(s+1e-11)')} AS y1 FROM b),
t0 AS (SELECT z, unnest(range(x0, x1+1)) AS x, y0, y1 FROM r), t AS (SELECT DISTINCT z, x, y FROM (SELECT z, x, unnest(range(y0, y1+1)) AS y FROM t0)),
p AS (SELECT z, x, y, i, j, degrees(atan(sinh(3.141592653589793e0*(1 - 2*(y + (i+0.5e0)/4)/{_n})))) AS lat, (x + (j+0.5e0)/4)/{_n}*360e0 - 180e0 AS lon FROM t, range(4) a(i), range(4) b(j)), {_height_sql('p')},
k AS (SELECT z, x, y, i*4+j AS at_, least(16777215, greatest(0, floor((coalesce(height, 0e0)+10000e0)*10e0+0.5e0)::INT)) AS code FROM h)
SELECT z, x, ({_n})::BIGINT - 1 - y AS tms_y, string_agg(lpad(lower(hex(code)), 6, '0'), '' ORDER BY at_) AS pixels FROM k GROUP BY z, x, y"""

QUERIES = {
    "dem_heights": (_heights, f"WITH {TILES}, s AS (SELECT c_custkey AS site, {_lat0.format('c_custkey*31 % 600')} + (c_custkey*7919 % 10007)/10007e0 AS lat, {_lon0.format('c_custkey*31 % 600')} + (c_custkey*104729 % 10009)/10009e0 AS lon FROM customer), {_height_sql('s')} SELECT site, {rnd('height', 3)} AS height FROM h"),
    "dem_windows": (_windows, WINDOWS_SQL),
}
