"""Distances and projections as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres, arctangent form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * CONFIG.earth_m) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def arc_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres, arcsine form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * CONFIG.earth_m) * F.asin(F.sqrt(a))


def degrees_to_m(degrees, lat) -> Column:
    """Degrees to metres with the mean of the scales along the meridian and the parallel."""
    return degrees * CONFIG.degree_m * (F.lit(1.0) + F.cos(F.radians(lat))) / 2


def flat_m(dlat, dlon) -> Column:
    """Equirectangular metres with fixed scales."""
    return F.sqrt(F.pow(dlat * CONFIG.degree_m, F.lit(2)) + F.pow(dlon * CONFIG.degree_lon_m, F.lit(2)))


def degree_distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def foot(px, py, x1, y1, x2, y2) -> Column:
    """Where between 0 and 1 the point is nearest to the segment; 0 on a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(F.lit(0.0))


def tile_name(lat, lon) -> Column:
    """Name of the one-degree elevation tile that holds a place."""
    la, lo = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    side = lambda v, plus, minus: F.when(v >= 0, F.lit(plus)).otherwise(F.lit(minus))
    return F.concat(side(la, "N", "S"), F.lpad(F.abs(la).cast("string"), 2, "0"), side(lo, "E", "W"), F.lpad(F.abs(lo).cast("string"), 3, "0"), F.lit(".hgt"))


def tile_samples(size) -> Column:
    """Samples on a side of an elevation tile of ``size`` bytes; null for any other size."""
    return F.when(size == 2 * 3601 * 3601, 3601).when(size == 2 * 1201 * 1201, 1201)


def mercator_tile(lat, lon, zoom: int) -> tuple[Column, Column, Column]:
    """x, y and flipped y of the web-mercator tile of a place."""
    n = F.lit(float(1 << zoom))
    x = F.floor((lon + 180.0) / 360.0 * n).cast("long")
    r = F.radians(lat)
    y = F.floor((F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.lit(3.141592653589793)) / 2.0 * n).cast("long")
    return x, y, F.lit((1 << zoom) - 1) - y


def rounded(value, digits: int) -> Column:
    """Half up on the scaled double, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def rounded_even(value, digits: int) -> Column:
    """To the nearest on the scaled double, halves to the even neighbour."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def bilinear(nw, ne, sw, se, fx, fy) -> Column:
    """Between four samples, fx eastward and fy southward from the north-west one; null next to a void."""
    void = (nw == -32768) | (ne == -32768) | (sw == -32768) | (se == -32768)
    value = (nw * (1 - fx) + ne * fx) * (1 - fy) + (sw * (1 - fx) + se * fx) * fy
    return F.when(~void, value)


def rgb_channels(metres) -> tuple[Column, Column, Column]:
    """Red, green and blue of an elevation at a tenth of a metre above -10000 m."""
    v = F.least(F.lit(16777215), F.greatest(F.lit(0), F.floor((metres + 10000.0) * 10.0 + 0.5).cast("int")))
    return F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)
