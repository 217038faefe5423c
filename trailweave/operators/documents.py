"""Documents of routes: tracks, feature collections, profiles, catalogs, as one text for each route.

Numbers are written from scaled whole numbers, halves to the even neighbour. A text is put together once
from its parts in order; vertices number as they come, over all parts of a route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import rounded_even

# The head of a track document and its name space.
XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
TRACKS = "http://www.topografix.com/GPX/1/1"
CREATOR = "trailweave"


def fixed(value: Column, digits: int) -> Column:
    """A number with exactly ``digits`` decimals."""
    n = F.rint(F.abs(value) * float(10**digits)).cast("bigint")
    whole = F.floor(n / 10**digits).cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0")) if digits else whole
    return F.concat(F.when((value < 0) & (n > 0), "-").otherwise(""), text)


def escaped(text: Column) -> Column:
    """Text between tags."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quoted(text: Column) -> Column:
    """A JSON string, with what is not ASCII left as it is."""
    json = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.regexp_extract(json, r"(?s)^\{\"x\":(.*)\}$", 1))


def _joined(rows: DataFrame, key: list[str], order: list[str], text: Column, name: str, between: str = "") -> DataFrame:
    each = rows.select(*key, F.struct(*order, text.alias("_t")).alias("_s")).groupBy(*key).agg(F.sort_array(F.collect_list("_s")).alias("_a"))
    return each.select(*key, F.array_join(F.transform("_a", lambda x: x["_t"]), between).alias(name))


def with_elevation(trail: DataFrame, elevations: DataFrame) -> DataFrame:
    """``trail`` (route, part, seq, lon, lat) with ele: the elevation whose index (route, i, ele) counts the vertices of all parts; null beyond the last."""
    i = F.row_number().over(Window.partitionBy("route").orderBy("part", "seq")) - 1
    return trail.withColumn("i", i.cast("long")).join(elevations.select("route", F.col("i").cast("long").alias("i"), "ele"), ["route", "i"], "left").drop("i")


def track_documents(routes: DataFrame, trail: DataFrame, stations: DataFrame) -> DataFrame:
    """route, gpx of ``routes`` (route, name, description): a waypoint for each train station (route, ord, name, lat, lon, poi_type), one track, a segment for each part of ``trail`` (route, part, seq, lon, lat, ele); null elevations are left out."""
    place = lambda tag, inner: F.concat(F.lit(f'<{tag} lat="'), fixed(F.col("lat"), 6), F.lit('" lon="'), fixed(F.col("lon"), 6), F.lit('">'), inner, F.lit(f"</{tag}>"))
    ele = F.coalesce(F.concat(F.lit("<ele>"), fixed(F.col("ele"), 1), F.lit("</ele>")), F.lit(""))
    parts = _joined(trail, ["route", "part"], ["seq"], place("trkpt", ele), "_points")
    whole = _joined(parts, ["route"], ["part"], F.concat(F.lit("<trkseg>"), "_points", F.lit("</trkseg>")), "_track")
    named = F.concat(F.lit("<name>"), escaped(F.col("name")), F.lit("</name>"))
    points = _joined(stations.where("poi_type = 'train_station'"), ["route"], ["ord"], place("wpt", named), "_wpts")
    met = routes.join(whole, "route", "left").join(points, "route", "left")
    head = F.concat(F.lit(f'{XML}<gpx version="1.1" creator="{CREATOR}" xmlns="{TRACKS}"><metadata>'), named, F.lit("<desc>"), escaped(F.coalesce("description", F.lit(""))), F.lit("</desc></metadata>"))
    return met.select("route", F.concat(head, F.coalesce("_wpts", F.lit("")), F.lit("<trk>"), named, F.coalesce("_track", F.lit("")), F.lit("</trk></gpx>")).alias("gpx"))


def section_documents(sections: DataFrame) -> DataFrame:
    """section, gpx of vertices (section, title, seq, lon, lat, ele) of a stretch between two stations: one unnamed segment, six and one decimals."""
    ele = F.coalesce(F.concat(F.lit("<ele>"), fixed(F.col("ele"), 1), F.lit("</ele>")), F.lit(""))
    point = F.concat(F.lit('      <trkpt lat="'), fixed(F.col("lat"), 6), F.lit('" lon="'), fixed(F.col("lon"), 6), F.lit('">'), ele, F.lit("</trkpt>\n"))
    each = _joined(sections, ["section", "title"], ["seq"], point, "_points")
    head = F.concat(F.lit(f'{XML}<gpx version="1.1" creator="{CREATOR}" xmlns="{TRACKS}">\n  <trk>\n    <name>'), escaped(F.col("title")), F.lit("</name>\n    <trkseg>\n"))
    return each.select("section", F.concat(head, "_points", F.lit("    </trkseg>\n  </trk>\n</gpx>")).alias("gpx"))


def feature_documents(routes: DataFrame, trail: DataFrame, pois: DataFrame, digits: int = 6) -> DataFrame:
    """route, geojson of ``routes`` (route, name): the trail first, a line or one of several parts, then ``pois`` (route, ord, name, lat, lon, poi_type, url); a null url is left out."""
    pair = F.concat(F.lit("["), fixed(F.col("lon"), digits), F.lit(", "), fixed(F.col("lat"), digits), F.lit("]"))
    parts = _joined(trail, ["route", "part"], ["seq"], pair, "_points", ", ")
    lines = parts.groupBy("route").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("part", F.concat(F.lit("["), "_points", F.lit("]")).alias("t")))).alias("_a"))
    whole = F.array_join(F.transform("_a", lambda x: x["t"]), ", ")
    geometry = F.when(F.col("_n") == 1, F.concat(F.lit('{"type": "LineString", "coordinates": '), whole, F.lit("}"))).otherwise(F.concat(F.lit('{"type": "MultiLineString", "coordinates": ['), whole, F.lit("]}")))
    url = F.coalesce(F.concat(F.lit(', "url": '), quoted(F.col("url"))), F.lit(""))
    feature = F.concat(F.lit(', {"type": "Feature", "properties": {"feature_type": "poi", "poi_type": '), quoted(F.col("poi_type")), F.lit(', "name": '), quoted(F.col("name")), url, F.lit('}, "geometry": {"type": "Point", "coordinates": '), pair, F.lit("}}"))
    points = _joined(pois, ["route"], ["ord"], feature, "_pois")
    met = routes.join(lines.select("route", geometry.alias("_g")), "route").join(points, "route", "left")
    head = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": '), quoted(F.col("route").cast("string")), F.lit(', "name": '), quoted(F.col("name")), F.lit(', "feature_type": "trail"}, "geometry": '), "_g", F.lit("}"))
    return met.select("route", F.concat(head, F.coalesce("_pois", F.lit("")), F.lit("]}")).alias("geojson"))


def joined_profiles(steps: DataFrame) -> DataFrame:
    """Profiles of steps (hike, step, seq, dist_km, elev_m, time_min) as one of each hike: hike, step, seq with dist_km, time_min moved by all steps before, from_km.

    A step moves the next ones by its last distance and time; steps without a sample are not there.
    """
    last = steps.groupBy("hike", "step").agg(F.max_by(F.struct("dist_km", "time_min"), "seq").alias("e"))
    w = Window.partitionBy("hike").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    moved = last.select("hike", "step", *(F.coalesce(F.sum(f"e.{c}").over(w), F.lit(0.0)).alias(n) for c, n in (("dist_km", "from_km"), ("time_min", "from_min"))))
    met = steps.join(moved, ["hike", "step"])
    return met.select("hike", "step", "seq", (F.col("dist_km") + F.col("from_km")).alias("dist_km"), "elev_m", (F.col("time_min") + F.col("from_min")).alias("time_min"), "from_km")


def _numbers(rows: DataFrame, key: str, order: list[str], columns: dict) -> DataFrame:
    each = rows.select(key, F.struct(*order, *(fixed(F.col(c), d).alias(c) for c, d in columns.items())).alias("_s")).groupBy(key).agg(F.sort_array(F.collect_list("_s")).alias("_a"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform("_a", lambda x: x[c]), ", "), F.lit("]")).alias(c)
    return each.select(key, *map(listed, columns))


def profile_documents(steps: DataFrame) -> DataFrame:
    """hike, json of the joined profiles: distances, elevations and times to 3, 1 and 1 decimals, and where each step begins that is not the hike's step 0."""
    one = joined_profiles(steps)
    arrays = _numbers(one, "hike", ["step", "seq"], {"dist_km": 3, "elev_m": 1, "time_min": 1})
    begins = one.where("step > 0").groupBy("hike", "step").agg(F.first("from_km").alias("from_km"))
    bounds = _numbers(begins, "hike", ["step"], {"from_km": 3})
    text = F.concat(F.lit('{"distances_km": '), "dist_km", F.lit(', "elevations_m": '), "elev_m", F.lit(', "times_min": '), "time_min", F.lit(', "step_boundaries_km": '), F.coalesce("from_km", F.lit("[]")), F.lit(', "station_positions_km": []}'))
    return arrays.join(bounds, "hike", "left").select("hike", text.alias("json"))


def elevation_documents(profiles: DataFrame, stations: DataFrame) -> DataFrame:
    """route, json of profiles (route, seq, dist_km, elev_m, time_min) with the rounded positions of stations (route, km) in ascending order; a route without a sample has none."""
    arrays = _numbers(profiles, "route", ["seq"], {"dist_km": 3, "elev_m": 1, "time_min": 1})
    at = stations.groupBy("route").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(rounded_even(F.col("km"), 3))), lambda x: fixed(x, 3)), ", "), F.lit("]")).alias("_at"))
    text = F.concat(F.lit('{"distances_km": '), "dist_km", F.lit(', "elevations_m": '), "elev_m", F.lit(', "times_min": '), "time_min", F.lit(', "station_positions_km": '), F.coalesce("_at", F.lit("[]")), F.lit("}"))
    return arrays.join(at, "route", "left").select("route", text.alias("json"))
