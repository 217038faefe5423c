"""Lines as vertex tables (route, seq, lon, lat, elev): lengths, profiles, samples, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.geo import degree_distance, haversine_m


def _by_route():
    return Window.partitionBy("route").orderBy("seq")


def _so_far():
    return _by_route().rowsBetween(Window.unboundedPreceding, 0)


def with_steps(vertices: DataFrame) -> DataFrame:
    """step_m and step_deg from the vertex before (0 at the first), d_elev, and the running dist_km."""
    lag = lambda c: F.lag(c).over(_by_route())
    stepped = vertices.withColumn("step_m", F.coalesce(haversine_m(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))
    stepped = stepped.withColumn("step_deg", F.coalesce(degree_distance(lag("lon"), lag("lat"), F.col("lon"), F.col("lat")), F.lit(0.0)))
    stepped = stepped.withColumn("d_elev", F.coalesce(F.col("elev") - lag("elev"), F.lit(0.0)))
    return stepped.withColumn("dist_km", F.sum("step_m").over(_so_far()) / 1000.0)


def length_km(vertices: DataFrame) -> DataFrame:
    return with_steps(vertices).groupBy("route").agg((F.sum("step_m") / 1000.0).alias("length_km"), F.sum("step_deg").alias("length_deg"), F.count(F.lit(1)).alias("n_vertices"))


def bounds(vertices: DataFrame, key: str = "route") -> DataFrame:
    return vertices.groupBy(key).agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def circular(vertices: DataFrame) -> DataFrame:
    """Whether a line's ends lie within the gap in degrees, and within 1 km."""
    ends = vertices.groupBy("route").agg(F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"))
    gap = degree_distance(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    metres = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return ends.select("route", (gap < CONFIG.gap_deg).alias("is_circular"), (metres <= 1000.0).alias("is_loop"))


def minutes_of_step() -> Column:
    """Walking minutes of a step from step_m and d_elev: by climb or descent where it is steep, else by distance."""
    steep = F.when(F.col("step_m") > 0, F.abs("d_elev") / F.col("step_m")).otherwise(F.lit(0.0)) >= CONFIG.steep_percent / 100
    hours = (
        F.when(steep & (F.col("d_elev") > 0), F.col("d_elev") / CONFIG.climb_m_per_h)
        .when(steep & (F.col("d_elev") < 0), -F.col("d_elev") / CONFIG.descend_m_per_h)
        .otherwise(F.col("step_m") / 1000.0 / CONFIG.walk_kmh)
    )
    return hours * 60.0


def with_time(vertices: DataFrame) -> DataFrame:
    """The steps with the running walking time in minutes."""
    return with_steps(vertices).withColumn("step_min", minutes_of_step()).withColumn("time_min", F.sum("step_min").over(_so_far()))


def gain_loss(elevations: Column) -> Column:
    """struct(gain, loss) of an ordered array: swings under the threshold are noise.

    The pending swing grows until its sum changes sign; it then counts if it is large enough, and the
    step that turned it begins the next.
    """
    least = CONFIG.gain_threshold_m
    deltas = F.zip_with(F.slice(elevations, F.lit(2), F.greatest(F.size(elevations) - 1, F.lit(0))), F.slice(elevations, F.lit(1), F.greatest(F.size(elevations) - 1, F.lit(0))), lambda b, a: b - a)
    zero = F.lit(0.0)
    state = lambda g, l, p: F.struct(g.alias("gain"), l.alias("loss"), p.alias("pending"))  # noqa: E731, E741
    counted = lambda v: F.when(v >= least, v).otherwise(zero)

    def merge(s, d):
        p = s["pending"]
        down, up = (p >= 0) & (p + d < 0), (p <= 0) & (p + d > 0)
        return state(s["gain"] + F.when(down, counted(p)).otherwise(zero), s["loss"] + F.when(up, counted(-p)).otherwise(zero), F.when(down | up, d).otherwise(p + d))

    def finish(s):
        p = s["pending"]
        return F.struct((s["gain"] + counted(p)).alias("gain"), (s["loss"] + counted(-p)).alias("loss"))

    return F.aggregate(deltas, state(zero, zero, zero), merge, finish)


def difficulty(gain: Column, km: Column) -> Column:
    per_km = gain / km
    return (
        F.when(km <= 0, "easy").when((gain < 500) & (per_km < 30), "easy").when((gain < 1000) & (per_km < 50), "moderate")
        .when((gain < 1500) & (per_km < 70), "difficult").otherwise("very_difficult")
    )


def elevation_summary(vertices: DataFrame) -> DataFrame:
    """One row per route: length, gain and loss, extremes, walking time, difficulty."""
    timed = with_time(vertices)
    each = timed.groupBy("route").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "elev"))), lambda x: x["elev"]).alias("elevs"),
        F.max("dist_km").alias("km"), F.max("time_min").alias("minutes"), F.max("elev").alias("top"), F.min("elev").alias("bottom"),
    )
    g = each.withColumn("g", gain_loss(F.col("elevs")))
    return g.select("route", "km", "minutes", "top", "bottom", F.col("g.gain").alias("gain"), F.col("g.loss").alias("loss"))


def resample(vertices: DataFrame, step_m: float) -> DataFrame:
    """Samples every ``step_m`` along each line: k, dist_m, lon, lat, elev, and the end if it is over 1 m past the last.

    A sample on a vertex belongs to the segment that ends there.
    """
    end = with_steps(vertices).withColumn("to_m", F.col("dist_km") * 1000.0)
    lag = lambda c: F.lag(c).over(_by_route())
    seg = end.select("route", "seq", "lon", "lat", "elev", "to_m", *(lag(c).alias(f"{c}0") for c in ("lon", "lat", "elev", "to_m")))
    first = F.when(F.col("seq") == 2, F.lit(0)).otherwise(F.floor(F.col("to_m0") / step_m) + 1)
    last = F.floor(F.col("to_m") / step_m)
    ks = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    some = seg.where("to_m0 is not null").withColumn("k", F.explode(ks))
    t = F.when(F.col("to_m") > F.col("to_m0"), (F.col("k") * step_m - F.col("to_m0")) / (F.col("to_m") - F.col("to_m0"))).otherwise(F.lit(0.0))
    on = some.withColumn("t", t).select("route", "k", (F.col("k") * F.lit(step_m)).alias("dist_m"), *((F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * F.col("t")).alias(c) for c in ("lon", "lat", "elev")))
    tail = end.groupBy("route").agg(F.max_by(F.struct("to_m", "lon", "lat", "elev"), "seq").alias("e"))
    tail = tail.where(F.col("e.to_m") - F.floor(F.col("e.to_m") / step_m) * step_m > 1.0)
    tail = tail.select("route", (F.floor(F.col("e.to_m") / step_m) + 1).alias("k"), F.col("e.to_m").alias("dist_m"), "e.lon", "e.lat", "e.elev")
    return on.unionByName(tail)


def sample_shares(vertices: DataFrame, step_m: float) -> DataFrame:
    """Samples every ``step_m`` along lines of parts (route, part, seq, lon, lat): k, share of the whole length, lon, lat.

    The gap between two parts has no length and no sample. The end, share 1, is the last sample unless one lies
    there; a line without a length has none.
    """
    lag = lambda c: F.lag(c).over(_by_route())
    step = F.when(F.col("part") == lag("part"), haversine_m(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))).otherwise(F.lit(0.0))
    run = vertices.withColumn("step", step).withColumn("b", F.sum("step").over(_so_far()))
    ends = run.groupBy("route").agg(F.max("b").alias("total"), F.max_by(F.struct("lon", "lat"), "seq").alias("e")).where("total > 0")
    piece = run.select("route", "b", "lon", "lat", *(lag(c).alias(f"{c}0") for c in ("b", "lon", "lat"))).where("b > b0")
    first = F.when(F.col("b0") == 0, F.lit(0)).otherwise(F.floor(F.col("b0") / step_m) + 1).cast("long")
    last = F.floor(F.col("b") / step_m).cast("long")
    on = piece.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).join(ends.select("route", "total"), "route")
    t = (F.col("k") * step_m - F.col("b0")) / (F.col("b") - F.col("b0"))
    on = on.select("route", "k", (F.col("k") * step_m / F.col("total")).alias("share"), *((F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * t).alias(c) for c in ("lon", "lat")))
    count = F.floor(F.col("total") / step_m)
    tail = ends.where(count * step_m / F.col("total") < 1.0 - 1e-9).select("route", (count + 1).cast("long").alias("k"), F.lit(1.0).alias("share"), "e.lon", "e.lat")
    return on.unionByName(tail)


def as_of(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (route, target_km) the seq of the last sample at or before it, from 1 to one less than the last.

    One sorted pass per route over both sides; neither is joined to the other.
    """
    both = samples.select("route", F.col("dist_km").alias("at"), "seq", F.lit(None).cast("double").alias("target_km")).unionByName(
        targets.select("route", F.col("target_km").alias("at"), F.lit(None).cast("long").alias("seq"), "target_km")
    )
    w = Window.partitionBy("route").orderBy(F.col("at"), F.col("target_km").isNotNull(), F.col("seq").asc_nulls_last())
    whole = Window.partitionBy("route")
    found = both.withColumn("found", F.last("seq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.max("seq").over(whole))
    return found.where("target_km is not null and n is not null").select("route", "target_km", F.greatest(F.lit(1), F.least(F.coalesce("found", F.lit(1)), F.col("n") - 1)).alias("seq"))


def section(vertices: DataFrame, from_km: float, to_km: float) -> DataFrame:
    """Sums between two distances of every route: plain gain and loss without a threshold, time, vertices."""
    timed = with_time(vertices)
    ends = timed.select("route").distinct().select("route", F.explode(F.array(F.lit(from_km), F.lit(to_km))).alias("target_km"))
    found = as_of(timed, ends).groupBy("route").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    part = timed.join(found, "route").where("seq between a and b + 1")
    moved = F.when(F.col("seq") > F.col("a"), F.col("d_elev")).otherwise(F.lit(0.0))
    return part.groupBy("route").agg(
        F.sum(F.greatest(moved, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-moved, F.lit(0.0))).alias("loss"),
        (F.max("time_min") - F.min("time_min")).alias("minutes"), F.count(F.lit(1)).alias("n"), F.min("dist_km").alias("from_km"), F.max("dist_km").alias("to_km"),
    )


def drop_spurious(parts: DataFrame) -> DataFrame:
    """Parts (route, part, km) without those both under a length and under a share of the longest; the longest stays."""
    w = Window.partitionBy("route")
    top = F.max("km").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("km"), "part"))
    marked = parts.withColumn("keep", (F.col("km") >= CONFIG.spurious_km) | (F.col("km") >= CONFIG.spurious_share * top) | (rank == 1))
    return marked.where("keep").drop("keep")
