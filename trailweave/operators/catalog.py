"""The route catalog: upsert, carry-over, facets, ranking, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and rows of ``old`` whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def carry_over(new: DataFrame, old: DataFrame, key: str, column: str) -> DataFrame:
    """``new`` with its nulls in ``column`` filled from ``old`` by key."""
    known = old.select(key, F.col(column).alias("_old"))
    return new.join(known, key, "left").withColumn(column, F.coalesce(column, "_old")).drop("_old")


def first_wins(rows: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_ranked(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def facet(region: Column, tags: Column, regions: list[str], terrains: list[str]) -> Column:
    """Whether a route is in one of the regions and has one of the terrains; an empty choice asks for nothing."""
    one = region.isin(regions) if regions else F.lit(True)
    two = F.arrays_overlap(tags, F.array(*(F.lit(t) for t in terrains))) if terrains else F.lit(True)
    return one & two


def terrain_tags(top: Column, gain: Column, km: Column, coastal: Column, forest: Column) -> Column:
    """All terrains that hold, in a fixed order."""
    per_km = F.when(km > 0, gain / km).otherwise(F.lit(0.0))
    seaside = (top < 200) & coastal
    hilly = ((top >= 300) & (top < 1000)) | ((top < 1000) & (per_km >= 25))
    tags = [("coastal", seaside), ("mountain", top >= 1000), ("forest", forest >= 0.4), ("hills", hilly), ("plains", (top < 300) & (per_km < 25) & ~seaside)]
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in tags)))


def department(code: Column) -> Column:
    """The department of a commune code: 2A and 2B, three characters overseas, else two; empty without a code."""
    two = F.substring(code, 1, 2)
    return F.when(code.isNull() | (code == ""), F.lit("")).when(two == "97", F.substring(code, 1, 3)).otherwise(two)


# The regions of departments, and the departments by the sea.
REGIONS = {
    "Auvergne-Rhône-Alpes": "01 03 07 15 26 38 42 43 63 69 73 74",
    "Bourgogne-Franche-Comté": "21 25 39 58 70 71 89 90",
    "Bretagne": "22 29 35 56",
    "Centre-Val de Loire": "18 28 36 37 41 45",
    "Corse": "2A 2B",
    "Grand Est": "08 10 51 52 54 55 57 67 68 88",
    "Hauts-de-France": "02 59 60 62 80",
    "Île-de-France": "75 77 78 91 92 93 94 95",
    "Normandie": "14 27 50 61 76",
    "Nouvelle-Aquitaine": "16 17 19 23 24 33 40 47 64 79 86 87",
    "Occitanie": "09 11 12 30 31 32 34 46 48 65 66 81 82",
    "Pays de la Loire": "44 49 53 72 85",
    "Provence-Alpes-Côte d'Azur": "04 05 06 13 83 84",
}
COASTAL = "06 11 13 14 17 22 29 2A 2B 30 33 34 35 40 44 50 56 59 62 64 66 76 80 83 85".split()


def region(department: Column) -> Column:
    """The region of a department; empty if there is none."""
    told = F.create_map(*(F.lit(x) for name, codes in REGIONS.items() for code in codes.split() for x in (code, name)))
    return F.coalesce(F.element_at(told, department), F.lit(""))


def coastal(department: Column) -> Column:
    return F.coalesce(department.isin(COASTAL), F.lit(False))


def communes(records: DataFrame) -> DataFrame:
    """code, commune of records (ord, libellecourt, codeinsee) that have both, trimmed; the last of a code wins."""
    some = records.where("libellecourt <> '' and codeinsee <> ''").select("ord", F.trim("libellecourt").alias("code"), F.trim("codeinsee").alias("commune"))
    return some.groupBy("code").agg(F.max_by("commune", "ord").alias("commune"))


def placed_stations(stations: DataFrame, records: DataFrame) -> DataFrame:
    """``stations`` (code, any others) with department, region and coastal, by the commune of their code; empty without one."""
    met = stations.join(communes(records), "code", "left").withColumn("department", department(F.col("commune")))
    return met.select(*stations.columns, "department", region(F.col("department")).alias("region"), coastal(F.col("department")).alias("coastal"))


def by_slug(routes: DataFrame, slugs: DataFrame) -> DataFrame:
    """The first route (ord, slug, any others) of each asked slug; those that no route has give none."""
    return first_wins(routes.join(slugs.select("slug").distinct(), "slug", "left_semi"), ["slug"], "ord")


def of_kind(pois: Column, kind: str) -> Column:
    """The places of one kind in a route's list."""
    return F.filter(pois, lambda p: p["poi_type"] == kind)


def any_filter(regions: list[str], terrains: list[str]) -> bool:
    return bool(regions or terrains)


def world_layers(style: Column, source: str) -> Column:
    """array of the layers of a style (VARIANT) that are backgrounds or draw from ``source``, as maps without maxzoom."""
    layers = F.coalesce(F.variant_get(style, "$.layers", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(layers, lambda x: F.coalesce((F.try_variant_get(x, "$.type", "string") == "background") | (F.try_variant_get(x, "$.source", "string") == source), F.lit(False)))
    return F.transform(kept, lambda x: F.map_filter(F.variant_get(x, "$", "map<string, variant>"), lambda k, _: k != "maxzoom"))


def world_sources(style: Column, source: str) -> Column:
    """The sources of a style (VARIANT), of which only ``source`` stays, as a map."""
    return F.map_filter(F.coalesce(F.variant_get(style, "$.sources", "map<string, variant>"), F.create_map().cast("map<string, variant>")), lambda k, _: k == source)


def client_texts(own: Column, default: Column, keys: list[str]) -> Column:
    """map of ``keys`` to a dictionary's texts; what it lacks is taken from the default's, else the key itself is told."""
    wanted = F.array(*(F.lit(k) for k in keys))
    return F.map_from_arrays(wanted, F.transform(wanted, lambda k: F.coalesce(F.element_at(own, k), F.element_at(default, k), k)))


def config_value(text: Column, name: str) -> Column:
    """What a line ``name := value`` of a text sets, trimmed, the first of them; a text without one stops the job."""
    found = F.regexp_extract(text, rf"(?m)^\Q{name}\E\s*:=\s*(.+?)\s*$", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.lit(f"cannot find {name}")))


def point_update(lines: DataFrame, ref: str, key: str, text: str) -> DataFrame:
    """n, line of a document (n, line) of entries that begin with ``- ref:``, in which the first entry of ``ref`` says ``key: text``; all other lines stay.

    The entry's own line of that key is replaced, with the deeper lines behind it; without one a line is added behind the reference.
    """
    w = Window.orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("line").rlike(r"^\s*- ref:")
    ours = F.regexp_extract("line", r"^\s*- ref:\s*[\"']?(.*?)[\"']?\s*$", 1) == ref
    t = lines.withColumn("_e", F.sum(F.when(begins, 1).otherwise(0)).over(so_far))
    first = F.min(F.when(begins & ours, F.col("_e"))).over(Window.partitionBy())
    t = t.withColumn("_in", F.coalesce(F.col("_e") == first, F.lit(False)))
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    is_key = F.col("_in") & F.regexp_extract("line", rf"^\s*(?:- )?(\w+):", 1).eqNullSafe(key)
    t = t.withColumn("_key", is_key).withColumn("_at", F.last(F.when(F.col("line").rlike(r"^\s*(?:- )?\w+:") | begins, F.struct(is_key.alias("k"), indent.alias("i"))), ignorenulls=True).over(so_far))
    under = F.col("_in") & F.coalesce(F.col("_at.k"), F.lit(False)) & ~F.col("_key")
    has = F.coalesce(F.max("_key").over(Window.partitionBy("_in")), F.lit(False))
    quoted = '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    said = F.concat(F.regexp_extract("line", r"^(\s*(?:- )?)", 1), F.lit(f"{key}: {quoted}"))
    added = F.concat(F.regexp_replace(F.regexp_extract("line", r"^(\s*- )", 1), "-", " "), F.lit(f"{key}: {quoted}"))
    t = t.withColumn("_has", has).where(~under)
    out = F.when(F.col("_key"), F.array(said)).when(F.col("_in") & begins & ~F.col("_has"), F.array(F.col("line"), added)).otherwise(F.array("line"))
    return t.select("n", F.posexplode(out).alias("_i", "line")).select(F.struct("n", "_i").alias("n"), "line")
