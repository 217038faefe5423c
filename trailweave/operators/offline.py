"""Files that lines need without a network: what is missing, what a removal frees, what nothing needs any more.

Files are rows (path, size); a line needs the base files and those of its squares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def needed_files(cover: DataFrame, files: DataFrame) -> DataFrame:
    """route, path, size of the files (col, row, path, size) of the squares (route, col, row) of every line, each once a line."""
    return cover.select("route", "col", "row").distinct().join(files.select("col", "row", "path", "size"), ["col", "row"]).select("route", "path", "size")


def to_download(routes: DataFrame, needed: DataFrame, base: list[tuple[str, int]], present: DataFrame) -> DataFrame:
    """route, files, bytes that are still to be fetched for every line.

    A file of another size than the present one (path, size) is fetched again; a line that lacks
    nothing has zeros. Present files that are told twice count once.
    """
    shared = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(n).cast("long").alias("size")) for p, n in base))).alias("f")
    every = needed.unionByName(routes.select("route").distinct().select("route", shared).select("route", "f.path", "f.size"))
    have = present.select("path", "size").distinct().withColumn("here", F.lit(1))
    lacks = every.join(have, ["path", "size"], "left").withColumn("lacks", F.col("here").isNull())
    return lacks.groupBy("route").agg(F.count_if("lacks").alias("files"), F.sum(F.when(F.col("lacks"), F.col("size")).otherwise(F.lit(0))).alias("bytes"))


def freed_by_removal(needed: DataFrame) -> DataFrame:
    """route, files, bytes of the squares' files that no other line of ``needed`` needs; lines without one have zeros."""
    users = needed.groupBy("path").agg(F.count(F.lit(1)).alias("users"))
    own = needed.join(users, "path").withColumn("own", F.col("users") == 1)
    return own.groupBy("route").agg(F.count_if("own").alias("files"), F.sum(F.when(F.col("own"), F.col("size")).otherwise(F.lit(0))).alias("bytes"))


def unreferenced(present: DataFrame, needed: DataFrame, base: list[tuple[str, int]]) -> DataFrame:
    """path, size of present files that no remaining line needs; base files go only when no line remains."""
    some = needed.limit(1).select(F.explode(F.array(*(F.lit(p) for p, _ in base))).alias("path"))
    return present.select("path", "size").distinct().join(needed.select("path").unionByName(some), "path", "left_anti")
