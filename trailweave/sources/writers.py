"""Writers of catalogs, manifests and tile stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_routes(routes: DataFrame, path: str) -> None:
    """One JSON document per route, in files by region."""
    routes.write.mode("overwrite").partitionBy("region").json(path, ignoreNullFields=False)


def write_texts(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One line of text per row, in a folder by key: GPX tracks, feature collections, profiles."""
    rows.select(F.col(key).alias("key"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("key").text(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles (z, x, y, blob) with the row counted from the south, in folders by zoom."""
    flipped = tiles.withColumn("y", F.expr("shiftleft(1, z)") - 1 - F.col("y"))
    flipped.write.mode("overwrite").partitionBy("z").parquet(path)
