"""Readers with explicit schemas for catalogs, features, feeds, elevation tiles and captured answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = "generated_at string, source string, license string, routes array<struct<id: string, slug: string, path_ref: string, path_name: string, region: string, departement: string, distance_km: double, difficulty: string, terrain: array<string>, bbox: array<double>, image_path: string, pois: array<struct<name: string, poi_type: string, lat: double, lon: double, url: string, distance_km: double>>>>"
FEATURES = "type string, features array<struct<type: string, properties: struct<stop_id: string, resource_id: string>, geometry: struct<type: string, coordinates: array<double>>>>"
ELEMENTS = "elements array<struct<type: string, id: bigint, tags: map<string, string>, lat: double, lon: double, center: struct<lat: double, lon: double>, geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, ref: bigint, geometry: array<struct<lat: double, lon: double>>>>>>"
VOID = -32768


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per route of a catalog file; what it lacks is null."""
    return spark.read.schema(CATALOG).json(path, multiLine=True).select(F.inline("routes"))


def feed_stops(spark: SparkSession, path: str) -> DataFrame:
    """Points with a stop and a whole-number resource of a feature collection: lat, lon, stop_id, resource_id; the first of a stop stays."""
    f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("n", "f"))
    some = f.where("f.geometry.type = 'Point' and size(f.geometry.coordinates) >= 2 and f.properties.stop_id <> ''")
    rows = some.select("n", F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("lat"), F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("lon"), "f.properties.stop_id", F.expr("try_cast(f.properties.resource_id as int)").alias("resource_id"))
    first = F.row_number().over(Window.partitionBy("stop_id").orderBy("n"))
    return rows.where("resource_id is not null").withColumn("_n", first).where("_n = 1").drop("_n", "n")


def elements(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Map elements of captured answers, of one type if asked; ways with neither a centre nor two points are left out."""
    e = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.inline("elements"))
    e = e.where("type <> 'way' or center is not null or size(geometry) >= 2")
    return e.where(F.col("type") == kind) if kind else e


def feed_table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A member of a timetable feed; a mark before its header is not part of the first name."""
    t = spark.read.csv(path, header=True, encoding="UTF-8")
    t = t.toDF(*(c.lstrip("﻿").strip() for c in t.columns))
    return t.select(*(F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in columns.split()))


def seeds(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Catalog seeds with a relation, sorted by reference as text; name and description default to empty."""
    t = spark.createDataFrame([(r.get("ref"), r.get("name"), r.get("description"), r.get("relation_id")) for r in rows], "ref string, name string, description string, relation_id bigint")
    return t.where("relation_id is not null").na.fill("", ["name", "description"]).orderBy("ref")


def elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """tile, row, samples (array of one row, null where void) of raw big-endian tiles; files of other sizes are left out."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.hgt$", 1).alias("tile"), "length", "content")
    side = F.sqrt(F.col("length") / 2).cast("int")
    rows = files.withColumn("side", side).where("tile <> '' and side * side * 2 = length").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    part = F.substring("content", F.col("row") * F.col("side") * 2 + 1, F.col("side") * 2)

    def decode(raw: pa.Array) -> pa.Array:
        import numpy as np

        parts = [np.frombuffer(x.as_buffer(), ">i2") for x in raw]
        values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, mask=values == VOID))

    return rows.select("tile", "row", F.arrow_udf(decode, "array<int>")(part).alias("samples"))


def fresh(answers: DataFrame, days: int, now) -> DataFrame:
    """Captured answers no older than ``days`` at ``now``; of one key the newest."""
    w = Window.partitionBy("key").orderBy(F.desc("fetched_at"))
    young = answers.where(F.col("fetched_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return young.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
