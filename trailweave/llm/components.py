"""Connected components of a graph given as edges.

Tasks first replace the edges they hold by stars, each node pointing at the least of its part of the
graph; alternating large-star and small-star steps then join what several tasks hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Edges that one task replaces by stars: some 100 bytes of memory each.
EDGES_A_TASK = 500_000


def _sum(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component, and that least."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        fresh = label.copy()
        np.minimum.at(fresh, label[x], low)
        np.minimum.at(fresh, label[y], low)
        while True:  # follow the pointers to their ends
            further = fresh[fresh]
            if (further == fresh).all():
                break
            fresh = further
        if (fresh == label).all():
            break
        label = fresh
    on = label != np.arange(len(names))
    return names[on], names[label[on]]


def _in_task(batches):
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        a, b = stars(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """node, component for every node of the edges (a, b), component being the least node that it reaches.

    Each step rewires a node's neighbours to the least of them; the number of steps grows with the
    logarithm of the longest path. Nodes without an edge do not appear. Hubs meet in joins and
    grouped minima only, never gathered in one task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = -(-now.count() // edges_a_task)
    now = cut(now.coalesce(max(1, tasks)).mapInArrow(lean(_in_task), "a long, b long"))
    told = _sum(now) if tasks > 1 else None
    while tasks > 1:  # what one task held is whole
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct())
        before, told = told, _sum(now)
        if told == before:
            break
    told_all = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return told_all.unionByName(told_all.select(F.col("component").alias("node"), "component").distinct())
