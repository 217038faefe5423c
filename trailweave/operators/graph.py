"""Graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import once


def label_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) of undirected edges (a, b); nodes without an edge are left out.

    Labels take the least of their neighbours' and then their label's own label, until none changes;
    each round's labels are cut off from their lineage by a checkpoint.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = once(both)
    labels = once(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")))
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = labels.join(seen, "a").select("a", "c", F.least("c", "m").alias("m"))
        jumped = low.join(labels.select(F.col("a").alias("m"), F.col("c").alias("j")), "m", "left").select("a", "c", F.least("m", F.coalesce("j", "m")).alias("m"))
        jumped = once(jumped)
        changed = not jumped.where("m <> c").isEmpty()
        labels = jumped.select("a", F.col("m").alias("c"))
        if not changed:
            break
    return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
