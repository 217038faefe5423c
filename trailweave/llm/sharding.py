"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts. All groups are packed: those of one size in bytes form a class, and
best fit puts as many of a class as have room into the tightest bin, which then stays the tightest,
so a class costs a step a bin and not a step a group. The driver holds a count for each distinct size;
sizes that differ add up, so there are at most sqrt(2 * bytes) of them. Within a class, groups take
the places in order of a rank that Spark works out in buckets of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 16
LEAST_UNIT = 64
#: Distinct sizes whose places are joined by broadcast, some 50 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 200_000


class RoomTree:
    """A balanced (AVL) tree of bins keyed by (room left, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(t):
        return t[3] if t else 0

    def _node(self, key, left, right):
        h = self._height
        if h(left) > h(right) + 1:
            if h(left[1]) < h(left[2]):
                k, a, b, _ = left
                left = self._raw(b[0], self._raw(k, a, b[1]), b[2])
            return self._raw(left[0], left[1], self._raw(key, left[2], right))
        if h(right) > h(left) + 1:
            if h(right[2]) < h(right[1]):
                k, a, b, _ = right
                right = self._raw(a[0], a[1], self._raw(k, a[2], b))
            return self._raw(right[0], self._raw(key, left, right[1]), right[2])
        return self._raw(key, left, right)

    def _raw(self, key, left, right):
        return (key, left, right, 1 + max(self._height(left), self._height(right)))

    def add(self, key):
        def put(t):
            if t is None:
                return self._raw(key, None, None)
            return self._node(t[0], put(t[1]), t[2]) if key < t[0] else self._node(t[0], t[1], put(t[2]))

        self.root = put(self.root)

    def take(self, key):
        def least(t):
            return least(t[1]) if t[1] else t[0]

        def out(t, key):
            if key < t[0]:
                return self._node(t[0], out(t[1], key), t[2])
            if key > t[0]:
                return self._node(t[0], t[1], out(t[2], key))
            if t[1] is None or t[2] is None:
                return t[1] or t[2]
            up = least(t[2])
            return self._node(up, t[1], out(t[2], up))

        self.root = out(self.root, key)

    def tightest(self, size):
        """The bin with the least room that is at least ``size``, or None."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> dict | None:
    """size -> [(bin, how many)] for (size, count) pairs; a bin opens only when none has room. None if ``bins`` don't do."""
    tree, placed, opened = RoomTree(), {}, 0
    for size, count in sorted(classes, reverse=True):
        runs = placed.setdefault(size, [])
        while count:
            found = tree.tightest(size)
            if found is None:
                if size > capacity or opened == bins:
                    return None
                found, opened = (capacity, opened), opened + 1
            else:
                tree.take(found)
            some = min(count, found[0] // size)  # after each it is tighter still, and the best fit again
            tree.add((found[0] - some * size, found[1]))
            runs.append((found[1], some))
            count -= some
    return placed


def pack(classes: list[tuple[int, int]], shards: int) -> dict:
    """size -> [(shard, how many)] by best fit decreasing, with a capacity that needs no more than ``shards`` bins.

    The capacity is an equal share plus the least power of two that does. A group above an equal
    share of what is left takes a shard alone, as no packing can do better.
    """
    left, placed, first = sorted(classes), {}, 0
    total = sum(s * c for s, c in left)
    while left and shards - first > 1 and left[-1][0] * (shards - first) > total and (len(left) > 1 or left[-1][1] > 1):
        size, count = left.pop()
        placed.setdefault(size, []).append((first, 1))
        first, total = first + 1, total - size
        if count > 1:
            left.append((size, count - 1))
    if not left:
        return placed
    low = max(-(-total // (shards - first)), left[-1][0])
    more = 0
    while (best := best_fit_decreasing(left, low + more, shards - first)) is None:
        more = max(1, 2 * more)
    for size, runs in best.items():
        placed.setdefault(size, []).extend((b + first, k) for b, k in runs)
    return placed


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, text_md5, shard, slot for every row of ``docs`` (doc_id, text).

    Size is the text's UTF-8 bytes plus 1. Rows with equal texts share a shard. Slots number a
    shard's rows from 0 without gaps. Reruns agree.

    Defined cases: a null text has size 1 and is a group apart from the empty text; rows equal in
    everything get slots in any order among themselves; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.col("text")
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("text_md5"),
        )
    )
    spark = rows.sparkSession
    n = rows.count()
    unit = max(LEAST_UNIT, int(n**0.5))
    groups = cut(rows.groupBy("text_md5").agg(F.sum("size").alias("bytes")))
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most sqrt(2 * bytes) rows
    counts = dict(zip(classes.column("bytes").to_pylist(), classes.column("n").to_pylist()))
    packed = pack(list(counts.items()), shards)
    sizes = list(packed)
    told = {
        "bytes": pa.array(sizes, pa.int64()),
        "parts": pa.array([-(-counts[s] // unit) for s in sizes], pa.int64()),
        "places": pa.array([[k for _, k in packed[s]] for s in sizes], pa.list_(pa.int64())),
        "bins": pa.array([[b for b, _ in packed[s]] for s in sizes], pa.list_(pa.int32())),
    }
    plan = spark.createDataFrame(pa.table(told))
    few = F.broadcast if len(sizes) <= MOST_BROADCAST else (lambda df: df)
    # Ranks of groups within their class: by bucket, buckets in order.
    dealt = groups.join(few(plan.select("bytes", "parts")), "bytes").withColumn("part", F.pmod(F.xxhash64("text_md5"), F.col("parts")))
    behind = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("m")).select("bytes", "part", F.coalesce(F.sum("m").over(behind), F.lit(0)).alias("first"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("bytes", "part").orderBy("text_md5"))).join(firsts, ["bytes", "part"])
    rank = F.col("first") + F.col("place") - 1
    # The run that a rank falls into: how many runs end at or before it.
    ends = F.transform(F.sequence(F.lit(1), F.size("places")), lambda i: F.aggregate(F.slice("places", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    run = F.size(F.filter(ends, lambda end: end <= rank))
    placed = ranked.join(few(plan.select("bytes", "places", "bins")), "bytes").select("text_md5", F.col("bins")[run].alias("shard"))
    # Slots: rows in buckets by hash, counted within, buckets in order.
    where = rows.join(placed, "text_md5").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_md5"), F.lit(-(-n // unit) or 1)))
    parts = where.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_md5")
    numbered = where.withColumn("in_part", F.row_number().over(inside)).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "text_md5", "shard", (F.col("first") + F.col("in_part") - 1).cast("long").alias("slot"))
