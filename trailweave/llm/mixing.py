"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source is a queue of its documents in a shuffled order that depends on their ids alone. A
document's virtual finish time is the number of its source's tokens up to and including it, divided
by the source's target; further epochs of a source queue behind the first. One global order by
finish time interleaves the sources so that each reaches its target at time 1, and the order is
truncated at the total budget.

Running totals never gather a source in one task: a source's documents are dealt into about
sqrt(rows) buckets by their shuffle key, bucket totals give offsets, and a window inside a bucket
adds the rest. The cut is found the same way on a histogram of finish times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 20_011
LEAST_BUCKET = 64
#: Sources that are joined by broadcast, some 100 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def word_count(text: str = "text") -> Column:
    """Number of words of the whole text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: skey, source, source_rows, source_size, weight, target.

    Sources in code-point order, null last, take the weights in turn. Targets share ``share`` times
    all sizes by weight; one that would pass ``epochs`` times its source's size stops there and the
    others share the excess. Sorted by size per weight, the sources that stop are a prefix, so the
    level that the others reach follows from running sums.
    """
    sources = docs.groupBy(_skey().alias("skey"), "source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    by_name, by_room, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "skey"), Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sources.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("at", F.row_number().over(by_room))
        .withColumn("open_at", F.min(F.when(F.col("room") > F.col("level"), F.col("at"))).over(every))
        .withColumn("final", F.min(F.when(F.col("at") == F.col("open_at"), F.col("level"))).over(every))
    )
    stops = F.col("open_at").isNull() | (F.col("at") < F.col("open_at"))
    return levels.select("skey", "source", "source_rows", "source_size", "weight", "budget", F.when(stops, F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _skey() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _order(*first: str) -> list[Column]:
    return [*(F.col(c) for c in first), F.col("_skey"), F.col("_u"), F.col("doc_id").asc_nulls_first(), F.col("size")]


def fair_mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of ``docs`` plus source_size, target, finish (array by epoch), copies and taken.

    ``docs`` needs doc_id, source and a non-negative long ``size``. ``copies`` is how often the mix
    takes the document (0 to ``epochs``), ``taken`` that times its size. A finish time within the
    budget is taken; the order is cut at the first document that would pass the budget.

    Defined cases: a document of size 0 and all documents of a table without words are not taken;
    null sources are one source, after the others; rows with a null id are shuffled by a hash of the
    row; rows that agree in id, source and size may stand for one another; an empty table gives an
    empty result. Columns named like those added here are replaced; any other passes through.
    """
    return _mixed(docs, **how).drop("_skey", "_u")


def _mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """fair_mix with _skey and _u, which break ties between finish times."""
    plain = docs.drop("source_size", "target", "finish", "copies", "taken", "_skey", "_source_rows", "_budget", "_u", "_buckets", "_b", "_offset", "_within")
    sources = cut(source_targets(plain, weights, share, epochs).select(F.col("skey").alias("_skey"), F.col("source_rows").alias("_source_rows"), "source_size", "target", F.col("budget").alias("_budget")))
    few = F.broadcast if sources.count() <= MOST_BROADCAST else (lambda df: df)
    row = F.xxhash64(*(c for c, kind in plain.dtypes if "map<" not in kind))  # spreads rows without an id
    known_id = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), row.cast("string")))
    placed = (
        plain.withColumn("_skey", _skey())
        .join(few(sources), "_skey")
        .withColumn("_u", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), known_id).cast("binary")), 1, 15), 16, 10).cast("long"))
        .withColumn("_buckets", F.ceil(F.col("_source_rows") / F.greatest(F.lit(LEAST_BUCKET), F.sqrt("_source_rows"))))
        .withColumn("_b", F.floor(F.col("_u") / F.lit(2.0**60) * F.col("_buckets")))
    )
    sums = placed.groupBy("_skey", "_b").agg(F.sum("size").alias("_sum"))
    behind = Window.partitionBy("_skey").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select("_skey", "_b", F.coalesce(F.sum("_sum").over(behind), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_skey", "_b").orderBy("_u", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("_offset") + F.col("_within")
    finish = F.array(*((done + F.lit(e) * F.col("source_size")) / F.col("target") for e in range(epochs)))
    timed = placed.withColumn("_within", F.sum("size").over(inside)).join(offsets, ["_skey", "_b"]).withColumn("finish", F.when((F.col("size") > 0) & (F.col("target") > 0), finish))
    last = _last_taken(timed.select("finish", "_skey", "_u", "doc_id", "size", "_budget"))
    if last is None:
        copies = F.lit(0)
    else:
        place = lambda t: F.struct(t.alias("t"), F.col("_skey"), F.col("_u"), F.col("doc_id"), F.col("size"))
        bound = F.struct(F.lit(last["t"]).alias("t"), F.lit(last["_skey"]).alias("_skey"), F.lit(last["_u"]).alias("_u"), F.lit(last["doc_id"]).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"))
        copies = F.when(F.col("finish").isNotNull(), sum((place(F.col("finish")[e]) <= bound).cast("int") for e in range(epochs))).otherwise(F.lit(0))
    out = timed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_source_rows", "_budget", "_buckets", "_b", "_offset", "_within")


def _last_taken(timed: DataFrame):
    """The place in the global order of the last copy within the budget, or None."""
    n, budget = timed.agg(F.count("finish"), F.max("_budget")).first()
    if not n or not budget:
        return None
    copies = timed.where("finish is not null").select(F.explode("finish").alias("t"), "_skey", "_u", "doc_id", "size")
    copies = copies.withColumn("_h", F.floor(F.col("t") * F.lit(float(max(1, int(n**0.5))))))
    running = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    bars = copies.groupBy("_h").agg(F.sum("size").alias("_sum")).withColumn("_total", F.sum("_sum").over(running))
    over = bars.where(F.col("_total") > budget).agg(F.min_by(F.struct("_h", F.col("_total") - F.col("_sum")), "_h")).first()[0]
    if over is None:
        return copies.agg(F.max(F.struct("t", "_skey", "_u", "doc_id", "size")).alias("m")).first()["m"]
    edge = copies.where(F.col("_h") == over[0])
    total = F.lit(over[1]) + F.sum("size").over(Window.orderBy(*_order("t")).rowsBetween(Window.unboundedPreceding, 0))
    kept = edge.withColumn("_total", total).where(F.col("_total") <= budget)
    last = kept.agg(F.max(F.struct("t", "_skey", "_u", "doc_id", "size")).alias("m")).first()["m"]
    if last is None:
        last = copies.where(F.col("_h") < over[0]).agg(F.max(F.struct("t", "_skey", "_u", "doc_id", "size")).alias("m")).first()["m"]
    return last


def mixed_stream(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: one row per copy taken, with finish_time, range-sorted over the whole output."""
    mixed = _mixed(docs, **how)
    taken = mixed.where("copies > 0").withColumn("finish_time", F.explode(F.slice("finish", F.lit(1), F.col("copies"))))
    ordered = taken.orderBy(*_order("finish_time"))
    return ordered.drop("finish", "copies", "taken", "source_size", "target", "_skey", "_u")
