"""N-gram Jaccard join by rare-first prefix filtering.

A document's set holds its distinct word shingles as 64-bit hashes. All sets are sorted by one global
order, rare shingles first; two sets that reach the threshold then share a shingle within their
prefixes. Documents meet on prefix shingles, the length, positional and suffix filters drop pairs
that cannot reach it, and each pair left is verified once on the whole sets.

* Equal sets are one node, named by a 64-bit hash of the set, so copies are never paired.
* Rarity comes from counts over all documents, kept in counters that shingles share by hash; their
  number grows with that of shingles up to a bound. An error in a count only changes the order, the
  same for all documents.
* The suffix filter compares bitmaps of parities, which differ in no more bits than the sets differ
  in shingles, before any text is sent to be verified.
* A shingle that few nodes share gives its pairs at once. Where many share it, only pairs across the
  components known so far are taken: first forests of them, on a part of the shingles and on all, then
  all that are left. The components are exact, and a large group of near copies costs about its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, chunks, cut, lean, small_batches, utf8
from .components import components
from .words import mix, shingles

WORDS, PERCENT = 5, 80
#: Counters of rarity: one for so many shingles, between these bounds; a broadcast byte each.
SHINGLES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 8, 1 << 18, 1 << 24
#: Counters that travel together, and bits of the bitmap of documents whose texts are sent.
_BLOCK, _SENT_BITS = 1 << 16, 1 << 26
#: Nodes on one shingle whose pairs are all verified at once.
FEW = 6
#: Bits for each shingle in the bitmaps that the suffix filter compares, at least: with 8, few pairs
#: below the threshold pass it.
BITS = 8


def _of_text(batch, words: int):
    """For slices of a batch with doc_id, text: ids, hashes, begins."""
    column = batch.column("text")
    for start, n in chunks(column):
        yield batch.column("doc_id").slice(start, n), *shingles(*utf8(column.slice(start, n)), words)


def _sums(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One 64-bit value of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(total[begins[1:]] - total[begins[:-1]])


def _names(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values of each set, which together with its size identify it; the first names it in pairs."""
    return _sums(hashes, begins).view(np.int64), _sums(hashes * np.uint64(0x2545F4914F6CDD1D), begins).view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, told (a hash of the text), n_shingles, s1, s2 (what identifies the set) of every row."""

    def rows(batches):
        for batch in batches:
            at = 0
            for ids, hashes, begins in _of_text(batch, words):
                told, at = batch.column("told").slice(at, len(ids)), at + len(ids)
                yield pa.RecordBatch.from_arrays([ids, told, pa.array(np.diff(begins)), *map(pa.array, _names(hashes, begins))], ["doc_id", "told", "n_shingles", "s1", "s2"])

    return docs.withColumn("told", F.xxhash64("text")).mapInArrow(lean(rows), "doc_id long, told long, n_shingles long, s1 long, s2 long")


def _counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes >> np.uint64(36)).astype(np.int64) & (counters - 1)


def _ranks(docs: DataFrame, words: int, counters: int) -> np.ndarray:
    """How common the shingles of each counter are, in 256 steps, counted over all documents; ``counters`` bytes."""
    import zstandard

    def count(batches):
        counts = np.zeros(counters, np.int32)
        for batch in batches:
            for _, hashes, _ in _of_text(batch, words):
                used, n = np.unique(_counter(hashes, counters), return_counts=True)
                counts[used] += n
        z = zstandard.ZstdCompressor(level=1)
        for k, block in enumerate(counts.reshape(-1, _BLOCK)):
            if block.any():  # low bytes side by side, then the next ones, which are mostly zero
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(block.view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary())], ["block", "counts"])

    def add(batches):
        unz, total = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, told in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(unz.decompress(told), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
                total[k] = total.get(k, 0) + counts.astype(np.int64)
        for k, n in total.items():
            step = np.where(n < 64, n, np.minimum(255, 64 + 6 * (np.log2(np.maximum(n, 64)) - 6)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([step.astype(np.uint8).tobytes()], pa.binary())], ["block", "ranks"])

    out = np.zeros(counters, np.uint8)
    got = docs.mapInArrow(lean(count), "block int, counts binary").repartition("block").mapInArrow(lean(add), "block int, ranks binary").toArrow()  # a byte a counter
    for k, told in zip(got.column("block").to_pylist(), got.column("ranks").to_pylist()):
        out[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(told, np.uint8)
    return out


def _needed(a, b, percent: int):
    """The least intersection with which sets of these sizes link: 100 i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(docs: DataFrame, words: int, percent: int, counters: int) -> DataFrame:
    """h, node, n, at for each prefix shingle of each set; a task names a set once for all its copies."""
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(docs, words, counters))

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, hashes, begins in _of_text(batch, words):
                n = np.diff(begins)
                node = _sums(hashes, begins).view(np.int64)
                fresh = np.zeros(len(n), bool)
                for i in np.nonzero(n)[0].tolist():
                    if (k := int(node[i])) not in seen:
                        seen.add(k)
                        fresh[i] = True
                if len(seen) > 500_000:
                    seen.clear()
                text = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, ranks.value[_counter(hashes, counters)], text))
                at = np.arange(len(hashes)) - begins[:-1][text]
                keep = (at < (n - -(-percent * n // 100) + 1)[text]) & fresh[text]
                of = text[keep]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[order[keep]].view(np.int64)), pa.array(node[of]), pa.array(n[of], pa.int32()), pa.array(at[keep], pa.int32())], ["h", "node", "n", "at"])

    return docs.mapInArrow(lean(rows), "h long, node long, n int, at int")


def _runs(batches, key: str):
    """Tables of whole runs of equal ``key`` from batches that are sorted by it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        k = t.column(key).to_numpy()
        last = np.searchsorted(k, k[-1])
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
    if rest is not None:
        yield rest


def _compatible(n, at, i, j, percent):
    """Length and positional filters for rows i and j of one shingle."""
    a, b = n[i], n[j]
    rest = np.minimum(a - at[i], b - at[j])
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (rest >= _needed(a, b, percent))


def _candidates(percent: int, few: int):
    """Rows sorted by h: pairs (a, b) where few nodes share a shingle, (h, a, n, at) rows where many do."""

    def rows(batches):
        for t in _runs(batches, "h"):
            h, doc, n, at = (t.column(c).to_numpy() for c in ("h", "node", "n", "at"))
            n, at = n.astype(np.int64), at.astype(np.int64)
            order = np.lexsort((doc, n, h))
            h, doc, n, at = h[order], doc[order], n[order], at[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])  # a node that several tasks named is one
            h, doc, n, at = h[first], doc[first], n[first], at[first]
            starts = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
            sizes = np.diff(np.append(starts, len(h)))
            many = np.repeat(sizes > few, sizes)
            begin, place = np.repeat(starts, sizes), np.arange(len(h))
            i = np.concatenate([place[(place - back >= begin) & ~many] for back in range(1, few)])
            j = i - np.repeat(np.arange(1, few), [((place - back >= begin) & ~many).sum() for back in range(1, few)])
            ok = _compatible(n, at, i, j, percent)
            a, b = np.minimum(doc[i[ok]], doc[j[ok]]), np.maximum(doc[i[ok]], doc[j[ok]])
            one = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            none = lambda m, kind: pa.nulls(m, kind)
            m, big = one.shape[1], place[many]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1]), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32())], ["a", "b", "h", "n", "at"])
            if len(big):
                yield pa.RecordBatch.from_arrays([pa.array(doc[big]), none(len(big), pa.int64()), pa.array(h[big]), pa.array(n[big], pa.int32()), pa.array(at[big], pa.int32())], ["a", "b", "h", "n", "at"])

    return rows


class Bitmaps:
    """Parities of sets by hash: two bitmaps differ in no more bits than their sets differ in shingles.

    A bitmap has at least BITS bits for each shingle of its set, a power of two of them; folding it in
    halves gives the bitmap of half that width, by which sets of unlike sizes are compared.
    """

    @staticmethod
    def of(hashes: np.ndarray) -> bytes:
        width = max(512, 1 << (BITS * len(hashes) - 1).bit_length())
        return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()

    def __init__(self, packed: list[bytes]):
        self.width = np.array([len(p) for p in packed], np.int64)
        self.place = np.zeros(len(packed), np.int64)
        self.own, self.half = {}, {}
        for w in np.unique(self.width).tolist():
            mine = np.nonzero(self.width == w)[0]
            self.place[mine] = np.arange(len(mine))
            self.own[w] = np.frombuffer(b"".join(packed[i] for i in mine.tolist()), np.uint8).reshape(-1, w)
            self.half[w] = self.own[w][:, : w // 2] ^ self.own[w][:, w // 2 :]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits that differ for each pair of rows; 0, which rules nothing out, for sizes too unlike."""
        out = np.zeros(len(i), np.int64)
        for w in np.unique(self.width[i]).tolist():
            for v, one, two in ((w, self.own, self.own), (2 * w, self.own, self.half), (w // 2, self.half, self.own)):
                on = np.nonzero((self.width[i] == w) & (self.width[j] == v))[0]
                for k in range(0, len(on), 20_000):
                    some = on[k : k + 20_000]
                    out[some] = np.bitwise_count(one[w][self.place[i[some]]] ^ two[v][self.place[j[some]]]).sum(1, dtype=np.int64)
        return out


def _opened(column: pa.Array) -> pa.Array:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x) for x in column.to_pylist()], pa.binary())


def _sent_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size by hash of ``doc_id``: texts of other documents need not be sent."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_SENT_BITS))
    place = place + 1  # Spark numbers buckets of 32768 values from 1, beginning with value 1
    parts = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # of fixed size
    out = np.zeros((_SENT_BITS // 32768 + 1, 4096), np.uint8)
    for r in parts:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _nodes(known: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, s2, doc_id, n, bits, z (the text, compressed) for each (node, doc_id) in ``wanted``."""
    ids = wanted.select("doc_id").distinct()
    sent = known.sparkSession.sparkContext.broadcast(_sent_bitmap(ids))

    def packed(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            place = batch.column("place").to_numpy()
            byte = (place // 32768 + 1) * 4096 + place % 32768 // 8
            on = np.nonzero(sent.value[byte] >> (place % 8).astype(np.uint8) & 1)[0]
            some = batch.take(pa.array(on))
            texts = [z.compress(t or b"") for t in some.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "z"])

    def rows(batches):
        for batch in batches:
            for start, n in chunks(batch.column("z"), 500_000):
                hashes, begins = shingles(*utf8(_opened(batch.column("z").slice(start, n))), words)
                bits = [Bitmaps.of(hashes[a:b]) for a, b in zip(begins, begins[1:])]
                s1, s2 = _names(hashes, begins)
                own = s1 == batch.column("node").slice(start, n).to_numpy()
                kept = [batch.column("node").slice(start, n), pa.array(s2), batch.column("doc_id").slice(start, n), pa.array(np.diff(begins), pa.int32()), pa.array(bits, pa.binary()), batch.column("z").slice(start, n)]
                yield pa.RecordBatch.from_arrays(kept, ["node", "s2", "doc_id", "n", "bits", "z"]).filter(pa.array(own))

    texts = known.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(_SENT_BITS))).mapInArrow(lean(packed), "doc_id long, z binary")
    met = texts.join(wanted, "doc_id").select("node", "doc_id", "z").mapInArrow(lean(rows), "node long, s2 long, doc_id long, n int, bits binary, z binary")
    one = F.min(F.struct("s2", "n", "doc_id", "bits", "z")).alias("x")  # a row that repeats counts once
    return met.groupBy("node").agg(one).select("node", "x.*")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: the pairs whose bitmaps do not rule the threshold out."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            both, at = Bitmaps(batch.column("ba").to_pylist() + batch.column("bb").to_pylist()), np.arange(batch.num_rows)
            ok = both.differ(at, at + batch.num_rows) <= na + nb - 2 * _needed(na, nb, percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(lean(rows), "a long, b long")


def _crossing(percent: int, every: bool):
    """Rows sorted by h: pairs across the components which a shingle's nodes are still in, that pass all filters.

    Either ``every`` such pair, or a forest of them: once a pair is handed on, its components count as
    one here, so that a shingle gives fewer pairs than it has nodes.
    """

    def rows(batches):
        for t in _runs(batches, "h"):
            h, doc, n, at, part = (t.column(c).to_numpy() for c in ("h", "a", "n", "at", "component"))
            bitmaps = Bitmaps(t.column("bits").to_pylist())
            order = np.lexsort((mix(doc.view(np.uint64)), h))  # the same order of nodes for all shingles
            n, at = n.astype(np.int64), at.astype(np.int64)
            begin, out = 0, [[], []]
            for end in np.append(np.nonzero(np.diff(h[order]))[0] + 1, len(h)).tolist():
                mine, begin = order[begin:end], end
                label = part[mine].copy()
                for i in range(len(mine) - 1):
                    k = i + 1 + np.nonzero(label[i + 1 :] != label[i])[0]
                    if not len(k):
                        if (label == label[0]).all():
                            break
                        continue
                    x, y = mine[i], mine[k]
                    ok = _compatible(n, at, x, y, percent)
                    k, y = k[ok], y[ok]
                    ok = bitmaps.differ(np.full(len(y), x), y) <= n[x] + n[y] - 2 * _needed(n[x], n[y], percent)
                    k = k[ok]
                    if not every and len(k):
                        met, one = np.unique(label[k], return_index=True)
                        k = k[one]
                        label[np.isin(label, met)] = label[i]
                    out[0].append(np.minimum(doc[x], doc[mine[k]]))
                    out[1].append(np.maximum(doc[x], doc[mine[k]]))
            if out[0]:
                pairs = np.unique(np.stack([np.concatenate(x) for x in out]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    return rows


def _verify(pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), and whether the whole sets reach the threshold."""

    def rows(batches):
        for batch in batches:
            for start, n in chunks(batch.column("za"), 300_000):
                some = batch.slice(start, n)
                (ha, ba), (hb, bb) = (shingles(*utf8(_opened(some.column(c))), words) for c in ("za", "zb"))
                na, nb = np.diff(ba), np.diff(bb)
                h, r = np.concatenate([ha, hb]), np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
                o = np.lexsort((h, r))
                both = (h[o][1:] == h[o][:-1]) & (r[o][1:] == r[o][:-1])
                shared = np.bincount(r[o][1:][both], minlength=n)
                ok = (na > 0) & (nb > 0) & (100 * shared >= percent * (na + nb - shared))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(ok)], ["a", "b", "linked"])

    first = nodes.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    second = nodes.select(F.col("node").alias("a"), F.col("z").alias("za"))
    met = pairs.join(first, "b").join(second, "a")
    return met.select("a", "b", "za", "zb").mapInArrow(lean(rows), "a long, b long, linked boolean")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Words are runs without space and tab to carriage return, A-Z lower-cased. Sets link when
    100 * shared >= percent * united. component_id is the least doc_id reachable by links.

    Defined cases: fewer words than a shingle make one of all of them; texts that are null or hold no
    word have an empty set and stand alone; repeated rows each get their row; rows of one doc_id with
    different texts link by their texts, each for itself; a null doc_id takes no part in links and has
    a null component; an empty table gives an empty result; other columns are ignored.
    """
    return _grouped(docs, words, percent, few).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, few: int = FEW) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near duplicates: of each group the row of least id.

    Defined cases: of rows of the least id that belong to the group, the one whose text has the least
    hash stays, and of rows equal in id and text the least by their other columns; rows of one id
    whose texts are no near duplicates are in groups of their own; rows without an id, and rows
    whose text is null or holds no word, are in no group and all stay; an empty table gives an empty
    result; other columns pass through, whatever their names.
    """
    slim, back = aside(docs, "doc_id", "text")
    groups = _grouped(slim.select("doc_id", "text"), words, percent, few).where("doc_id is not null")
    first = groups.where("n_shingles > 0").groupBy("part").agg(F.min(F.struct("doc_id", "told")).alias("m")).select("m.doc_id", "m.told", F.lit(True).alias("one"))
    alone = groups.where("n_shingles = 0").select("doc_id", "told", F.lit(False).alias("one")).distinct()
    chosen = first.unionByName(alone).withColumnRenamed("doc_id", "id")
    rows = slim.withColumn("told", F.xxhash64("text")).withColumn("id", F.col("doc_id").cast("long"))
    met = rows.where("doc_id is not null").join(chosen, ["id", "told"])
    order = [F.col("__aside").getField(c) for c, kind in docs.dtypes if "map<" not in kind and c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("id", "told").orderBy(*(order or ["id"])))
    kept = met.withColumn("place", place).where("not one or place = 1")
    return back(kept.select(*slim.columns).unionByName(slim.where("doc_id is null")))


def _grouped(docs: DataFrame, words: int, percent: int, few: int) -> DataFrame:
    """doc_id, told (a hash of the text), n_shingles, component_id and part, which tells components of one least id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    small_batches(docs.sparkSession)
    told_sets = cut(_sets(docs, words))
    sets = told_sets.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    total = told_sets.agg(F.sum("n_shingles")).first()[0] or 0
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (total // SHINGLES_A_COUNTER).bit_length()))
    prefixes = _prefixes(known, words, percent, counters)
    found = cut(prefixes.repartition("h").sortWithinPartitions("h").mapInArrow(lean(_candidates(percent, few)), "a long, b long, h long, n int, at int"))
    pairs = found.where("b is not null").select("a", "b").distinct()
    crowded = found.where("b is null").drop("b")
    wanted = found.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    placed_sets = sets.select(F.col("s1").alias("node"), "doc_id").join(wanted, "node", "left_semi")
    nodes = cut(_nodes(known, placed_sets, words))
    tested = cut(_verify(_likely(pairs, nodes, percent), nodes, words, percent))
    named = nodes.select(F.col("node").alias("a"), "bits")

    def crossing(some: DataFrame, parts: DataFrame | None, every_pair: bool) -> DataFrame:
        """Verified pairs, not tested before, across components on shingles of (h, a, n, at)."""
        rows = some.withColumn("component", F.col("a"))
        if parts is not None:
            rows = some.join(parts.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        mixed = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
        left = rows.join(mixed, "h", "left_semi").join(named, "a").select("h", "a", "n", "at", "bits", "component")
        more = left.repartition("h").sortWithinPartitions("h").mapInArrow(lean(_crossing(percent, every_pair)), "a long, b long").distinct()
        return cut(_verify(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"), nodes, words, percent))

    # A forest of pairs on a sixteenth of the crowded shingles joins most of what there is to join, one on
    # all of them what is left; every likely pair that is then still across two components decides the rest.
    linked = lambda t: t.where("linked").select("a", "b")
    tested = tested.unionByName(crossing(crowded.where(F.pmod(F.xxhash64("h"), F.lit(16)) == 0), None, False))
    tested = tested.unionByName(crossing(crowded, components(linked(tested)), False))
    parts = components(linked(tested))
    late = linked(crossing(crowded, parts, True))
    if not late.isEmpty():
        parts = components(linked(tested).unionByName(late))
    # Only the set that gave a node its text has the node's links; one that shared its name by accident stands alone.
    of_sets = parts.join(nodes.select("node", "s2", F.col("n").alias("n_shingles")), "node").withColumnRenamed("node", "s1")
    alone = F.xxhash64("s1", "s2", "n_shingles")
    placed = sets.join(of_sets, ["s1", "s2", "n_shingles"], "left").withColumn("part", F.coalesce("component", alone))
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    reps = placed.join(least, "component", "left").select("s1", "s2", "n_shingles", "part", F.coalesce("least", "doc_id").alias("component_id"))
    known_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return told_sets.join(reps, ["s1", "s2", "n_shingles"], "left").select("doc_id", "told", "n_shingles", "part", F.coalesce(F.when(known_set, F.col("component_id")), "doc_id").alias("component_id"))
