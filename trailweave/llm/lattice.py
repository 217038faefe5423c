"""Embedding near-dedup by lattice hashing.

A table projects vectors at random onto ``lattices`` times 8 dimensions and decodes each 8 to the
nearest point of the E8 lattice; the points together are the vector's cell. In every table a vector
lies in its home cell and also probes the cells it nearly fell into. Of two vectors, the one with the
lesser id probes: the pair is found in a table if the other's home is among the cells of the lesser.
Pairs found are verified by cosine in double precision. A pair that several tables find counts in the
first of them, which is worked out anew for verified pairs, so no list of pairs is ever built: a
task hands on link counts and a spanning forest of what it has verified.

With the settings here a pair at cosine 0.95 is found by one table with a chance of 0.4 to 0.5, by
ten with more than 0.99, and pairs at 0.98 practically always; tests measure it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .near import _runs
from .words import mix

COSINE, TABLES, LATTICES, PROBES, SCALE, SEED = 0.95, 12, 2, 8, 0.6, 17
#: Vectors of a cell that are compared in one group, at least; larger cells are split into blocks.
BLOCK = 256


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point whose sum is even."""
    out = np.rint(x)
    off = x - out
    rows = np.nonzero(out.sum(1).astype(np.int64) % 2)[0]
    worst = np.abs(off[rows]).argmax(1)
    out[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: E8 is the even-sum integer points and those moved by a half."""
    one, two = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - one) ** 2).sum(1) <= ((x - two) ** 2).sum(1))[:, None], one, two)


class LatticeTables:
    """Cells of vectors of one dimension: ``cells`` gives for each table the home and the probed cells."""

    def __init__(self, dimension: int, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng((seed, dimension))
        self.tables, self.lattices, self.probes = tables, lattices, probes
        self.planes = rng.normal(size=(tables, lattices, dimension, 8)) * scale
        self.moves = rng.uniform(size=(tables, lattices, 8))
        self.codes = rng.integers(1, 1 << 63, size=(tables, lattices, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.roots = roots()

    def cells(self, unit: np.ndarray, tables=None) -> np.ndarray:
        """vectors x tables x (1 + lattices * probes) cell numbers; the first of each is the home."""
        tables = range(self.tables) if tables is None else tables
        out = np.zeros((len(unit), len(tables), 1 + self.lattices * self.probes), np.uint64)
        for k, t in enumerate(tables):
            total, steps = np.zeros(len(unit), np.uint64), []
            for i in range(self.lattices):
                x = unit @ self.planes[t, i] + self.moves[t, i]
                point = nearest_e8(x)
                code = self.codes[t, i]
                # Twice a point's coordinates are whole, and the code of a sum is the sum of the codes.
                total += ((2 * point).astype(np.int64).view(np.uint64) * code).sum(1, dtype=np.uint64)
                lean = (x - point) @ self.roots.T
                best = np.argpartition(-lean, self.probes, 1)[:, : self.probes]
                steps.append((((2 * self.roots).astype(np.int64).view(np.uint64) * code).sum(1, dtype=np.uint64))[best])
            out[:, k, 0] = total
            out[:, k, 1:] = total[:, None] + np.concatenate(steps, 1)
            out[:, k] = mix(out[:, k] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        return out


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


class Hashing:
    """Lattice tables by dimension, made where they are first needed."""

    def __init__(self, *how):
        self.how, self.made = how, {}

    def __getstate__(self):
        return {"how": self.how, "made": {}}

    def of(self, dimension: int) -> LatticeTables:
        if dimension not in self.made:
            if len(self.made) >= 16:
                self.made.clear()
            self.made[dimension] = LatticeTables(dimension, *self.how)
        return self.made[dimension]


def _by_dimension(column: pa.Array):
    """(dimension, rows) for each length of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        yield int(d), np.nonzero(sizes == d)[0]


def _links(hashing: Hashing, least: float):
    """Rows sorted by group: node, links (rows that the node's vector links with here first) and root (the least node it reaches here)."""

    def pairs_of(group, unit, t, node, home):
        """Verified pairs (i, j) of rows, node[i] < node[j], j at home."""
        n, place = len(node), np.arange(len(node))
        starts = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
        sizes = np.diff(np.append(starts, n))
        left = np.repeat(starts + sizes, sizes) - place
        small = np.repeat(sizes <= 24, sizes)
        for step in range(1, 24):
            i = place[small & (left > step)]
            if not len(i):
                break
            for a, b in ((i, i + step), (i + step, i)):
                ok = home[b] & (node[a] < node[b])
                a, b = a[ok], b[ok]
                for s in range(0, len(a), 100_000):
                    x, y = a[s : s + 100_000], b[s : s + 100_000]
                    hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                    yield x[hit], y[hit]
        for s, m in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
            for r in range(s, s + m, 512):
                rows = slice(r, min(r + 512, s + m))
                hit = (unit[rows] @ unit[s : s + m].T >= least) & home[s : s + m] & (node[rows, None] < node[s : s + m])
                x, y = np.nonzero(hit)
                yield x + r, y + s

    def rows(batches):
        for every in _runs(batches, "grouped"):
            every = every.combine_chunks()
            column = every.column("embedding").combine_chunks()
            for d, on in _by_dimension(column):  # a group's vectors agree in it
                t = every.take(pa.array(on)) if len(on) < every.num_rows else every
                found = linked(t, d)
                if found is not None:
                    yield found

    def linked(t, dimension):
        tables = hashing.of(dimension)
        group, table, block, node, n = (t.column(c).to_numpy() for c in ("grouped", "t", "block", "node", "n"))
        home = t.column("home").to_numpy()
        unit = _unit(t.column("embedding").combine_chunks(), dimension)
        order = np.lexsort((node, group))
        group, table, block, node, n, home, unit = (x[order] for x in (group, table, block, node, n, home, unit))
        links, involved = np.zeros(len(node), np.int64), [[], []]
        for a, b in pairs_of(group, unit, table, node, home):
            # In a group of two blocks only pairs across them are new.
            ok = (block[a] < 0) | (block[a] != block[b])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            involved[0].append(a)
            involved[1].append(b)
            first = np.ones(len(a), bool)
            for k in range(1, int(table[a].max()) + 1):
                on = first & (table[a] >= k)
                if not on.any():
                    break
                who, back = np.unique(np.concatenate([a[on], b[on]]), return_inverse=True)
                cells = tables.cells(unit[who], [k - 1])[:, 0]
                x, y = cells[back[: on.sum()]], cells[back[on.sum() :], 0]
                first[on] = ~(x == y[:, None]).any(1)
            a, b = a[first], b[first]
            links += np.bincount(a, weights=n[b], minlength=len(node)).astype(np.int64) + np.bincount(b, weights=n[a], minlength=len(node)).astype(np.int64)
        if not involved[0]:
            return None
        a, b = (np.concatenate(x) for x in involved)
        names, back = np.unique(node, return_inverse=True)
        root = names[_forest(back[a], back[b], len(names))]
        total = np.bincount(back, weights=links, minlength=len(names)).astype(np.int64)
        on = np.unique(np.concatenate([back[a], back[b]]))
        return pa.RecordBatch.from_arrays([pa.array(names[on]), pa.array(total[on]), pa.array(root[on])], ["node", "links", "root"])

    return rows


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link
    with nothing, and so do rows with a null vec_id, whose component is null and which are not kept;
    rows of one vec_id with unlike vectors link each by its own vector; vectors of every dimension are compared with those of the same one; equal vectors are one node and
    link with one another; an empty table gives an empty result; other columns are ignored.
    """
    e = F.col("embedding")
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, fine) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    told = rows.select("vec_id", "embedding", valid.alias("valid"), *(F.when(valid, F.xxhash64(F.lit(k), "embedding")).alias(f"k{k}") for k in (1, 2)))
    every = told.drop("embedding")
    alike = told.where("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    nodes = cut(alike.withColumn("node", F.monotonically_increasing_id()))  # a number that the checkpoint fixes
    of_node = nodes.select("node", "n", "embedding")
    hashing = Hashing(tables, lattices, probes, scale)
    shared = rows.sparkSession.sparkContext.broadcast(hashing)
    width = 1 + lattices * probes

    def keys(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for d, on in _by_dimension(batch.column("embedding").slice(start, 1000)):
                    some = batch.slice(start, 1000).take(pa.array(on))
                    cells = mix(shared.value.of(d).cells(_unit(some.column("embedding"), d)) + np.uint64(d))
                    m = some.num_rows
                    node = np.repeat(some.column("node").to_numpy(), tables * width)
                    t = np.tile(np.repeat(np.arange(tables, dtype=np.int32), width), m)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(t), pa.array(node), pa.array(np.tile(np.arange(width) == 0, m * tables))], ["cell", "t", "node", "home"])

    keyed = of_node.select("node", "embedding").mapInArrow(keys, "cell long, t int, node long, home boolean")
    many = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("low"), F.max(F.when(F.col("home"), F.col("node"))).alias("high"))
    many = many.where("low < high").select("cell", F.ceil(F.col("c") / F.greatest(F.lit(block), F.pow("c", F.lit(2 / 3)))).cast("int").alias("g"))
    b = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    met = keyed.join(many, "cell").withColumn("b", b).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    grouped = F.xxhash64("cell", F.least("b", "with"), F.greatest("b", "with"))
    met = met.select("t", "node", "home", grouped.alias("grouped"), F.when(F.col("b") == F.col("with"), F.lit(-1)).otherwise(F.col("b")).alias("block"))
    dealt = met.join(of_node, "node").repartition("grouped").sortWithinPartitions("grouped")
    found = cut(dealt.select("grouped", "t", "block", "node", "n", "home", "embedding").mapInArrow(_links(hashing, cosine), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = parts.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    names = nodes.drop("embedding").join(links, "node", "left").join(parts, "node", "left").join(least, "component", "left")
    out = every.join(names, ["k1", "k2"], "left")
    component = F.when(F.col("valid"), F.coalesce("least", "low")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("valid"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
