"""Quality classifier: a sparse rule ensemble.

Statistics of each text are taken over its bytes and words; shallow trees grown on labelled rows
yield rules, each path being a conjunction of thresholds on statistics; a lasso logistic regression
weighs the rules and sets most to zero; the rest compile into one Spark column expression, which
scores every row without Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, chunks, give_back, held_out, in_share, small_batches, utf8
from .words import LOWER, span_hashes, word_spans

#: Labelled rows that a model is fitted on, about; those with the least hashes of their ids.
MOST_ROWS = 40_000
TREES, DEPTH, BINS, LEAST_LEAF, LASSO, SEED = 24, 3, 64, 5, 0.001, 7
STATISTICS = (
    "words", "mean_word", "long_words", "upper", "digits", "symbols", "stops", "spaces", "beyond_ascii", "line_length",
    "repeated_words", "repeated_pairs", "repeated_lines", "shouted_words", "marked_words", "lone_marks", "bytes_kinds",
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 3
_CLASS[[ord(c) for c in "!\"'(),-.:;?"]] = 4
_CLASS[[32, *range(9, 14)]] = 5
_CLASS[128:] = 6
_MARK, _CAPITAL, _SMALL = (_CLASS == 3).astype(np.uint8), (_CLASS == 1).astype(np.uint8), np.zeros(256, np.uint8)
_MARK[33] = 1
_SMALL[97:123] = 1
#: Bytes of text worked on at a time.
_STEP = 1 << 16


def _repeats(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The share of each row's values that are repeats of another."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r[again], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))


def _statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """STATISTICS of texts side by side; memory is some 20 bytes for each byte of them."""
    n = len(ends) - 1
    size = np.maximum(1, np.diff(ends))
    seen = np.zeros((n, 256), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        for k in range(a, b, _STEP):
            seen[i] += np.bincount(data[k : min(b, k + _STEP)], minlength=256)
    kinds = seen @ (_CLASS[:, None] == np.arange(7)).astype(np.int64)
    starts, stops, first = word_spans(data, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    length = stops - starts
    words = np.maximum(1, np.diff(first))
    per_word = lambda x: np.bincount(of, weights=x, minlength=n) / words
    hashes = span_hashes(LOWER[data], starts, stops)
    near = of[1:] == of[:-1]
    pairs = (hashes[1:] * np.uint64(31) + hashes[:-1])[near]
    edges = np.stack([starts, stops], 1).ravel()

    def within(flagged: np.ndarray) -> np.ndarray:
        """How many of each word's bytes are flagged, by byte."""
        flags = np.append(flagged[data], np.uint8(0))
        return np.add.reduceat(flags, edges, dtype=np.int32)[::2] if len(edges) else np.zeros(0, np.int32)

    marks, capitals, small = within(_MARK), within(_CAPITAL), within(_SMALL)
    feeds = np.nonzero(data == 10)[0]
    line_start = np.union1d(ends[:-1], feeds + 1)
    line_start = line_start[line_start < len(data)]
    line_stop = np.append(line_start[1:], len(data))
    if len(line_start):
        line_stop = line_stop - (data[line_stop - 1] == 10)
    full = line_stop > line_start
    line_of = np.searchsorted(ends, line_start[full], "right") - 1
    repeated_lines = _repeats(line_of, span_hashes(data, line_start[full], line_stop[full]), n)
    columns = [
        np.diff(first), per_word(length), per_word(length > 15), *(kinds[:, k] / size for k in (1, 2, 3, 4, 5, 6)), size / (1 + seen[:, 10]),
        _repeats(of, hashes, n), _repeats(of[1:][near], pairs, n), repeated_lines,
        per_word((capitals > 1) & (small == 0)), per_word((marks > 0) & (marks < length)), per_word(marks == length), (seen > 0).sum(1),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def text_statistics(text: str = "text") -> Column:
    """STATISTICS of each whole text as an array; those of a null text are those of an empty one."""
    return F.arrow_udf(_arrow_statistics, "array<double>")(text)


def _arrow_statistics(text: pa.Array) -> pa.Array:
    parts = [_statistics(*utf8(text.slice(a, n))) for a, n in chunks(text, 4 * _STEP)]
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
    give_back()
    return pa.FixedSizeListArray.from_arrays(pa.array(flat), len(STATISTICS)).cast(pa.list_(pa.float64()))


def _tight(conditions) -> tuple:
    """One upper and one lower threshold for each statistic."""
    best: dict = {}
    for k, op, at in conditions:
        best[k, op] = (min if op == "<=" else max)(at, best.get((k, op), at))
    return tuple(sorted((k, op, at) for (k, op), at in best.items()))


def rule_column(rule: tuple, statistics: str = "statistics") -> Column:
    out = F.lit(True)
    for k, op, at in rule:
        value = F.col(statistics)[k]
        out = out & ((value <= F.lit(at)) if op == "<=" else (value > F.lit(at)))
    return out


class RuleEnsemble:
    """Rules with weights; ``column`` compiles them into the probability of label 1."""

    def __init__(self, rules: list[tuple], weights: list[float], intercept: float):
        kept = [(r, w) for r, w in zip(rules, weights) if w]
        self.rules, self.weights, self.intercept = [r for r, _ in kept], [w for _, w in kept], intercept

    def column(self, statistics: str = "statistics") -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule_column(rule, statistics), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def told(self) -> list[str]:
        """The rules in words, heaviest first."""
        rows = sorted(zip(self.rules, self.weights), key=lambda x: -abs(x[1]))
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[k]} {op} {at:g}" for k, op, at in r) for r, w in rows]


def _grow(bins: np.ndarray, cuts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rng: np.random.Generator, path: list, depth: int, found: set) -> None:
    """Splits rows at the statistic and threshold that lower Gini impurity most; every path from one condition on is a rule."""
    total, ones = weight.sum(), weight[label == 1].sum()
    if depth == 0 or total < 2 * LEAST_LEAF or ones in (0, total):
        return
    best = (1e-9, 0, 0)
    for k in rng.choice(bins.shape[1], max(1, -(-bins.shape[1] // 3)), replace=False).tolist():
        if not len(cuts[k]):
            continue
        both = np.bincount(2 * bins[:, k] + label, weights=weight, minlength=2 * len(cuts[k]) + 2).reshape(-1, 2)
        low = np.cumsum(both, 0)[:-1]
        n, m = low.sum(1), total - low.sum(1)
        fits = (n >= LEAST_LEAF) & (m >= LEAST_LEAF)
        n, m = np.maximum(n, 1), np.maximum(m, 1)
        gain = np.where(fits, (low[:, 1] ** 2 + low[:, 0] ** 2) / n + ((ones - low[:, 1]) ** 2 + (total - ones - low[:, 0]) ** 2) / m - (ones**2 + (total - ones) ** 2) / total, 0)
        at = int(gain.argmax())
        best = max(best, (float(gain[at]), k, at), key=lambda x: x[0])
    gain, k, at = best
    if gain <= 1e-9:
        return
    for op, side in (("<=", bins[:, k] <= at), (">", bins[:, k] > at)):
        longer = path + [(k, op, float(cuts[k][at]))]
        found.add(_tight(longer))
        _grow(bins[side], cuts, label[side], weight[side], rng, longer, depth - 1, found)


def grow_rules(statistics: np.ndarray, label: np.ndarray) -> list[tuple]:
    """The paths of TREES trees over resampled rows, each split looking at a third of the statistics."""
    cuts = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS)) for column in statistics.T]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, statistics.T)], 1)
    rng, found = np.random.default_rng(SEED), set()
    for _ in range(TREES):
        _grow(bins, cuts, label, rng.poisson(1.0, len(label)).astype(np.float64), rng, [], DEPTH, found)
    return sorted(found)


def holds(rule: tuple, statistics: np.ndarray) -> np.ndarray:
    out = np.ones(len(statistics), bool)
    for k, op, at in rule:
        out &= statistics[:, k] <= at if op == "<=" else statistics[:, k] > at
    return out


def lasso_logistic(ones: np.ndarray, label: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression whose weights, on columns of unit spread, pay ``penalty`` each: accelerated proximal gradient."""
    spread = np.maximum(ones.std(0), 1e-6)
    x = (ones / spread).astype(np.float32)
    centre = x.mean(0)
    x -= centre
    top = np.full(x.shape[1], 1.0 / max(1, x.shape[1]) ** 0.5)
    gram = (x.T @ x).astype(np.float64) / len(x)
    for _ in range(30):
        top = gram @ top
        top /= max(1e-12, np.linalg.norm(top))
    rate = 1.0 / (0.25 * (float(top @ gram @ top) * 1.05 + 1.0))
    share = float(np.clip(label.mean(), 1e-6, 1 - 1e-6))
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        miss = 1.0 / (1.0 + np.exp(-np.clip(x @ v.astype(np.float32) + c, -40, 40))) - label
        moved = v - rate * (x.T @ miss.astype(np.float32)) / len(x)
        fresh, fresh_b = np.sign(moved) * np.maximum(0.0, np.abs(moved) - rate * penalty), c - rate * float(miss.mean())
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pull = (t - 1) / later
        v, c, t = fresh + pull * (fresh - w), fresh_b + pull * (fresh_b - b), later
        still = np.abs(fresh - w).max(initial=0.0) < 1e-5
        w, b = fresh, fresh_b
        if still:
            break
    return w / spread, b - float(w @ centre)


def fit_rules(statistics: np.ndarray, label: np.ndarray) -> RuleEnsemble:
    """A model of statistics by row and labels 0 or 1; without both labels it gives the one, or 0.5, to all."""
    label = np.asarray(label).astype(np.int64)
    if len(np.unique(label)) < 2:
        return RuleEnsemble([], [], 0.0 if not len(label) else 4.0 if label[0] == 1 else -4.0)
    rules = grow_rules(statistics, label)
    if not rules:
        return RuleEnsemble([], [], float(np.log(label.mean() / (1 - label.mean()))))
    weights, intercept = lasso_logistic(np.stack([holds(r, statistics) for r in rules], 1).astype(np.float32), label)
    return RuleEnsemble(rules, weights.tolist(), intercept)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> RuleEnsemble:
    """A model of labelled rows of ``docs`` that are not held out: about ``most_rows`` of them, chosen by a hash of their ids.

    The labels that take part are chosen first, so statistics are taken of their rows only. What is
    joined by broadcast and what comes to the driver, a row of numbers each, is twice ``most_rows`` rows at most.
    """
    marks = labels.where("quality is not null").where(~held_out()).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_of"), F.col("quality").cast("int").alias("_label"))
    total = marks.count()
    share = min(1.0, most_rows / max(1, total))
    chosen = marks.where(in_share(F.xxhash64(F.lit(3), "_of"), share)).orderBy(F.xxhash64(F.lit(4), "_of"), "_of", "_label").limit(2 * most_rows)
    rows = docs.select("doc_id", "text").where(in_share(F.xxhash64(F.lit(3), F.col("doc_id").cast("long")), share))
    met = rows.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_of")).select("_label", text_statistics("text").alias("_statistics"))
    got = met.orderBy(F.xxhash64("_label", "_statistics"), "_label", "_statistics").limit(2 * most_rows).toArrow().combine_chunks()
    table = got.column("_statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    label = got.column("_label").to_numpy()
    order = np.lexsort((*table.T, label))  # whatever order the rows came in
    return fit_rules(table[order], label[order])


def score_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, quality) of rows that are not held out; the score depends on the
    text alone. Predicted is 1 from ``threshold`` on.

    Defined cases: null and empty texts have statistics of an empty text and get a score like any;
    a null doc_id is not held out and has no label; labels that are null are no labels; repeated
    rows each get their row; an id with several labels counts with each; equal texts have equal
    scores; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit_quality(docs, labels, most_rows)
    known = docs.select("doc_id", text_statistics("text").alias("statistics"))
    scored = known.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` predicted 1, with all their columns; see score_quality for the cases."""
    small_batches(docs.sparkSession)
    model = fit_quality(docs, labels, most_rows)
    slim, back = aside(docs, "text")
    return back(slim.withColumn("statistics", text_statistics("text")).where(model.column("statistics") >= threshold))
