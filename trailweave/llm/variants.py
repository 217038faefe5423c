"""Spelling variants: words one edit apart, and the common form that a rare one stands for.

Words of texts are counted, and each is compared with the others by sorted-list dynamic programming.
A list of words sorted by code points is a tree of ranges with a common prefix; an edit-matrix row
depends on the prefix alone, so one row of it, three entries wide as one edit allows, serves a whole
range, and a range whose row exceeds one edit is skipped with all words in it. Rows are worked out
for all words of a task side by side, one depth after the other.

Two words one edit apart agree in the first half of the shorter one or in a second half at least as
long. So a word meets those of its length, and of one more, that share its first half, and those
that share its second half, read backwards: lists of some words each instead of the whole vocabulary.
A list of very many words is cut into blocks, and each block of words runs over each block of the list.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small_batches

LETTERS, LEAST_LETTERS, LEAST_TIMES, TIMES_MORE, DAMAGED = r"[A-Za-zÀ-ÿ]+", 7, 2, 10, 31
#: Words of a list that are compared as one block, about.
BLOCK = 8192
#: Words, and words with a range each, that are worked on at a time.
_AT_A_TIME, _ROWS = 20_000, 2_000_000
#: Distinct words that a task counts together before it hands them on.
_COUNTED = 300_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDS = re.compile(LETTERS)


def words_of(doc_id: int | None, text: str, least: int = LEAST_LETTERS, damaged: int = DAMAGED) -> dict[str, int]:
    """word -> how often it occurs in a text, of ``least`` code points or more.

    A run of letters whose checksum, together with the id, ``damaged`` divides, loses the code point that the checksum names.
    """
    runs: dict[str, int] = {}
    for run in _WORDS.findall(text.encode().translate(_LOWER).decode()):
        if len(run) >= least:
            runs[run] = runs.get(run, 0) + 1
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: dict[str, int] = {}
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if damaged and h % damaged == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        words[run] = words.get(run, 0) + n
    return words


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, damaged: int = DAMAGED) -> DataFrame:
    """word, n over all texts of ``docs`` (doc_id, text)."""

    def rows(batches):
        held: dict[str, int] = {}

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py() or "", least, damaged).items():
                    held[word] = held.get(word, 0) + n
                if len(held) > _COUNTED:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return docs.select("doc_id", "text").mapInArrow(lean(rows), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of up to ``length`` letters, one row each, 0 behind a word's end."""
    return np.array([w.encode("latin-1") for w in words], f"S{length}").view(np.uint8).reshape(-1, length)


def near_words(words: np.ndarray, sizes: np.ndarray, group: np.ndarray, query: np.ndarray, listed: np.ndarray):
    """Pairs (i, j) of rows of one group, i a query and j listed, whose words are one edit apart.

    ``words``: letters, a row each, sorted by group and then by letters; ``sizes``: their lengths.
    """
    on = np.nonzero(listed)[0]
    rows, size = words[on], sizes[on]
    depth = rows.shape[1]
    # Ranges of the sorted list with a common prefix, for each depth: where they begin and which row lies in which.
    first = np.ones(len(on), bool)
    first[1:] = group[on][1:] != group[on][:-1]
    begins = np.nonzero(first)[0]
    asked = np.nonzero(query)[0]
    at = np.searchsorted(group[on][begins], group[asked])
    ok = at < len(begins)
    ok[ok] = group[on][begins][at[ok]] == group[asked[ok]]
    q, node = asked[ok], at[ok]
    wide = np.concatenate([words, np.zeros((len(words), 2), np.uint8)], 1)
    own = sizes
    # A row at depth d: edits between the list's d letters and the query's first d - 1, d and d + 1 letters, 2 meaning too many.
    row = np.tile(np.array([2, 0, 1], np.uint8), (len(q), 1))
    ends = np.append(begins[1:], len(on))
    for d in range(1, depth + 1):
        # A range's parts by its next letter; words that ended are parts of their own and go no further.
        first[1:] |= rows[1:, d - 1] != rows[:-1, d - 1]
        starts = np.nonzero(first)[0]
        low, high = np.searchsorted(starts, begins[node]), np.searchsorted(starts, ends[node])
        many = high - low
        parent = np.repeat(np.arange(len(q)), many)
        node = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        begins, ends = starts, np.append(starts[1:], len(on))
        q, row = q[parent], row[parent]
        letter = rows[begins[node], d - 1]
        alive = size[begins[node]] >= d
        fresh = np.full(row.shape, 2, np.uint8)
        for k in range(3):  # the query's first d - 2 + k + 1 letters
            j = d - 1 + k
            if j < 0:
                continue
            best = np.full(len(q), 2, np.uint8)
            if j >= 1:
                best = row[:, k] + ((wide[q, j - 1] != letter) | (j > own[q]))
            if k + 1 < 3:
                best = np.minimum(best, row[:, k + 1] + 1)
            if k:
                best = np.minimum(best, fresh[:, k - 1] + 1)
            fresh[:, k] = np.where(j <= own[q], np.minimum(best, 2), 2)
        keep = alive & (fresh.min(1) < 2)
        q, node, row = q[keep], node[keep], fresh[keep]
        done = size[begins[node]] == d  # the word ends here: it is the first of its range
        k = own[q] - d + 1
        hit = done & (k >= 0) & (k <= 2)
        hit[hit] = row[hit, k[hit]] == 1
        yield q[hit], on[begins[node[hit]]]
        if not len(q):
            break


def _lists(words: DataFrame, least: int, block: int) -> DataFrame:
    """Rows of the lists that words meet in: side (0 forwards, 1 backwards), s (the shorter length), list, word, n, asks, listed."""
    size = F.length("word")
    lists = []
    for side, text in ((0, F.col("word")), (1, F.reverse("word"))):
        for s in (size, size - 1):
            lists.append(F.struct(F.lit(side).alias("side"), s.alias("s"), F.substring(text, F.lit(1), F.floor(s / 2).cast("int")).alias("key")))
    keyed = words.select("word", "n", F.explode(F.array(*lists)).alias("l")).select("word", "n", "l.side", "l.s", "l.key").where(F.col("s") >= least)
    many = keyed.groupBy("side", "s", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / block).cast("int")
    met = keyed.join(many, ["side", "s", "key"]).withColumn("g", blocks).withColumn("b", F.pmod(F.xxhash64("word"), F.col("g")).cast("int"))
    other = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    role = lambda x, y, asks, listed: F.struct(x.alias("x"), y.alias("y"), F.lit(asks).alias("asks"), F.lit(listed).alias("listed"))
    b, o = F.col("b"), F.col("o")
    roles = F.when(b == o, F.array(role(b, b, True, True))).otherwise(F.array(role(b, o, True, False), role(o, b, False, True)))
    told = other.withColumn("r", F.explode(roles))
    return told.select("side", "s", F.xxhash64("side", "s", "key", "r.x", "r.y").alias("list"), "key", "word", "n", "r.asks", "r.listed")


def _whole_lists(batches):
    """Tables of whole lists from batches in which a list's rows follow each other."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            of = t.column("list").to_numpy()
            last = np.append(0, np.nonzero(of[1:] != of[:-1])[0] + 1)[-1]
            if last:
                yield t.slice(0, last)
            rest = t.slice(last)
    if rest is not None:
        yield rest


def _compared(batches):
    """Rows sorted by list: word, n_near, m (the largest n of a near word) and form (the least such word), for words with a near one."""
    for t in _whole_lists(batches):
        sides, lengths = t.column("side").to_numpy(), t.column("s").to_numpy()
        for side, s in np.unique(np.stack([sides, lengths]), axis=1).T.tolist():
            part = t.take(pa.array(np.nonzero((sides == side) & (lengths == s))[0]))
            yield from _of_length(part, side, s)


def _of_length(t: pa.Table, side: int, s: int):
    words = np.array(t.column("word").to_pylist(), object)
    group, n = t.column("list").to_numpy(), t.column("n").to_numpy()
    shown = _letters([w[::-1] for w in words] if side else words.tolist(), s + 1)
    order = np.lexsort((*shown.T[::-1], group))
    words, group, n, shown = words[order], group[order], n[order], shown[order]
    asks, listed = (t.column(c).to_numpy(zero_copy_only=False)[order] for c in ("asks", "listed"))
    sizes = (shown > 0).sum(1)
    ahead, half = _letters(words.tolist(), s + 1) if side else shown, s // 2
    count, most, form = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), "", object)
    asking = np.nonzero(asks)[0]
    for k in range(0, len(asking), _AT_A_TIME):
        some = np.zeros(len(words), bool)
        some[asking[k : k + _AT_A_TIME]] = True
        for i, j in near_words(shown, sizes, group, some, listed):
            ok = np.minimum(sizes[i], sizes[j]) == s  # two longer words meet in a list of their own
            ok &= (shown[i, :half] == shown[j, :half]).all(1)
            if side:  # those that share the first half too have met there
                ok &= (ahead[i, :half] != ahead[j, :half]).any(1)
            i, j = i[ok], j[ok]
            np.add.at(count, i, 1)
            for x, y in zip(i.tolist(), j.tolist()):
                if n[y] > most[x] or (n[y] == most[x] and words[y] < form[x]):
                    most[x], form[x] = n[y], words[y]
    on = np.nonzero(count)[0]
    if len(on):
        yield pa.RecordBatch.from_arrays([pa.array(words[on].tolist(), pa.string()), pa.array(count[on]), pa.array(most[on]), pa.array(form[on].tolist(), pa.string())], ["word", "n_near", "m", "form"])


def variants_of(words: DataFrame, least: int = 1, times_more: int = TIMES_MORE, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n), which are distinct, hold letters up to U+00FF
    and have ``least`` of them or more.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form is the near
    word of largest n (of equal ones the first by code points) if that n is at least ``times_more`` times the word's own;
    the root is what forms lead to in the end, the word itself where there is none.
    """
    words = cut(words.select("word", "n"))
    lists = _lists(words, least, block).repartition("list").sortWithinPartitions("side", "s", "list")
    found = lists.mapInArrow(lean(_compared), "word string, n_near long, m long, form string")
    best = F.min(F.struct((-F.col("m")).alias("m"), "form"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("b.m") >= F.lit(times_more) * F.col("n"), F.struct(F.col("b.form").alias("form"), (-F.col("b.m")).alias("n"))).alias("f"))
    told = cut(told.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")))
    steps = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form occurs ten times as often, so chains are short; each round doubles what they reach
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST_LETTERS, damaged: int = DAMAGED, least_times: int = LEAST_TIMES, times_more: int = TIMES_MORE, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words in ``docs`` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased; a run loses a letter where ``damaged``
    divides the checksum of its document's id and itself (0: never). Words of ``least`` code points and ``least_times``
    occurrences count.

    Defined cases: null and empty texts hold no words; a null doc_id counts as an empty one; rows that repeat count each;
    texts and runs of any length are read whole; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return variants_of(word_counts(docs, least, damaged).where(F.col("n") >= least_times), least, times_more, block)
