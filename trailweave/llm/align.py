"""Alignment of two tokenizers over the same texts, and counts of the token pairs that meet.

Both tokenizers give a text as tokens that end at byte offsets. Where both end at one offset, a group
closes. Ends are compared by diagonal run skipping: from a pair of positions, blocks of doubling
length are compared at the index shift there, so that one-to-one stretches are jumped; an irregular
group is resolved by stepping the side that lags, which gives the next shift.

A text is cut before each space that follows a character other than white space. No token of either
tokenizer reaches across such a place (a byte-level pre-token holds no space behind another
character, a piece none inside), so each distinct segment is encoded once a task, and a text's groups
are its segments' groups in a row. New segments are encoded as runs, some hundred joined as one text; a run
whose tokens do not end where its segments do, or do not give back its bytes, is encoded segment by segment.

Texts' links travel packed, some thousand texts in one row: the pairs of a text once each with how
often they occur. The most frequent pairs' counts, a bounded number, reach every task; the others
join by a shuffle. Which pairs those are changes nothing in the result.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pieces_of
from .common import chunks, lean, small_batches, stored

#: Pairs whose counts every task gets, at most: 16 bytes each.
MOST_PAIRS = 1_000_000
#: Distinct segments and their characters that a task keeps, at most; then it begins anew.
KEPT_SEGMENTS, KEPT_CHARS = 150_000, 8_000_000
#: Pairs that a task counts together before it hands them on.
COUNTED = 4_000_000
#: Segments that are encoded together as one text, at most.
RUN = 200

# Not before a space at the very end: alone it would be an empty text to the piece tokenizer.
_CUT = re.compile(r"(?<=\S)(?= [\s\S])")
_UNEVEN = re.compile(r"^ |\s | $")
_PACKED = "ids array<bigint>, n_a array<int>, n_b array<int>, n_groups array<int>, groups_sha256 array<string>, links binary, chunk bigint"
_TOLD = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Where groups end, as numbers of tokens of both sides: ascending ends ``a`` and ``b`` cut at the offsets they share.

    Tokens behind the last shared end are in no group.
    """
    i, j, n, m = 0, 0, len(a), len(b)
    out_a, out_b = [], []
    while i < n and j < m:
        start, step, room = i, 1, min(n - i, m - j)
        while step <= room and a[i : i + step] == b[j : j + step]:
            i, j, room, step = i + step, j + step, room - step, 2 * step
        while step > 1:  # the run ends within this block, or the texts do
            step //= 2
            if step <= room and a[i : i + step] == b[j : j + step]:
                i, j, room = i + step, j + step, room - step
        if i > start:
            out_a.extend(range(start + 1, i + 1))
            out_b.extend(range(j - (i - start) + 1, j + 1))
        while i < n and j < m and a[i] != b[j]:  # an irregular group
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        if i < n and j < m:
            i, j = i + 1, j + 1
            out_a.append(i)
            out_b.append(j)
    return out_a, out_b


def segments(text: str) -> list[str]:
    """The segments of a space and ``text``, each without its first space."""
    if _UNEVEN.search(text):
        return [s[1:] for s in _CUT.split(" " + text)]
    return text.split(" ")


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes that each piece stands for: the mark of a space is one, a byte piece its byte."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    told = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(told)]


class Pair:
    """Two tokenizers and what they made of the segments seen so far."""

    def __init__(self, byte_json: str, piece_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.pieces, self.bpe = SentencePieceProcessor(model_proto=piece_model), Tokenizer.from_str(byte_json)
        self.bpe.no_truncation()
        self.bpe.no_padding()
        self.bpe.encode_special_tokens = True  # their strings are plain text
        told = pieces_of(byte_json)
        self.bytes_a = [told.get(i, b"") for i in range(max(told) + 1)]
        self.bytes_b = piece_bytes(piece_model)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = len(self.bytes_b)
        # A token's decimal id and what follows it in a list of groups: "," or "|" for A, "," or ";" for B.
        self.told = pa.array([b"%d%s" % (i, end) for n, ends in ((len(self.bytes_a), b",|"), (self.width, b",;")) for end in (ends[:1], ends[1:]) for i in range(n)], pa.large_binary())
        self.forget()

    def forget(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[bytes] = []  # each group ends with ";"
        self.sizes = np.zeros((4, 0), np.int64)  # tokens a, tokens b, groups, fits
        self.links, self.first = np.zeros(0, np.uint64), np.zeros(1, np.int64)

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), 2000) for e in self.bpe.encode_batch_fast([" " + t for t in texts[k : k + 2000]], add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def _side(self, ids: list[list[int]], raw: list[bytes], pieces: list[bytes]) -> list[bool]:
        return [b"".join([pieces[i] for i in x]) == r for x, r in zip(ids, raw)]

    def encoded(self, segs: list[str]):
        """Tokens of both sides of all segments in a row, how many each segment has, and whether it fits; one that does not has none."""
        sizes = np.array([len(s.encode()) + 1 for s in segs], np.int64)
        runs, alone = [], []
        for k in range(0, len(segs), RUN):
            joined = [i for i in range(k, min(k + RUN, len(segs))) if segs[i] and not segs[i][-1].isspace()]
            alone += [i for i in range(k, min(k + RUN, len(segs))) if not segs[i] or segs[i][-1].isspace()]
            if joined:
                runs.append(joined)
        texts = [" ".join([segs[i] for i in run]) for run in runs]
        raw = [(" " + t).encode() for t in texts]
        parts = {}
        both = self._encode_a(texts), self._encode_b(texts)
        fits = [x and y for x, y in zip(self._side(both[0], raw, self.bytes_a), self._side(both[1], raw, self.bytes_b))]
        for run, fit, x, y in zip(runs, fits, *both):
            if fit:
                stops = np.cumsum(sizes[run])
                ids = np.array(x, np.int64), np.array(y, np.int64)
                ends = np.cumsum(self.len_a[ids[0]]), np.cumsum(self.len_b[ids[1]])
                at = [np.searchsorted(e, stops, side="right") for e in ends]
                fit = all((e[k - 1] == stops).all() for e, k in zip(ends, at))
            if fit:
                parts[run[0]] = run, *ids, *(np.diff(k, prepend=0) for k in at), np.ones(len(run), np.int64)
            else:
                alone += run
        alone_ids = [segs[i] for i in alone]
        both = self._encode_a(alone_ids), self._encode_b(alone_ids)
        raw = [(" " + t).encode() for t in alone_ids]
        fits = [x and y for x, y in zip(self._side(both[0], raw, self.bytes_a), self._side(both[1], raw, self.bytes_b))]
        for i, fit, x, y in zip(alone, fits, *both):
            x, y = (x, y) if fit else ([], [])
            parts[i] = [i], np.array(x, np.int64), np.array(y, np.int64), [len(x)], [len(y)], [int(fit)]
        order, *rest = zip(*parts.values()) if parts else ([[]], *[[np.zeros(0, np.int64)]] * 5)
        return [i for run in order for i in run], *(np.concatenate(x).astype(np.int64) for x in rest)

    def learn(self, segs: list[str]) -> list[str]:
        """Encodes and aligns segments not seen before; they are numbered in the order that is returned."""
        order, a, b, na, nb, fits = self.encoded(segs)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cut_a, cut_b = (np.array(x, np.int64) for x in align(ends_a.tolist(), ends_b.tolist()))
        # In a list of groups a token stands behind the other side's tokens of the groups before, and B's also behind A's of its own.
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, cut_b)[group_a]] = a + last_a * len(self.bytes_a)
        codes[np.arange(len(b)) + np.append(cut_a, len(a))[group_b]] = b + last_b * self.width + 2 * len(self.bytes_a)
        _, at, data = self.told.take(pa.array(codes)).buffers()
        places = np.frombuffer(at, np.int64, len(codes) + 1)[np.append(0, np.cumsum(na + nb))].tolist()
        data = memoryview(data) if data is not None else b""
        self.groups += [bytes(data[x:y]) for x, y in zip(places, places[1:])]
        groups = np.diff(np.searchsorted(cut_a, np.cumsum(na), side="right"), prepend=0)
        # Between two neighbouring ends of either side lies one pair of overlapping tokens.
        every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two runs, merged
        every = every[np.append(True, every[1:] != every[:-1])] if len(every) else every
        met = a[np.searchsorted(ends_a, every)] * self.width + b[np.searchsorted(ends_b, every)]
        self.links = np.concatenate([self.links, met.astype(np.uint64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(na + nb - groups)])
        self.sizes = np.concatenate([self.sizes, np.stack([na, nb, groups, fits])], axis=1)
        self.chars += sum(map(len, segs))
        return [segs[i] for i in order]

    def texts(self, texts: list[str | None]):
        """Of each text: tokens a, tokens b, groups, hash of the groups; and sorted text * pairs + pair with its times, distinct."""
        if len(self.number) > KEPT_SEGMENTS or self.chars > KEPT_CHARS:
            self.forget()
        parts = [segments(t) if t else [] for t in texts]
        every = [s for p in parts for s in p]
        flat = list(map(self.number.get, every))
        fresh = list(dict.fromkeys([s for s, k in zip(every, flat) if k is None]))
        for k in range(0, len(fresh), 50_000):
            for s in self.learn(fresh[k : k + 50_000]):
                self.number[s] = len(self.number)
        flat = np.array(list(map(self.number.get, every)) if fresh else flat, np.int64)
        text = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        told = list(map(self.groups.__getitem__, flat.tolist()))
        ends = np.cumsum([0, *(len(p) for p in parts)]).tolist()
        fits = np.bincount(text, weights=1 - self.sizes[3, flat], minlength=len(texts)) == 0
        hashed = [hashlib.sha256(b"".join(told[x:y])[:-1]).hexdigest() if x < y and ok else "" for x, y, ok in zip(ends, ends[1:], fits.tolist())]
        on = fits[text]
        text, flat = text[on], flat[on]
        sums = [np.bincount(text, weights=s[flat], minlength=len(texts)).astype(np.int32) for s in self.sizes[:3]]
        many = self.first[flat + 1] - self.first[flat]
        at = np.repeat(self.first[flat] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs = np.uint64(len(self.bytes_a) * self.width)
        return sums, hashed, *np.unique(np.repeat(text, many).astype(np.uint64) * pairs + self.links[at], return_counts=True)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of equal rank side by side, which pack better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _of_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and their times, compressed."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=3).compress(_planes(steps) + _planes(times.astype(np.uint32)))


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // 12
    return np.cumsum(_of_planes(raw[: 8 * n], np.uint64), dtype=np.uint64), _of_planes(raw[8 * n :], np.uint32).astype(np.int64)


def packed_links(docs: DataFrame, byte_json: str, piece_model: bytes) -> DataFrame:
    """Rows of many documents each: their ids, sizes and hashes, and their links packed."""
    told = docs.sparkSession.sparkContext.broadcast((byte_json, piece_model))

    def rows(batches):
        both = Pair(*told.value)
        for batch in batches:
            column = batch.column("text")
            for start, n in chunks(column, 1_000_000):
                sums, hashed, keys, times = both.texts(column.slice(start, n).to_pylist())
                whole = [batch.column("doc_id").slice(start, n).to_pylist(), *(s.tolist() for s in sums), hashed, pack(keys, times), secrets.randbits(62)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, whole))], schema)

    names = ["ids", "n_a", "n_b", "n_groups", "groups_sha256", "links", "chunk"]
    of = lambda kind: pa.list_(kind)
    schema = pa.schema(list(zip(names, [of(pa.int64()), of(pa.int32()), of(pa.int32()), of(pa.int32()), of(pa.string()), pa.binary(), pa.int64()])))
    return docs.mapInArrow(lean(rows), _PACKED)


def pair_counts(packed: DataFrame, pairs: int) -> DataFrame:
    """pair, n: how many documents hold each pair linked."""

    def rows(batches):
        held, size = [], 0

        def summed():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, back, np.concatenate([c for _, c in held]))
            return keys, n

        def table(keys, n):
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].astype(np.int64)), pa.array(n[k : k + 100_000])], ["pair", "n"])

        for batch in batches:
            for packed in batch.column("links").to_pylist():
                keys, n = np.unique(unpack(packed)[0] % np.uint64(pairs), return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > COUNTED:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield from table(*held[0])
                        held, size = [], 0
        if held:
            yield from table(*summed())

    return packed.select("links").mapInArrow(lean(rows), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs and counts of the most frequent ones, at most ``most``, by ascending pair; whether there are others."""
    step = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(step.alias("n")).agg(F.count(F.lit(1)).alias("c"))
    rows = sorted(((r["n"], r["c"]) for r in sizes.collect()), reverse=True)  # at most 4,000 rows
    total, least = 0, None
    for n, c in rows:
        if total + c > most:
            break
        total, least = total + c, n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bool(rows)
    got = counts.where(step >= least).select("pair", "n").toArrow()  # bounded by ``most``
    pair, n = (got.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order], total < sum(c for _, c in rows)


def alignment(docs: DataFrame, byte_json: str, piece_model: bytes, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text).

    A is a byte-level BPE (its JSON) over a space and the text, B a piece BPE with byte fallback (its model) over
    the text, before which it sets a space itself; strings of special tokens are plain text. Tokens of both whose bytes
    overlap are linked. A pair's count is the number of rows that hold it linked; n_best are the links whose
    count is the highest of their A token, count_sum is the sum of counts over links.

    Defined cases: null and empty texts, and texts that the bytes of either tokenizer do not give back, have no tokens,
    zeros and an empty hash; rows that repeat count each; a null doc_id stays null; an empty table gives an empty
    result; texts of any length are read whole; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    size_a, size_b = max(pieces_of(byte_json)) + 1, len(piece_bytes(piece_model))
    pairs = size_a * size_b
    packed = stored(packed_links(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), byte_json, piece_model))
    counts = stored(pair_counts(packed, pairs))
    top = np.zeros(size_a, np.int64)
    best = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("n")).toArrow()  # bounded by the vocabulary
    top[best.column("a").to_numpy()] = best.column("n").to_numpy()
    frequent = _frequent(counts, most_pairs)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[0], frequent[1], top))

    def known(keys):
        """The counts of the pairs, 0 where every task has none."""
        pair, n, top = sent.value
        if not len(pair):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
        return np.where(pair[at] == keys, n[at], 0)

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, times = unpack(r["links"])
                text, keys = (keys // np.uint64(pairs)).astype(np.int64), (keys % np.uint64(pairs)).astype(np.int64)
                n = known(keys)
                begins = np.searchsorted(text, np.arange(len(r["ids"]) + 1))

                def by_text(x):
                    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
                    return pa.array(total[begins[1:]] - total[begins[:-1]])

                best = np.where((n > 0) & (n == sent.value[2][keys // size_b]), times, 0)
                m = len(r["ids"])
                sizes = [pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")]
                arrays = [pa.array(np.full(m, r["chunk"])), pa.array(np.arange(m, dtype=np.int32)), pa.array(r["ids"], pa.int64()), *sizes, by_text(times), by_text(best), by_text(n * times), pa.array(r["groups_sha256"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    told = packed.mapInArrow(lean(rows), _TOLD)
    if frequent[2]:
        told = _with_others(told, packed, counts, known, pairs, size_b, sent)
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_others(told, packed, counts, known, pairs, size_b, sent) -> DataFrame:
    """Adds what the pairs that are not in every task's table bring, joined by pair."""

    def rare(batches):
        for batch in batches:
            for chunk, links in zip(batch.column("chunk").to_pylist(), batch.column("links").to_pylist()):
                keys, times = unpack(links)
                text, keys = (keys // np.uint64(pairs)).astype(np.int32), (keys % np.uint64(pairs)).astype(np.int64)
                on = np.nonzero(known(keys) == 0)[0]
                for k in range(0, len(on), 100_000):
                    some = on[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(text[some]), pa.array(keys[some]), pa.array(times[some])], ["chunk", "place", "pair", "times"])

    def judged(batches):
        top = sent.value[2]
        for batch in batches:
            best = top[batch.column("pair").to_numpy() // size_b] == batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk", "place", "times", "n")), pa.array(best)], ["chunk", "place", "times", "n", "best"])

    links = packed.select("chunk", "links").mapInArrow(lean(rare), "chunk long, place int, pair long, times long").join(counts, "pair")
    links = links.select("chunk", "place", "pair", "times", "n").mapInArrow(judged, "chunk long, place int, times long, n long, best boolean")
    more = links.groupBy("chunk", "place").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    both = told.join(more, ["chunk", "place"], "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
