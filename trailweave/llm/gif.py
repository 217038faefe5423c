"""GIF media columns: LZW code streams, palettes, disposal and transparency.

``decode`` reads any GIF87a or GIF89a file into timed frames on a canvas. Its LZW decoder reads all
codes up to the next clear code at once, as their widths follow from their places, and then joins the
runs they stand for. ``encode_all`` writes samples as frames of colours without loss, each frame's
stream with a growing dictionary, the frames of a batch of files step by step together; local
palettes, transparency and disposals take turns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

UNIT, ROWS, DELAY = 192, 64, 4
#: Levels of each of red, green and blue that histograms tell apart.
BINS = 4
_LEVEL = np.arange(256)
#: Sample i as a colour: three bits of red, three of green, two of blue; frames of odd number swap red and blue.
COLOURS = np.stack([(_LEVEL >> 5) * 36, (_LEVEL >> 2 & 7) * 36, (_LEVEL & 3) * 85], 1).astype(np.uint8)
#: Frames from the second on leave sample 0, which UTF-8 text hardly holds, clear; they are disposed of in turn.
CLEAR, DISPOSALS = 0, (1, 2, 3)


def _widths(depth: int, n: int) -> np.ndarray:
    """Bits of the code at each of n places behind a clear code: place k defines entry clear + 1 + k."""
    width = np.minimum(12, np.maximum(depth + 1, np.ceil(np.log2((1 << depth) + 2 + np.arange(n))).astype(np.int64)))
    width[:1] = depth + 1
    return width


def _places(depth: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of n codes behind a clear code and the bits at which they start."""
    width = _widths(depth, n)
    return width, np.concatenate([[0], np.cumsum(width)])


#: For the usual depths, more places than a dictionary has entries.
_PLACES = {depth: _places(depth, 1 << 13) for depth in range(2, 9)}


#: Entries of the tables of known runs, two bytes each, of frames that are encoded side by side.
SIDE_BY_SIDE = 1 << 26
#: Bytes of texts whose files are decoded together, one text at least.
DECODED_TOGETHER = 1 << 20


def lzw_encode(samples: np.ndarray, depth: int = 8) -> bytes:
    """The code stream of samples below 2**depth: the longest known run each time, cleared when the dictionary is full."""
    return lzw_encode_all([samples], depth)[0]


def lzw_encode_all(frames: list[np.ndarray], depth: int = 8) -> list[bytes]:
    """``lzw_encode`` of each frame; all frames take their steps together, as many as SIDE_BY_SIDE has room for."""
    streams: list[bytes] = [b""] * len(frames)
    used = [np.flatnonzero(np.bincount(x, minlength=1)) for x in frames]
    group, room = [], 0
    for i in sorted(range(len(frames)), key=lambda i: len(frames[i]), reverse=True):
        need = (len(used[i]) + min(4096, len(frames[i]))) * len(used[i])
        if group and room + need > SIDE_BY_SIDE:
            _encode_group(frames, group, used, depth, streams)
            group, room = [], 0
        group.append(i)
        room += need
    if group:
        _encode_group(frames, group, used, depth, streams)
    return streams


def _encode_group(frames: list[np.ndarray], group: list[int], used: list[np.ndarray], depth: int, streams: list[bytes]) -> None:
    """Code streams of the frames ``group``, longest first, one sample of each a step.

    Inside, a frame's samples are numbered from 0 in the order of ``used`` and longer runs from there
    on. Its table says at held run x samples + sample which number that longer run has, 0 if none.
    """
    sizes, kinds = np.array([len(frames[i]) for i in group]), np.array([len(used[i]) for i in group])
    steps, grown = int(sizes[0]), 4096 - (1 << depth) - 2
    samples = np.zeros((len(group), steps), np.uint8)
    for row, i in zip(samples, group):
        rank = np.zeros(256, np.uint8)
        rank[used[i]] = np.arange(len(used[i]))
        row[: len(frames[i])] = rank[frames[i]]
    samples = np.ascontiguousarray(samples.T)
    room = (kinds + np.minimum(4096, sizes)) * kinds
    begin = np.cumsum(room) - room
    known = np.zeros(int(room.sum()), np.uint16)
    going = len(group) - np.searchsorted(sizes[::-1], np.arange(steps), "right")
    free, limit, due = kinds.astype(np.uint16), kinds + grown, grown
    told, ends = np.zeros((steps, len(group)), np.uint16), np.zeros((steps, len(group)), bool)
    full: dict[int, list[int]] = {}
    held = samples[0].astype(np.uint16) if steps else np.zeros(0, np.uint16)
    last = held.copy()
    for t in range(1, steps):
        n = going[t]
        if n < len(held):
            last[n : len(held)] = held[n:]
            held, free = held[:n], free[:n]
        key = held * kinds[:n]
        key += begin[:n]
        key += samples[t, :n]
        code = known.take(key)
        new = np.equal(code, 0, out=ends[t, :n])
        told[t, :n] = held
        known[key] = np.where(new, free, code)
        free += new
        held = np.where(new, samples[t, :n], code)
        if t >= due:  # no dictionary is full before
            left = limit[:n] - free
            for i in np.flatnonzero(left == 0).tolist():
                full.setdefault(i, []).append(t)
                known[begin[i] : begin[i] + room[i]] = 0
                free[i], left[i] = kinds[i], grown
            due = t + int(left.min())
    last[: len(held)] = held
    told, ends, clear = np.ascontiguousarray(told.T), np.ascontiguousarray(ends.T), 1 << depth
    every, entries = _PLACES[depth][0], np.arange(clear + 2, 4096)
    begun, marks = np.array([depth + 1]), np.array([clear, clear + 1])
    all_codes, widths = [], []
    for i, g in enumerate(group):
        numbers = np.append(told[i][ends[i]], last[i : i + 1]) if sizes[i] else told[i, :0]
        codes = np.concatenate([marks[:1], np.concatenate([used[g], entries])[numbers], marks[1:]])
        if i in full:
            after = np.searchsorted(np.flatnonzero(ends[i]), full[i], "right") + 1
            codes = np.insert(codes, after, clear)
            places = np.diff([0, *(after + np.arange(len(after))), len(codes) - 1])
            widths += [begun, *(every[:n] for n in places)]
        else:
            widths += [begun, every[: len(codes) - 1]]
        all_codes.append(codes)
    packed = _packed(np.concatenate(all_codes), np.concatenate(widths), np.array([len(codes) for codes in all_codes]))
    for g, stream in zip(group, packed):
        streams[g] = stream


def _packed(codes: np.ndarray, widths: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bits of the codes, a new stream of whole bytes after every ``sizes`` of them."""
    at = np.cumsum(widths) - widths
    start = np.cumsum(sizes) - sizes
    bits = np.add.reduceat(widths, start)
    size = bits + 7 >> 3
    begin = np.cumsum(size) - size
    at += np.repeat(begin * 8 - at[start], sizes)
    word, byte = codes << (at & 7), at >> 3
    out = np.zeros(int(size.sum()) + 3, np.uint8)
    for shift in range(3):  # codes share a byte, but no bit
        out += np.bincount(byte + shift, word >> 8 * shift & 255, len(out)).astype(np.uint8)
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]


def _read(bits: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Codes of the given widths at the given bits; ``bits`` has 4 bytes of padding."""
    byte = at >> 3
    word = bits[byte].astype(np.uint32) | bits[byte + 1].astype(np.uint32) << 8 | bits[byte + 2].astype(np.uint32) << 16
    return ((word >> (at & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)


def lzw_decode(stream: bytes, depth: int, most: int) -> np.ndarray:
    """The samples of a code stream, ``most`` at most; a stream that ends early gives what it has.

    Raises ValueError on a code that is not defined yet.
    """
    return lzw_decode_all([(stream, depth, most)])[0]


def lzw_decode_all(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """``lzw_decode`` of each (stream, depth, most), all worked out together."""
    parts = [_runs(*x) for x in streams]
    samples = iter(_expand([run for some in parts for run in some], [1 << depth for (_, depth, _), some in zip(streams, parts) for _ in some]))
    return [np.concatenate([np.zeros(0, np.uint8), *(next(samples) for _ in some)])[:most] for (_, _, most), some in zip(streams, parts)]


def _runs(stream: bytes, depth: int, most: int) -> list[np.ndarray]:
    """A stream's codes between clear codes, none empty, up to its end or to ``most`` codes."""
    clear, end = 1 << depth, (1 << depth) + 1
    bits = np.frombuffer(stream + b"\0" * 4, np.uint8)
    total, at, parts, made = len(stream) * 8, 0, [], 0
    # Place k behind a clear code: entry clear + 1 + k is defined by it, so widths are fixed by place.
    width, starts = _PLACES[depth] if depth in _PLACES else _places(depth, 1 << 13)
    while made < most and at + depth + 1 <= total:
        if total - at >= starts[-1]:  # more codes than that, should a dictionary stay full
            width, starts = _places(depth, len(width) + (total - at) // 12 + 1)
        room = int(np.searchsorted(starts, total - at, "right") - 1)
        batch, seen = 5000, np.zeros(0, np.int64)
        while True:  # up to the next clear or end code
            lo, hi = len(seen), min(room, len(seen) + batch)
            fresh = _read(bits, at + starts[lo:hi], width[lo:hi])
            stop = np.flatnonzero((fresh == clear) | (fresh == end))
            seen = np.append(seen, fresh[: stop[0]] if len(stop) else fresh)
            if len(stop) or hi >= room:
                break
            batch *= 2
        if len(seen):
            parts.append(seen)
            made += len(seen)
        if not len(stop) or fresh[stop[0]] == end:
            break
        at += int(starts[len(seen) + 1])
    return parts


def _expand(runs: list[np.ndarray], clears: list[int]) -> list[np.ndarray]:
    """Samples of each run of codes between two clear codes.

    Entry clear + 2 + k stands for code k's samples and the first of code k + 1's, so all but single
    samples repeat earlier output and resolve by pointer doubling.
    """
    if not runs:
        return []
    sizes, codes = np.array([len(run) for run in runs]), np.concatenate(runs)
    start = np.cumsum(sizes) - sizes
    source, n = codes - np.repeat(np.array(clears) + 2, sizes), len(codes)
    first = np.repeat(start, sizes)
    if (source + first >= np.arange(n)).any() or (codes[start] >= clears).any():
        raise ValueError("a code is not defined yet")
    source = np.where(source >= 0, source + first, -1)
    # Length: one more than that of the code whose samples it begins with, found by doubling.
    length, up, on = np.ones(n, np.int64), source.copy(), np.flatnonzero(source >= 0)
    while len(on):
        add, further = length[up[on]], up[up[on]]
        length[on] += add
        up[on] = further
        on = on[further >= 0]
    begin = np.cumsum(length) - length
    kind = np.int32 if begin[-1] + length[-1] < 1 << 31 else np.int64
    back = np.where(source >= 0, begin - begin[source], 0).astype(kind)  # how far back a code's samples begin
    copied = np.arange(begin[-1] + length[-1], dtype=kind)
    copied -= np.repeat(back, length)
    while True:
        further = copied[copied]
        if (further == copied).all():
            break
        copied = further
    single = np.zeros(len(copied), np.uint8)
    single[begin] = np.where(source < 0, codes, 0)
    return np.split(single[copied], begin[start[1:]])


class Frame(NamedTuple):
    left: int
    top: int
    indices: np.ndarray  # as stored, rows in order
    canvas: np.ndarray  # height x width x 4, as shown
    delay: int  # hundredths of a second
    disposal: int


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


class Part(NamedTuple):
    """One frame as stored."""

    box: tuple[int, int, int, int]  # left, top, width, height
    interlaced: bool
    colours: np.ndarray | None
    stream: tuple[bytes, int, int]  # code stream, depth, number of samples
    delay: int
    disposal: int
    clear: int | None


def _parse(data: bytes) -> tuple[int, int, list[Part]]:
    """Width, height and frames as stored; raises ValueError on what is no GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 128:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    parts, delay, disposal, clear = [], 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            told, at = _blocks(data, at + 2)
            if label == 0xF9 and len(told) >= 4:
                disposal, delay = told[0] >> 2 & 7, told[1] | told[2] << 8
                clear = told[3] if told[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        *box, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if flags & 128:
            n = 2 << (flags & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        depth = data[at]
        stream, at = _blocks(data, at + 1)
        parts.append(Part(tuple(box), bool(flags & 64), colours, (stream, depth, box[2] * box[3]), delay, disposal, clear))
        delay, disposal, clear = 0, 0, None
    return width, height, parts


def decode(data: bytes) -> list[Frame]:
    return list(frames(data))


def frames(data: bytes):
    """Each frame with the canvas as shown after it; raises ValueError on what is no GIF."""
    return next(frames_all([data]))


def frames_all(files: list[bytes]):
    """``frames`` of each file; the streams of all are decoded together."""
    parsed = [_parse(data) for data in files]
    samples = iter(lzw_decode_all([part.stream for _, _, parts in parsed for part in parts]))
    for width, height, parts in parsed:
        yield _shown(width, height, parts, [next(samples) for _ in parts])


def _shown(width: int, height: int, parts: list[Part], samples: list[np.ndarray]):
    canvas = np.zeros((height, width), np.uint32)  # red, green, blue, opacity as bytes
    for part, got in zip(parts, samples):
        left, top, w, h = part.box
        indices = np.zeros(w * h, np.uint8)
        indices[: len(got)] = got
        indices = indices.reshape(h, w)
        if part.interlaced:  # rows came in four passes
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        before = canvas.copy() if part.disposal == 3 else None
        place = canvas[top : top + h, left : left + w]
        seen = indices[: place.shape[0], : place.shape[1]]
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        if part.colours is not None:
            table[: len(part.colours), :3] = part.colours
        shown = table.view(np.uint32).ravel()[seen]
        if part.clear is None:
            place[:] = shown
        else:
            np.copyto(place, shown, where=seen != part.clear)
        yield Frame(left, top, indices, canvas.copy().view(np.uint8).reshape(height, width, 4), part.delay, part.disposal)
        if part.disposal == 2:
            place[:] = 0
        elif part.disposal == 3:
            canvas = before


def encode(payload: bytes, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the payload, UNIT samples a row; its length is a positive multiple of UNIT."""
    return encode_all([payload], rows, delay)[0]


def encode_all(payloads: list[bytes], rows: int = ROWS, delay: int = DELAY) -> list[bytes]:
    """``encode`` of each payload."""
    samples = [np.frombuffer(p, np.uint8) for p in payloads]
    parts = [[x[at : at + rows * UNIT] for at in range(0, len(x), rows * UNIT)] for x in samples]
    streams = iter(lzw_encode_all([some for frames in parts for some in frames]))
    files = []
    for x, frames in zip(samples, parts):
        out = [b"GIF89a", struct.pack("<HHBBB", UNIT, min(rows, len(x) // UNIT), 0xF7, 0, 0), COLOURS.tobytes()]
        for i, some in enumerate(frames):
            stream = next(streams)
            padded = [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
            own = COLOURS[:, ::-1].tobytes() if i % 2 else b""
            control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, DISPOSALS[i % 3] << 2 | (i > 0), delay, CLEAR, 0)
            out += [control, struct.pack("<BHHHHB", 0x2C, 0, 0, UNIT, len(some) // UNIT, 0x87 if own else 0), own, b"\x08", *padded, b"\0"]
        files.append(b"".join([*out, b"\x3b"]))
    return files


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of shown samples by red, green and blue level; samples that nothing was drawn on are left out."""
    level = _LEVEL * bins >> 8
    code = (level * bins**2)[canvas[:, :, 0]] + (level * bins)[canvas[:, :, 1]] + level[canvas[:, :, 2]]
    return np.bincount(code[canvas[:, :, 3] > 0], minlength=bins**3)


def frames_of(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """key, frame, left, top, width, height, delay, disposal, shown_at (hundredths) and a histogram of each frame."""

    def rows(batches):
        for batch in batches:
            out = []
            for k, data in zip(batch.column(0), batch.column(1)):
                at = 0
                for i, f in enumerate(frames(data.as_py()) if data.is_valid else []):
                    out.append((k.as_py(), i, f.left, f.top, f.indices.shape[1], f.indices.shape[0], f.delay, f.disposal, at, histogram(f.canvas).tolist()))
                    at += f.delay
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema([(names[0], batch.schema.types[0]), *((n, pa.int32()) for n in names[1:-1]), (names[-1], pa.list_(pa.int64()))]))

    names = [key, "frame", "left", "top", "width", "height", "delay", "disposal", "shown_at", "histogram"]
    kind = dict(media.dtypes)[key]
    return media.select(key, column).mapInArrow(rows, f"`{key}` {kind}, " + ", ".join(f"`{n}` int" for n in names[1:-1]) + ", histogram array<bigint>")


def padded(text: bytes) -> bytes:
    """The text with spaces behind it, up to a positive multiple of UNIT bytes."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


_FIELDS = (
    ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"), ("n_frames", pa.int32(), "int"), ("duration", pa.int64(), "long"),
)


def _digest(text: bytes, media: bytes, shown_frames) -> tuple:
    read, crc, size, shown, n, lasts = hashlib.sha256(), b"", 0, np.zeros(BINS**3, np.int64), 0, 0
    for f in shown_frames:
        stored = f.indices.tobytes()
        read.update(stored)
        crc, size, n, lasts = stored[-16:], size + len(stored), n + 1, lasts + f.delay
        # Frames lie on the canvas from the top; what an earlier frame left below a short last one is not its own.
        shown += histogram(f.canvas[: f.indices.shape[0]])
    return len(text), size, read.hexdigest(), zlib.crc32(crc), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, shown.tolist())), n, lasts


def _store(text: pa.Array) -> pa.Array:
    texts, done = [t or b"" for t in text.cast(pa.binary()).to_pylist()], []
    media = encode_all([padded(t) for t in texts])
    for start, n in chunks(text, DECODED_TOGETHER):
        some = slice(start, start + n)
        done += map(_digest, texts[some], media[some], frames_all(media[some]))
    return pa.StructArray.from_arrays([pa.array([d[i] for d in done], kind) for i, (_, kind, _) in enumerate(_FIELDS)], [n for n, _, _ in _FIELDS])


def store_digest(docs: DataFrame) -> DataFrame:
    """doc_id and what was read back from each text's GIF: sizes, hashes, a colour histogram, frames.

    Defined cases: a null text is an empty one, and an empty one is stored as UNIT spaces; null ids
    pass through; repeated rows each get their row; an empty table gives an empty result; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    stored = F.arrow_udf(_store, "struct<" + ", ".join(f"{n}: {k}" for n, _, k in _FIELDS) + ">")
    return docs.select("doc_id", stored("text").alias("m")).select("doc_id", "m.*")


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as a GIF file."""
    made = F.arrow_udf(lambda t: pa.array(encode_all([padded(x or b"") for x in t.cast(pa.binary()).to_pylist()]), pa.binary()), "binary")
    return docs.select("doc_id", made("text").alias("media"))
