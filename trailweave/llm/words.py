"""Words and shingles of many texts at once, as arrays over their joined bytes.

A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums and mixed; a
shingle's hash is a polynomial of its words' hashes. Two different shingles of one pair of documents
share a hash with a chance of about 2**-64 for each pair of them.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that running sums are taken over at a time, so that memory follows the number of spans.
_BLOCK = 1 << 15


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
_BLOCK_UP, _BLOCK_DOWN = (np.uint64(pow(int(b), _BLOCK, 1 << 64)) for b in (_BASE, _INVERSE))


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many lie before each text's start (one entry more than texts)."""
    inside = ~SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    cuts = np.zeros(len(data) + 1, bool)
    cuts[ends] = True  # words do not reach from one text into the next
    starts = np.nonzero(inside & (~before[:-1] | cuts[:-1]))[0]
    stops = np.nonzero(inside & (~np.append(inside[1:], False) | cuts[1:]))[0] + 1
    return starts, stops, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; starts and stops ascend."""
    at_start, at_stop = np.zeros(len(starts), np.uint64), np.zeros(len(stops), np.uint64)
    blocks = len(data) // _BLOCK + 1
    scales = _powers(_BLOCK_UP, blocks)
    carry = np.zeros(1, np.uint64)
    edges = np.arange(blocks + 1) * _BLOCK
    sides = [(out, places, np.searchsorted(places, edges)) for out, places in ((at_start, starts), (at_stop, stops))]
    for k in range(blocks):
        part = data[edges[k] : edges[k + 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
        sums *= scales[k]
        for out, places, cuts in sides:
            out[cuts[k] : cuts[k + 1]] = sums[places[cuts[k] : cuts[k + 1]] - edges[k]] + carry
        carry += sums[-1:]
    return mix((at_stop - at_start) * _DOWN[starts % _BLOCK] * _powers(_BLOCK_DOWN, blocks)[starts // _BLOCK])


def shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, side by side, and where each text's begin (one entry more)."""
    data = LOWER[data]
    starts, stops, first = word_spans(data, ends)
    words = span_hashes(data, starts, stops)
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(counts)), made)
    word = first[:-1][text] + np.arange(begins[-1]) - begins[:-1][text]
    width = np.minimum(counts, size)[text]
    hashes = np.zeros(len(text), np.uint64)
    for i in range(size):
        on = i < width
        hashes[on] = hashes[on] * _STEP + words[word[on] + i]
    hashes = mix(hashes + width.astype(np.uint64))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[fresh], np.searchsorted(text[fresh], np.arange(len(counts) + 1))
