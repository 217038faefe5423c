"""Language identification of mixed text: script ranges, word scores, Viterbi.

Each language has a model of the character n-grams of its words, hashed into a table of fixed size,
and the scripts that its letters are in. A word's letters name its script, which leaves only the
languages written in it; each of those scores the word by its n-grams. Viterbi over the words with a
penalty for every switch labels spans, and the language with most letters is the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARES, chunks, give_back, held_out, in_share, lean, small_batches
from .words import mix

UNKNOWN = "und"
#: Texts of each language that its model is learned from, at most; those with the least hashes of their ids.
MOST_TEXTS = 4_000
BUCKETS, SWITCH, SMOOTH = 1 << 16, 6.0, 0.5
#: Letters that a word's score weighs by, at most, so that one long run does not outvote a text; all its n-grams count in the mean.
MOST_LETTERS = 12
#: A script counts as a language's if it has that share of the language's letters.
LEAST_SHARE = 0.02

# First code points of ranges of letters, with the script of each range.
RANGES = (
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00AA, "Latin"), (0x00AB, ""), (0x00B5, "Greek"),
    (0x00B6, ""), (0x00BA, "Latin"), (0x00BB, ""), (0x00C0, "Latin"), (0x00D7, ""), (0x00D8, "Latin"), (0x00F7, ""), (0x00F8, "Latin"),
    (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, ""), (0x05D0, "Hebrew"), (0x05F3, ""),
    (0x0620, "Arabic"), (0x0660, ""), (0x066E, "Arabic"), (0x06D4, ""), (0x06D5, "Arabic"), (0x06F0, ""), (0x06FA, "Arabic"), (0x0700, ""),
    (0x0900, "Devanagari"), (0x0966, ""), (0x0971, "Devanagari"), (0x0980, "Bengali"), (0x09E6, ""), (0x09F0, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E50, ""), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, ""), (0x1780, "Khmer"), (0x17DD, ""),
    (0x1820, "Mongolian"), (0x18B0, ""), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, ""), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x3041, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, "Yi"), (0xA4D0, ""), (0xA640, "Cyrillic"),
    (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, ""),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFEFF, ""), (0xFF21, "Latin"), (0xFF3B, ""), (0xFF41, "Latin"),
    (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in RANGES))  # the first is no script
_SCRIPT = np.zeros(0x110000, np.uint8)
for (_first, _name), (_end, _) in zip(RANGES, (*RANGES[1:], (0x110000, ""))):
    _SCRIPT[_first:_end] = SCRIPTS.index(_name)
_GRAMS = (2, 3, 4)
_BASE = 0x9E3779B97F4A7C15


class Words:
    """The words of some texts: runs of letters, lower-cased; n-grams are taken of the distinct ones."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        script = _SCRIPT[points]
        letter = np.zeros(len(points) + 2, np.int8)
        letter[1:-1] = script > 0
        edge = np.diff(letter)
        starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        self.n_texts = len(texts)
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, begins)))
        # Distinct words by a polynomial hash of their code points.
        up, down = np.full(len(points) + 1, _BASE, np.uint64), np.full(len(points) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * np.cumprod(up)[:-1], out=sums[1:])
        _, one, self.word = np.unique((sums[stops] - sums[starts]) * np.cumprod(down)[starts], return_index=True, return_inverse=True)
        starts, self.letters = starts[one], (stops - starts)[one]
        self.script = script[starts].astype(np.int64)  # a word's script is that of its first letter
        # Their n-grams, an edge mark standing before and behind each word.
        length = self.letters + 2
        first = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(first, length)
        left = np.repeat(length, length) - place
        chars = points[np.minimum(np.repeat(starts, length) + np.maximum(place - 1, 0), max(0, len(points) - 1))].astype(np.uint64)
        chars[(place == 0) | (left == 1)] = 1
        self.grams, self.first = [], []  # by n: hashed n-grams word by word, and where each word's begin
        for n in _GRAMS:
            code = np.zeros(len(chars), np.uint64)
            for i in range(n):
                code[: len(chars) - n + 1] = code[: len(chars) - n + 1] * np.uint64(_BASE) + chars[i : len(chars) - n + 1 + i]
            code = code[left >= n]
            self.grams.append((mix(code) >> np.uint64(40)).astype(np.int64) % BUCKETS)
            self.first.append(np.append(0, np.cumsum(np.maximum(0, length - n + 1))))


def _of(column: pa.Array):
    for start, n in chunks(column, 1_000_000):
        yield start, n, Words([t or "" for t in column.slice(start, n).to_pylist()])


class LanguageModel:
    """Log-probabilities of hashed n-grams for each language, and its scripts."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = grams.sum(1, keepdims=True)
        self.logs = np.log((grams + SMOOTH) / (total + SMOOTH * BUCKETS)).T.astype(np.float32).copy() if langs else np.zeros((BUCKETS, 0), np.float32)
        self.written = scripts >= LEAST_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))

    def word_scores(self, words: Words) -> np.ndarray:
        """distinct words x languages: mean log-probability of a word's n-grams times its letters; hopeless where the script rules a language out."""
        sums, counts = np.zeros((len(words.letters), len(self.langs))), np.zeros(len(words.letters))
        for grams, first in zip(words.grams, words.first):
            have = np.nonzero(np.diff(first))[0]
            if len(have):
                sums[have] += np.add.reduceat(self.logs[grams], first[have])
                counts += np.diff(first)
        scores = sums / np.maximum(1, counts)[:, None] * np.minimum(words.letters, MOST_LETTERS)[:, None]
        may = self.written[:, words.script].T
        may[~may.any(1)] = True  # a script that no language was learned in says nothing
        return np.where(may, scores, -1e6)

    def label(self, words: Words) -> np.ndarray:
        """The language of each word by Viterbi within its text, all texts in step."""
        scores = self.word_scores(words)[words.word]
        counts = np.bincount(words.text, minlength=words.n_texts)
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")  # texts that still have words are a prefix
        live = np.searchsorted(-counts[order], -np.arange(1, counts.max(initial=0) + 1), "right")
        begin = first[order]
        came = np.zeros(scores.shape, np.int16)
        best = np.zeros((words.n_texts, len(self.langs)))
        stay = np.arange(len(self.langs), dtype=np.int16)
        for t, n in enumerate(live.tolist()):
            at = begin[:n] + t
            now = best[:n]
            switched = now.max(1, keepdims=True) - SWITCH
            jump = switched > now
            if jump.any():
                came[at] = np.where(jump, now.argmax(1)[:, None], stay)
                np.maximum(now, switched, out=now)
            else:
                came[at] = stay
            now += scores[at]
        state = best.argmax(1)
        out = np.zeros(len(scores), np.int64)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = begin[:n] + t
            out[at] = state[:n]
            state[:n] = came[at, state[:n]]
        return out


def learn(docs: DataFrame, most_texts: int = MOST_TEXTS) -> LanguageModel:
    """A model of ``docs`` (doc_id, text, lang); rows without a language teach nothing."""
    known = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(counts)
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, int(SHARES * min(1.0, most_texts / counts[lang]))))) if langs else None
    some = known.where(in_share(F.xxhash64(F.lit(9), "doc_id"), share[F.col("lang")])) if langs else known

    def count(batches):
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for start, n, words in _of(batch.column("text")):
                of = lang[start : start + n]
                often = np.bincount(of[words.text] * len(words.letters) + words.word, minlength=len(langs) * len(words.letters)).reshape(len(langs), -1)
                for k in range(len(langs)):
                    scripts[k] += np.bincount(words.script, weights=words.letters * often[k], minlength=len(SCRIPTS)).astype(np.int64)
                    for g, first in zip(words.grams, words.first):
                        grams[k] += np.bincount(g, weights=np.repeat(often[k], np.diff(first)), minlength=BUCKETS).astype(np.int64)
        both = np.concatenate([grams, scripts], 1).ravel()
        used = np.nonzero(both)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(both[used])], ["cell", "n"])

    width = BUCKETS + len(SCRIPTS)
    got = some.select("text", "lang").mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # of fixed size
    both = np.zeros(len(langs) * width)
    both[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    both = both.reshape(len(langs), width)
    return LanguageModel(langs, both[:, :BUCKETS], both[:, BUCKETS:])


def spans(model: LanguageModel, texts: list[str]) -> list[list[tuple[str, int]]]:
    """For each text its runs of words of one language: (language, words)."""
    words = Words(texts)
    label = model.label(words) if model.langs else np.zeros(0, np.int64)
    out: list = [[] for _ in texts]
    for text, lang in zip(words.text.tolist(), label.tolist()):
        mine = out[text]
        name = model.langs[lang]
        if mine and mine[-1][0] == name:
            mine[-1] = (name, mine[-1][1] + 1)
        else:
            mine.append((name, 1))
    return out


def _predict(model: LanguageModel, column: pa.Array) -> pa.Array:
    names, scores = [], []
    for _, n, words in _of(column):
        k = len(model.langs)
        if not k:
            names += [UNKNOWN] * n
            scores += [0.0] * n
            continue
        letters = np.bincount(words.text * k + model.label(words), weights=words.letters[words.word], minlength=n * k).reshape(n, k)
        total, top = letters.sum(1), letters.argmax(1)
        names += [model.langs[j] if x else UNKNOWN for j, x in zip(top.tolist(), total.tolist())]
        scores += (letters.max(1) / np.maximum(1, total)).tolist()
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])


def identify(docs: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang) plus held_out, lang_pred and score.

    Learns from rows that are not held out and have a language; the prediction depends on the text
    alone. The score is the share of the text's letters in spans of the language predicted.

    Defined cases: a text that is null or has no letter, and any text if nothing could be learned,
    is ``und`` with score 0; ties go to the first language by code point; a null doc_id is not held
    out; repeated rows each get their row; an empty table gives an empty result; columns named like
    those added are replaced.
    """
    docs = docs.drop("held_out", "lang_pred", "score", "_found")
    small_batches(docs.sparkSession)
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), most_texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pa.Array) -> pa.Array:
        told = _predict(shared.value, text)
        give_back()
        return told

    found = F.arrow_udf(predict, "struct<lang_pred: string, score: double>")
    return docs.withColumn("held_out", held_out()).withColumn("_found", found("text")).select(*docs.columns, "held_out", "_found.lang_pred", "_found.score")
