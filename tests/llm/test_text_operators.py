"""Quality, language, BPE and media operators: brute force, round trips, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.llm import bpe, gif, langid, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, score int, statistics int"
LONG = "wörter and more, 12345 <|endoftext|> \u00a0\u2003x" * 3000
TEXTS = [
    None, "", " ", "\n\n \t", "one", "one  two   three ", "it's we'll I'd", "<|endoftext|>", "a<|endoftext|> b", "日本語のテキスト。 中文", "🙂🙂 emoji\u200d", "tab\tnew\r\nline ", "x\u00a0 y\u00a0\u2003 z",
    "don't\u2019s \u0301combining", "ends with spaces   ", "ABC!! DEF!! GHI!!", "ABC!! DEF!! GHI!!", "\u180e mongolian \u180e", "0" * 500, "\x00\x1f\x7f\x85next", LONG,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, 1, 2), (3, "\n\n \t", "en", "s", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def _tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    told = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()


@pytest.mark.parametrize("sample", [0, 100])
def test_bpe_equals_the_library_wherever_words_are_encoded(docs, sample):
    got = bpe.encode_digest(docs, queries.tokenizer_path(), sample_texts=sample)
    assert "text" not in got.columns and "score" in got.columns
    rows = got.collect()
    assert len(rows) == docs.count()
    texts = {(i): t for i, t in enumerate(TEXTS)} | {None: "no id"}
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _tokens(texts[r.doc_id]), texts[r.doc_id]


def test_bpe_random_unicode(spark):
    rng = random.Random(4)
    pools = ["abc XYZ 019'.,!?", " \t\n\u00a0\u2002", "éüßñçœ", "日本語中文한국어", "абвгд", "🙂🎉\u200d\ufe0f", "\u0300\u0301", "٣٤५६", "ⅷ½²"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_digest(df, queries.tokenizer_path(), sample_texts=200).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == _tokens(t), t


def test_bpe_ids_decode_to_the_text(docs):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = bpe.encode(some, queries.tokenizer_path())
    back = {r.doc_id: r.text for r in bpe.decode(ids, queries.tokenizer_path()).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_bpe_keeps_texts_without_id_apart_where_their_short_hashes_meet(spark):
    texts = ["zq1166", "zq101096", "zq1166"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert df.select(F.hash("doc_id", "text")).distinct().count() == 1
    got = bpe.encode_digest(df, queries.tokenizer_path(), sample_texts=0).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(_tokens(t) for t in texts)


def test_bpe_repeated_rows_cost_no_more_than_their_number(spark):
    rows = [(None, "zq88267 never common"), (None, "zq289600 never common")] * 2000 + [(7, "w" * 100_000), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = bpe.encode_digest(df, queries.tokenizer_path(), sample_texts=0).collect()
    told = {_tokens(t) for t in {t for _, t in rows}}
    assert len(got) == len(rows) and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == told


def test_bpe_common_table_is_bounded_in_bytes(spark):
    texts = ["長" * 2000 + str(i) for i in range(50)] + ["short words here"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        told = f.read()
    table = bpe._common(df, told, 1000, 100, 20_000)
    assert table.column("word").to_pylist() == [b" here", b" words", b"short"]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(df, queries.tokenizer_path(), common_bytes=20_000).collect()}
    assert got == {i: _tokens(t) for i, t in enumerate(texts)}


def test_bpe_worker_keeps_one_table_and_digests_some_texts_at_a_time(monkeypatch):
    import zstandard

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        told = f.read()
    common, rare = ["one", " two", " three"], [" rarely", " seldomly"]
    bpe._once(bpe._packed(pa.chunked_array([pa.array([w.encode() for w in common])])), bpe._table_of_words)
    ids = bpe.encode_words(told, common)
    assert len(bpe._KEPT) == 1  # the tokenizer, no table of words beside it
    late = [np.array(x, "<u2").tobytes() for x in bpe.encode_words(told, rare)]
    texts = [[0, 1, 3], [], [2], [3, 3, 0], [0, 1, 2, 1, 2, 1], [3]]  # 3 stands for a word that the table lacks
    rows, whole, met = [], [], 0
    for k, text in enumerate(texts):
        planes = np.array(text, "<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
        rows.append((k, k, -1, bytes(8) + zstandard.compress(planes)))
        words = []
        for at, n in enumerate(text):
            if n == 3:
                rows.append((k, k, at, late[met % 2]))
                met += 1
            words.append(common[n] if n < 3 else rare[(met - 1) % 2])
        whole.append("".join(words))
    t = pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["_k1", "_len", "at", "told"])
    by_id = bpe.pieces_of(told)
    pieces = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())
    names = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
    monkeypatch.setattr(bpe, "_AT_ONCE", 3)
    made = list(bpe._digested(t, pa.array(ids, pa.list_(pa.int32())), pieces, names, "<u2"))
    assert [b.num_rows for b in made] == [1, 3, 1, 1]
    got = [(r["n_tokens"], r["ids_sha256"].hex(), r["decoded_sha256"].hex()) for b in made for r in b.to_pylist()]
    assert got == [_tokens(w) for w in whole]


def test_bpe_empty_table(spark):
    assert bpe.encode_digest(spark.createDataFrame([], SCHEMA), queries.tokenizer_path()).collect() == []


def test_quality_separates_held_out_rows(spark, data):
    d, lab = spark.read.parquet(f"{data}/../sf0.01/documents.parquet"), spark.read.parquet(f"{data}/../sf0.01/labels.parquet")
    got = quality.score_quality(d.select("doc_id", "text"), lab).join(lab, "doc_id").where("held_out")
    good, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert n > 50 and good / n > 0.93


def test_quality_edge_cases(spark, docs):
    one_sided = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, one_sided).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 1 for r in got)
    none = quality.score_quality(docs, one_sided.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), one_sided).collect() == []
    assert quality.keep_quality(docs, one_sided).columns == docs.columns
    same = {r.score for r in got if r.doc_id in (15, 16)}
    assert len(same) == 1
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def _plain_statistics(text):
    """The statistics one by one, from their definitions."""
    import re

    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    low = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]
    lines = [x for x in b.split(b"\n") if x]
    marks = set(b"#$%&*+/<=>@[\\]^_`{|}~")
    size, n = max(1, len(b)), max(1, len(words))
    repeats = lambda x: (len(x) - len(set(x))) / max(1, len(x))
    of = lambda kind: sum(c in kind for c in b) / size
    count = lambda w, kind: sum(c in kind for c in w)
    mark = [count(w, marks | {33}) for w in words]
    return [
        len(words), sum(map(len, words)) / n, sum(len(w) > 15 for w in words) / n, of(range(65, 91)), of(range(48, 58)), of(marks), of(set(b"!\"'(),-.:;?")), of({32, *range(9, 14)}), of(range(128, 256)),
        size / (1 + b.count(b"\n")), repeats(low), repeats(list(zip(low, low[1:]))), repeats(lines),
        sum(count(w, range(65, 91)) > 1 and not count(w, range(97, 123)) for w in words) / n, sum(0 < m < len(w) for m, w in zip(mark, words)) / n, sum(m == len(w) for m, w in zip(mark, words)) / n, len(set(b)),
    ]


def test_quality_statistics_and_score_equal_plain_python(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(300)
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*TEXTS, "a\nb\na\n", "a\nb\na", "x " * 200_000, "y" * 300_000, "\n" * 9])], "doc_id long, text string")
    got = d.unionByName(odd).withColumn("s", quality.text_statistics("text")).collect()
    for r in got:
        assert np.allclose(r.s, _plain_statistics(r.text)), (r.doc_id, r.text[:80])
    rng = np.random.default_rng(2)
    x = np.array([r.s for r in got])
    model = quality.fit_rules(x, (x[:, 0] + rng.normal(0, 20, len(x)) > 100).astype(int))
    assert len(model.rules) > 3
    scored = d.unionByName(odd).withColumn("s", quality.text_statistics("text")).select("s", model.column("s").alias("p")).collect()
    for r in scored:
        total = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(r.s[k] <= at if op == "<=" else r.s[k] > at for k, op, at in rule))
        assert np.isclose(r.p, 1 / (1 + np.exp(-total)))


def test_quality_rules_are_paths_and_lasso_leaves_few():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.3)).astype(int)
    model = quality.fit_rules(x, y)
    assert all(len({(k, op) for k, op, _ in rule}) == len(rule) <= quality.DEPTH for rule in model.rules)
    assert 0 < len(model.rules) < len(quality.grow_rules(x, y)) / 2
    assert {k for k, _, _ in model.rules[np.argmax(np.abs(model.weights))]} & {2, 5}
    again = quality.fit_rules(x, y)
    assert again.told() == model.told()
    ties = quality.fit_rules(np.ones((50, len(quality.STATISTICS))), np.arange(50) % 2)  # nothing to split on
    assert ties.rules == [] and abs(ties.intercept) < 1e-9


def test_language_of_held_out_rows_and_edge_cases(spark, data):
    d = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    got = langid.identify(d.select("doc_id", "text", "lang")).where("held_out")
    good, n = got.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert good / n > 0.97
    rows = [(1000000 + i, t, None) for i, t in enumerate([None, "", "12 !?", "the"])] + [(0, "the thing and of", "en"), (1, "το και για με", "el"), (4, "die der und sich", "de"), (None, "και", None)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(7)).withColumn("_found", F.lit(1))
    got = langid.identify(few).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by[1000000 + i] for i in range(3)] == [("und", 0.0)] * 3
    assert by[None] == ("el", 1.0) and by[1000003][0] in ("en", "de")
    nothing = langid.identify(few.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(few.limit(0)).collect() == []


def _viterbi(scores, switch):
    best, came = scores[0].copy(), []
    for s in scores[1:]:
        ways = best[:, None] - switch * (1 - np.eye(len(best)))
        came.append(ways.argmax(0))
        best = ways.max(0) + s
    path = [int(best.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return best.max(), path[::-1]


def test_language_viterbi_finds_best_paths():
    model = langid.LanguageModel(["a", "b", "c"], np.random.default_rng(1).integers(0, 50, (3, langid.BUCKETS)).astype(float), np.ones((3, len(langid.SCRIPTS))))
    texts = ["", "one two three four five six", "x", "yes " * 40, "1 2 3"]
    words = langid.Words(texts)
    label, scores = model.label(words), model.word_scores(words)[words.word]
    for i in range(len(texts)):
        mine = np.nonzero(words.text == i)[0]
        if len(mine):
            value, _ = _viterbi(scores[mine], langid.SWITCH)
            path = label[mine]
            assert np.isclose(scores[mine, path].sum() - langid.SWITCH * (np.diff(path) != 0).sum(), value)


def _lzw(samples, depth, clear_at):
    """A plain encoder with a dictionary, for the decoder to read."""
    clear, bits, out = 1 << depth, depth + 1, []

    def emit(code):
        out.extend(code >> i & 1 for i in range(bits))

    table, free, held = {(i,): i for i in range(clear)}, clear + 2, ()
    emit(clear)
    for s in map(int, samples):
        if (*held, s) in table:
            held = (*held, s)
            continue
        emit(table[held])
        if free < 4096:
            table[(*held, s)], free = free, free + 1
            if free - 1 == 1 << bits and bits < 12:
                bits += 1
        if free >= clear_at:
            emit(clear)
            table, free, bits = {(i,): i for i in range(clear)}, clear + 2, depth + 1
        held = (s,)
    if held:
        emit(table[held])
    if free == 1 << bits and bits < 12:
        bits += 1
    emit(clear + 1)
    return np.packbits(np.array(out, np.uint8), bitorder="little").tobytes()


def test_gif_lzw_round_trips():
    rng = np.random.default_rng(5)
    for _ in range(120):
        depth = int(rng.integers(2, 9))
        x = rng.integers(0, int(rng.integers(1, (1 << depth) + 1)), int(rng.integers(0, 6000))).astype(np.uint8)
        for stream in (_lzw(x, depth, int(rng.choice([700, 4096, 10**9]))), gif.lzw_encode(x, depth)):
            assert (gif.lzw_decode(stream, depth, len(x)) == x).all()
    with pytest.raises(ValueError):
        gif.lzw_decode(np.packbits(np.array([0, 0, 1, 0, 1, 1], np.uint8), bitorder="little").tobytes(), 2, 9)


def _frame(left, top, w, h, indices, disposal, clear=None, delay=3, interlaced=False, local=None):
    import struct

    flags = disposal << 2 | (clear is not None)
    out = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay, clear or 0, 0)
    out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, (64 if interlaced else 0) | (0x81 if local else 0)) + (local or b"")
    stream = gif.lzw_encode(np.array(indices, np.uint8), 2)
    return out + bytes([2, len(stream)]) + stream + b"\0"


def test_gif_palettes_disposal_transparency():
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80 | 1, 0, 0) + palette
    body = _frame(0, 0, 2, 2, [1, 1, 1, 1], 1) + _frame(0, 0, 1, 1, [2], 3) + _frame(1, 1, 1, 1, [0], 2, clear=0) + _frame(0, 0, 1, 2, [3, 2], 0, interlaced=True, local=palette[::-1])
    frames = gif.decode(head + b"\x21\xfe\x02hi\0" + body + b"\x3b")
    seen = [f.canvas[:, :, :3].tolist() for f in frames]
    red, green = [255, 0, 0], [0, 255, 0]
    assert seen[0] == [[red, red], [red, red]]
    assert seen[1] == [[green, red], [red, red]]
    assert seen[2] == [[red, red], [red, red]]  # put back, and the clear sample draws nothing
    assert frames[3].canvas[1, 1, 3] == 0  # the third frame's place was cleared
    assert [f.delay for f in frames] == [3] * 4
    with pytest.raises(ValueError):
        gif.decode(b"PNG")


def _unlzw(stream, depth):
    """A plain decoder: one code at a time."""
    bits, at, width, clear = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little").tolist(), 0, depth + 1, 1 << depth
    table, out, last = [], bytearray(), None
    while True:
        code = sum(b << k for k, b in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], depth + 1, None
            continue
        if code == clear + 1:
            return bytes(out)
        run = table[code] if code < len(table) else last + last[:1]
        out += run
        if last is not None and len(table) < 4096:
            table.append(last + run[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        last = run


def test_gif_streams_grow_a_dictionary_that_a_plain_decoder_reads():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 500, 12_288, 40_000):
        x = rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), n)
        stream = gif.lzw_encode(x)
        assert _unlzw(stream, 8) == x.tobytes()
        assert n < 500 or len(stream) < 0.8 * n
    media = gif.encode(gif.padded(b"many words, many frames " * 4000))
    kinds = [(f.disposal, f.delay) for f in gif.frames(media)]
    assert {d for d, _ in kinds} == {1, 2, 3} and len(kinds) > 6
    shown = [f.canvas[0, 0, :3].tolist() for f in gif.frames(media)][:2]
    assert shown[0] == gif.COLOURS[ord("m")].tolist() and shown[1] != shown[0]  # the second has its own palette


def test_gif_frames_side_by_side_are_those_alone(monkeypatch):
    rng = np.random.default_rng(7)
    frames = [rng.choice(np.frombuffer(b"etaoin shrdlu\xc3\xa9", np.uint8), n) for n in (0, 1, 3000, 12_288, 2, 25_000, 3000, 0)]
    alone = [gif.lzw_encode(x) for x in frames]
    assert [_unlzw(stream, 8) for stream in alone] == [x.tobytes() for x in frames]
    for room in (1, 1 << 18, 1 << 26):
        monkeypatch.setattr(gif, "SIDE_BY_SIDE", room)
        assert gif.lzw_encode_all(frames) == alone
    together = gif.lzw_decode_all([(stream, 8, len(x)) for stream, x in zip(alone, frames)])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(together, frames))
    assert gif.encode_all([]) == [] and gif.lzw_encode_all([]) == [] and list(gif.frames_all([])) == []
    assert len(gif._store(pa.array([], pa.string()))) == 0 and gif._store(pa.array([None, ""])).to_pylist()[0]["n_bytes"] == 0


def test_gif_store_digest(spark, docs):
    got = gif.store_digest(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            text = (TEXTS[r.doc_id] or "").encode()
            payload = text.ljust(max(1, -(-len(text) // 192)) * 192, b" ")
            media = gif.encode(payload)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
            assert sum(map(int, r.feature.split(","))) == len(payload) and r.duration == gif.DELAY * r.n_frames
    frames = gif.frames_of(gif.as_media(docs.where("doc_id = 20")), "doc_id").collect()
    assert [f.frame for f in frames] == list(range(len(frames))) and len(frames) > 2 and frames[1].shown_at == gif.DELAY
    assert gif.store_digest(spark.createDataFrame([], SCHEMA)).collect() == []
