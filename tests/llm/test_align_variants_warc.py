"""Token alignment, spelling variants and archives: brute force, round trips, damage, edge cases."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailweave.llm import align, queries, variants, warc

TEXTS = [
    None, "", " ", "  ", "a", "one two", "one  two   three ", " leading", "tail ", "tail  ", "\n\n x\n y \n", "it's we'll", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marks ▁▁", "<|endoftext|>", "日本語のテキスト。 中文", "🙂🙂 emoji‍", "\x1c \x1f x", "x  y  z",
    "word " * 3, "word " * 3, "né éa çon" * 5, "0" * 300, "\x00 nul", "supercalifragilistic expialidocious words here", "tokenizers disagree about internationalization", "ａ full width", "a" + " " * 70 + "b", "The the THE " * 4000,
]


def _plain(text, byte_json=None, tools={}):
    """(tokens a with byte spans, tokens b with byte spans) of a whole text by the libraries."""
    if not tools:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        tools["a"] = Tokenizer.from_file(queries.tokenizer_path())
        tools["a"].encode_special_tokens = True
        tools["b"] = SentencePieceProcessor(model_proto=queries.piece_model())
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
        tools["alphabet"] = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    if not text:
        return [], []
    a = tools["a"].encode(" " + text, add_special_tokens=False).ids
    b = tools["b"].encode(text)
    bytes_a = [bytes(tools["alphabet"][c] for c in tools["a"].id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if tools["b"].is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tools["b"].id_to_piece(i)]]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], []

    def spans(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    return spans(a, bytes_a), spans(b, bytes_b)


def _brute_alignment(texts):
    per, held = [], Counter()
    for text in texts:
        a, b = _plain(text)
        links, j0 = [], 0
        for i, s, e in a:
            while j0 < len(b) and b[j0][2] <= s:
                j0 += 1
            for k, u, v in b[j0:]:
                if u >= e:
                    break
                links.append((i, k))
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for lo, hi in zip([0, *shared], shared):
            side = lambda t: ",".join(str(i) for i, s, e in t if s >= lo and e <= hi)  # noqa: E731, B023
            groups.append(f"{side(a)}|{side(b)}") if len(a) < 3000 else groups.append("")
        per.append((a, b, links, groups))
        held.update(set(links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for a, b, links, groups in per:
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashed))
    return out


@pytest.mark.parametrize("most_pairs", [1_000_000, 40, 0])
def test_alignment_equals_brute_force(spark, most_pairs):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "one two", 7), (3, "other text of one id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int")
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        got = align.alignment(docs.repartition(3), f.read(), queries.piece_model(), most_pairs).collect()
    want = _brute_alignment([t for _, t, _ in rows])
    key = lambda x: (x[0] is None, *map(str, x[:7]))
    told = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=key)
    said = sorted(((i, *w) for (i, _, _), w in zip(rows, want)), key=key)
    for x, y in zip(told, said, strict=True):
        assert x[:7] == y[:7]
        if y[1] < 3000:
            assert x[7] == y[7]


def test_segments_are_encoded_as_runs_and_alone_where_a_run_does_not_fit(monkeypatch):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        pair = align.Pair(f.read(), queries.piece_model())
    plain = [f"word{i}, it's" for i in range(1000)]
    odd = ["", "tail ", "\n", "ﬁ", "\u0301con", "½", "\x1f", "\u3000x", "日本語", "<s>", "plain"]
    encoded, many = align.Pair._encode_a, []
    monkeypatch.setattr(align.Pair, "_encode_a", lambda self, texts: many.append(len(texts)) or encoded(self, texts))
    pair.encoded(plain)
    assert sum(many) <= 10
    segs = plain[:300] + odd
    order, a, b, na, nb, fits = pair.encoded(segs)
    assert sorted(order) == list(range(len(segs)))
    x = y = 0
    for i, n, m, fit in zip(order, na.tolist(), nb.tolist(), fits.tolist()):
        want_a, want_b = (t[0] for t in (pair._encode_a([segs[i]]), pair._encode_b([segs[i]])))
        whole = all(b"".join(p[k] for k in w) == (" " + segs[i]).encode() for w, p in ((want_a, pair.bytes_a), (want_b, pair.bytes_b)))
        assert fit == whole and (a[x : x + n].tolist(), b[y : y + m].tolist()) == ((want_a, want_b) if whole else ([], []))
        x, y = x + n, y + m
    assert 0 in fits and (x, y) == (len(a), len(b))


def test_alignment_of_an_empty_table(spark):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), f.read(), queries.piece_model()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60))
def test_groups_close_at_shared_ends(x, y):
    ends = lambda sizes: [sum(sizes[: i + 1]) for i in range(len(sizes))]
    a, b = ends(x), ends(y)
    shared = sorted(set(a) & set(b))
    assert align.align(a, b) == ([a.index(e) + 1 for e in shared], [b.index(e) + 1 for e in shared])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'Z9.,é日🙂▁ \n\t  \x1c\x85"), max_size=40))
def test_segments_encode_as_their_text(text):
    if not text:
        return
    parts = align.segments(text)
    assert "".join(" " + p for p in parts) == " " + text and "" not in parts
    whole, split = _plain(text), [_plain(p) for p in parts]
    for side in (0, 1):
        assert [i for i, _, _ in whole[side]] == [i for s in split for i, _, _ in s[side]] or "▁" in text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**60), st.integers(1, 2**31)), max_size=50, unique_by=lambda x: x[0]))
def test_links_pack_reversibly(rows):
    import numpy as np

    rows.sort()
    keys, times = np.array([k for k, _ in rows], np.uint64), np.array([t for _, t in rows], np.int64)
    got = align.unpack(align.pack(keys, times))
    assert (got[0] == keys).all() and (got[1] == times).all()


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute_variants(counts, times_more):
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times_more * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def _variants(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


@pytest.mark.parametrize(("block", "seed"), [(8192, 1), (3, 2), (1, 3)])
def test_variants_equal_brute_force(spark, block, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    words = set(stems) | {"x" * 60, "x" * 61, "x" * 59 + "y", "a", "b", "ab", "ba", "ÿ×÷"}
    for s in stems:
        for _ in range(6):
            i = rng.randrange(len(s) + 1)
            words |= {s[:i] + rng.choice("abcéz") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcéz") + s[i + 1 :]}
    counts = {w: rng.choice([1, 2, 3, 10, 20, 30, 200, 2000]) for w in words if w}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert _variants(variants.variants_of(df, block=block)) == _brute_variants(counts, 10)


def test_variants_of_texts_with_damage_and_edges(spark):
    rng = random.Random(5)
    pool = ["running", "runnings", "Straßenbahn", "évènements", "évenements", "shorter", "x" * 4000, "thinking", "thinkng", "abcdefg", "abcdefgh"]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice(["", ",", "1", "日"]) for _ in range(40)), "extra") for i in range(120)]
    rows += [(None, "running running", "x"), (3, None, "x"), (4, "", "x"), (5, "12 34", "x"), (6, "thinking", "x"), (6, "thinking", "x")]
    counts = Counter()
    for i, text, _ in rows:
        for run in variants._WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(4))
    assert _variants(got) == _brute_variants(counts, 10)
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGES = [
    (1, "http://a/1", "x" * 200, 1), (2, "http://a/2", "x" * 200, 1), (3, "http://a/3", "é" * 99, 1), (4, "http://a/4", "é" * 49, 1), (5, "http://a/5", "é" * 49, 1), (6, None, None, 1), (7, "http://a/\r\nWARC-Type: response", "", 1),
    (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, 1), (9, "u", "long é " * 300_000, 1), (10, "v", "long é " * 300_000, 1), (3, "http://a/3", "é" * 99, 1), (3, "http://a/0", "é" * 99, 1), (None, "n", "x" * 200, 1), (None, "n", "y" * 100, 1), (None, "n", "y" * 100, 1), (-12, "m", "z" * 100, 1), (11, "m", "z" * 100, 1),
]


def test_archives_give_pages_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type int").repartition(4)
    folder = f"file:{tmp_path}/archives"
    read = warc.archive_pages(pages, folder, payload=True)
    rows = read.collect()
    assert len(rows) == len(PAGES) and not any(r.damage for r in rows)
    assert len({r.record_id for r in rows}) == len(PAGES)
    stored = {r.record_id: r.payload for r in rows if r.record_type == "response"}
    texts = Counter()
    for r in rows:
        payload = stored[r.record_id] if r.record_type == "response" else stored[r.refers_to]
        assert (r.payload is None) == (r.record_type == "revisit")
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        texts[payload.decode()] += 1
    assert texts == Counter((h or "") for _, _, h, _ in PAGES)
    told = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_digest(read).collect())
    assert told[(1, 200, "response", None)] == 1 and told[(2, 200, "revisit", 1)] == 1 and told[(None, 200, "revisit", 1)] == 1
    assert told[(3, 198, "response", None)] == 1 and told[(3, 198, "revisit", 3)] == 2
    assert told[(4, 98, "response", None)] == 1 and told[(5, 98, "response", None)] == 1 and told[(6, 0, "response", None)] == 1
    assert told[(None, 100, "response", None)] == 1 and told[(None, 100, "revisit", None)] == 1 and told[(-12, 100, "response", None)] == 1 and told[(11, 100, "revisit", -12)] == 1
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"{folder}-none").count() == 0


def test_each_record_is_a_member_and_files_roll(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", "resource", None, None, None, f"{i}".encode() * 500, None) for i in range(50)], warc.RECORD)
    spark.dataSource.register(warc.WarcSource)
    rows.coalesce(1).write.format("warc").option("fileBytes", "600").mode("append").save(str(tmp_path / "a"))
    files = [p for p in os.listdir(tmp_path / "a") if p.endswith(".gz")]
    assert len(files) > 3
    for name in files:
        raw = (tmp_path / "a" / name).read_bytes()
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(list(warc.records(io.BytesIO(raw), name, False)))
    (tmp_path / "a" / "records-of-a-lost-task.warc.gz").write_bytes(b"half a rec")
    assert {(r.record_id, bytes(r.payload)) for r in warc.read_records(spark, str(tmp_path / "a")).collect()} == {(f"r{i}", f"{i}".encode() * 500) for i in range(50)}
    one = warc.read_records(spark, str(tmp_path / "a" / files[0]), payload=False).collect()
    assert one and all(r.payload is None and r.damage is None for r in one)


def _record(i, payload=b"some payload"):
    return warc.record({"record_id": f"r{i}", "record_type": "response", "target_uri": "u", "refers_to": None, "http": "HTTP/1.1 200 OK | A: b", "payload": payload, "payload_digest": None}, "1970-01-01T00:00:00Z")


def test_damaged_records_are_told_and_stepped_over():
    whole = [warc.member(_record(i)) for i in range(6)]
    swapped = warc.member(_record(1).replace(b"some payload", b"Some payload"))
    short = warc.member(_record(2)[:-20])
    late = warc.member(_record(3) + b"more")
    torn = whole[4][: len(whole[4]) // 2]
    flipped = whole[5][:40] + bytes([whole[5][40] ^ 255]) + whole[5][41:]
    read = list(warc.records(io.BytesIO(b"".join([whole[0], swapped, short, late, whole[3], torn, whole[4], flipped, b"noise", whole[5], whole[0][:30]])), "f", True))
    fine = [r["record_id"] for r in read if not r["damage"]]
    assert fine == ["r0", "r3", "r4", "r5"]
    assert [r["damage"] for r in read if r.get("record_id") == "r1"] == ["the block's digest differs"]
    assert {"the record is shorter than its length", "the record does not end behind its block", "the file ends within a record"} & {r["damage"] for r in read}
    assert list(warc.records(io.BytesIO(b""), "f", True)) == []
    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(warc.member(_record(0, b"x" * 3_000_000))), "f", False)] == [3_000_000]
