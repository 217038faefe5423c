"""Near duplicates, lattice tables, chat, mixing, sharding, extraction and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailweave.llm import chat, extract, lattice, mixing, near, queries, sharding
from trailweave.llm.components import components

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def _root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _groups(texts: dict):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((_root(parent, a), _root(parent, b)))
                    parent[y] = x
    return {d: (len(sets[d]), _root(parent, d)) for d in texts}


def _near_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, passage = [None, "", "  \t", "one two", "ONE  two", "one two three", "x" * 9], " ".join(word() for _ in range(60))
    base = [word() for _ in range(150)]
    for _ in range(60):  # near copies that link mostly through the centre
        w = base.copy()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base).upper(), "  ".join(base)] * 3
    for _ in range(40):  # a passage that many share
        texts.append(" ".join(word() for _ in range(rng.randint(5, 40))) + " " + passage)
    texts += [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(40)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("few", [2, 6])
def test_jaccard_components_equal_brute_force(spark, few):
    texts = _near_texts()
    rows = [(d, t, 1, 2) for d, t in texts.items()] + [(None, texts[7], 1, 2), (7, texts[7], 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int, component_id int").repartition(3)
    got = near.jaccard_components(df, few=few).collect()
    assert len(got) == len(rows)
    want = _groups(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_jaccard_empty_table(spark):
    assert near.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("edges_a_task", [7, 1000])
def test_components_of_paths_and_stars(spark, edges_a_task):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9), edges_a_task).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}


def test_lattice_decoder_is_nearest():
    rng, roots = np.random.default_rng(3), lattice.roots()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(1), 2)
    x = rng.normal(size=(500, 8)) * 2
    p = lattice.nearest_e8(x)
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()
    other = ((x[:, None] - p[:, None] - roots[None]) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= other + 1e-9).all()


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(800, 64)))
    o = rng.normal(size=a.shape)
    o = unit(o - (o * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * o
    tables = lattice.LatticeTables(64)
    found = (tables.cells(a) == tables.cells(b)[:, :, :1]).any(2).any(1)
    assert found.mean() >= 0.99


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 16))
    rows = [c + rng.normal(size=16) * s for c in centre for s in [0.05] * 30 + [0.2] * 6] + [rng.normal(size=16) for _ in range(60)]
    rows += [rows[3]] * 40 + [rows[3] * 2.5]
    vectors = [(i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    n = len(vectors)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0] * 15 + [None], 1), (n + 3, [1.0] * 15 + [float("nan")], 1), (n + 4, [float("inf")] + [1.0] * 15, 1), (n + 5, [1.0] * 3, 1), (n + 6, [], 1), (None, vectors[3][1], 1)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: r for r in lattice.near_vectors(df, block=16).collect()}
    m = np.array(rows)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.95) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None], n).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            break
        label = low
    assert [got[i].n_links for i in range(n)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == label.tolist()
    assert all(got[i].kept == (label[i] == i) for i in range(n))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _, _ in odd if i is not None)
    assert got[None].component_id is None and not got[None].kept
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_near_vectors_of_every_dimension(spark):
    rng = np.random.default_rng(9)
    rows = []
    for d, n in ((2, 6), (3, 2), (40, 12), (5, 3)):
        centre = rng.normal(size=d)
        rows += [centre + rng.normal(size=d) * 0.02 for _ in range(n)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()}
    unit = [v / np.linalg.norm(v) for v in rows]
    for i, v in enumerate(unit):
        near_by = [j for j, w in enumerate(unit) if len(w) == len(v) and w @ v >= 0.95]
        assert got[i] == (len(near_by) - 1, min(near_by))


def test_chat_reads_back_what_went_in(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [
        (-7, 0, "user", said, 1), (-7, 1, "assistant", said, 1), (1, 2, "assistant", "b\\\\#<\\l\\h", 1), (1, 1, "user", None, 1), (1, 3, None, "tail:\n</turn>\n### x:\n", 1),
        (2, 0, "system\n:\n#", "\n</turn>\n", 1), (None, 0, "assistant", "é🙂", 1), (3, 1, "assistant", "", 1), (3, 1, "assistant", "same turn", 1), (3, None, "user", "first", 1),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    examples = chat.chat_examples(df)
    got = {r.conv_id: r for r in chat.chat_digest(examples).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    chars = {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        told = "".join(f"{role}\n{text}\n" for _, role, text in ts)
        loss = "".join(text for _, role, text in ts if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(ts), sha(told), len(loss), sha(loss), chars[c])
    assert chat.chat_examples(df.limit(0)).collect() == []


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, "a" if i % 3 else rng.choice(["b", "c", None]), rng.randint(0, 40), 1) for i in range(3000)] + [(None, "d", 5, 1), (7, "a", 9, 1), (7, "a", 9, 1), (9001, "zero", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, taken int")
    out = mixing.fair_mix(df)
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.fair_mix(df.repartition(5)).collect()))
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, targets, budget = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        share = (budget - sum(targets.values())) / (sum(weights[s] for s in left) or 1)
        over = {s for s in left if weights[s] * share > 2 * sizes[s]}
        if not over:
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    targets |= {s: weights[s] * share for s in left}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 80 for s in names) and sum(taken.values()) <= budget
    order = [r.finish_time for r in mixing.mixed_stream(df).collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in got)
    assert mixing.fair_mix(df.limit(0)).collect() == []
    assert {r.taken for r in mixing.fair_mix(df.withColumn("size", F.lit(0).cast("long"))).collect()} == {0}


def test_shards_are_even_gapless_and_keep_groups_whole(spark):
    rng = random.Random(3)
    texts = ["w" * rng.randint(1, 400) + str(i) for i in range(600)] + ["same text " * 20] * 300 + [None, "", None, "x" * 60_000]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "no id", 9), (5, texts[5], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df).collect()
    assert len(got) == len(rows)
    slots, bins = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        bins[bytes(r.text_md5)].add(r.shard)
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(b) == 1 for b in bins.values()) and set(slots) <= set(range(16))
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df.repartition(7)).collect()))
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    alone = sorted(load.values())[:-2]
    assert max(alone) - min(alone) <= 0.02 * max(alone)
    assert sharding.shard(df.limit(0)).collect() == []


def _plain_best_fit(sizes, capacity):
    """Item by item: (size, bin) in order, and the room left in each bin."""
    rooms, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        b = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[b] -= s
        out.append((s, b))
    return out, rooms


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(9)
    for _ in range(50):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))]
        got = sharding.best_fit_decreasing(list(collections.Counter(sizes).items()), 60)
        assert [(s, b) for s in sorted(got, reverse=True) for b, k in got[s] for _ in range(k)] == _plain_best_fit(sizes, 60)[0]
    assert sharding.best_fit_decreasing([(61, 1)], 60) is None


def test_shards_are_those_of_best_fit_decreasing(spark):
    rng = random.Random(4)
    texts = [chr(97 + i % 26) * rng.randint(1, 30) + str(rng.randint(0, 50)) for i in range(700)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = collections.Counter(texts)
    sizes = [(len(t) + 1) * n for t, n in groups.items()]
    capacity = -(-sum(sizes) // 16)
    more = 0
    while len(_plain_best_fit(sizes, capacity + more)[1]) > 16:
        more = max(1, 2 * more)
    want = collections.Counter(_plain_best_fit(sizes, capacity + more)[0])
    placed = {r.text_md5: r.shard for r in got}
    mine = collections.Counter((sum(r.size for r in got if r.text_md5 == k), b) for k, b in placed.items())
    assert mine == want


_P = [
    "The river rose slowly through the night, and by morning the lower fields were under water again.",
    "Nobody in the village could remember a spring like it. The old mill stood in the middle of a lake, and people went to the shop by boat.",
    "A spokesman said that the dam would hold.", "By Friday the rain had stopped.",
    "Farmers counted their losses while the council met to decide what to rebuild first, which took most of the evening and pleased no one.",
]
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul>'
_REMARKS = '<div class="comments"><h3>Comments</h3><div class="comment"><p>I was there and it was bad.</p></div><div class="comment"><p>Great article, thanks for it!</p></div></div>'
_COOKIES, _FOOT = '<div class="cookie-banner">We use cookies to make this site better. <button>OK</button></div>', "<footer>&copy; 2024 River News. All rights reserved.</footer>"
_ADVERT, _SEARCH = '<div class="advert">Buy one pump, get one free!</div>', '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>'


def _hand_written():
    """(html, main blocks) of pages in many layouts."""
    paragraphs = "".join(f"<p>{x}</p>" for x in _P)
    table = "<table><tr><th>Year</th><th>Level</th></tr><tr><td>1999</td><td>3.2</td></tr><tr><td>2024</td><td>4.1</td></tr></table>"
    for head, title in (("", []), ("<h1>The spring flood</h1>", ["The spring flood"])):
        for body, told in (
            (head + paragraphs, title + _P),
            (head + "".join(f"<div>{x}</div>" for x in _P), title + _P),
            (head + f"<p>{_P[0]}</p>{table}<p>{_P[1]}</p><p>{_P[4]}</p>", title + [_P[0], "Year", "Level", "1999", "3.2", "2024", "4.1", _P[1], _P[4]]),
            (head + f"<p>{_P[0]}</p><h2>Afterwards</h2><ul><li>{_P[2]}</li><li>{_P[3]}</li></ul><blockquote>{_P[4]}</blockquote>", title + [_P[0], "Afterwards", _P[2], _P[3], _P[4]]),
        ):
            yield f"<html><body><nav>{_MENU}</nav><article>{body}</article>{_FOOT}</body></html>", told
            yield f'<body><div class="wrapper"><div class="top">{_MENU}</div><div class="inner">{body}</div></div></body>', told
            yield f'<body>{_COOKIES}<div id="xq7"><div class="rt">{_MENU}</div><main>{body}{_ADVERT}</main></div>{_REMARKS}{_FOOT}</body>', told
            yield f"<body><header>River News</header><table><tr><td>{_MENU}</td><td>{body}</td></tr></table>{_FOOT}</body>", told
            yield f'<body>{_SEARCH}<section class="zzt"><div class="p1">{body}</div></section><aside><h3>Popular</h3>{_MENU}</aside></body>', told


def test_extract_hand_written_pages():
    field = extract.fit_field(["alpha", "beta", "gamma", "delta", "word", "text", "and", "the", "of", "in"], 500)
    hits = found = wanted = 0
    for page, told in _hand_written():
        got = extract.main_text(page, field).split("\n\n")
        assert got != [""], page
        both = sum((collections.Counter(got) & collections.Counter(told)).values())
        hits, found, wanted = hits + both, found + len(got), wanted + len(told)
    assert 2 * hits / (found + wanted) > 0.95


def test_extract_takes_broken_pages_in_time():
    import time

    field = extract.ChainField()
    for page in ('<a "x ' * 100_000, "<a 'x " * 100_000, '<div class="a' * 50_000, "<!-" * 200_000, "<script " * 50_000):
        began = time.time()
        extract.main_text(page, field)
        assert time.time() - began < 10


def test_extract_finds_the_article(spark, data):
    field = extract.fit_field(["alpha", "beta", "gamma", "delta", "word", "text", "and", "the"], 300)
    held = extract.labelled_pages(["some", "other", "words", "here", "now"], 120, seed=77)
    wrong = total = 0
    for page, labels in held:
        got = field.decode(field.scores(extract.features(extract.blocks(page))))
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert wrong / total < 0.02
    d = spark.read.parquet(f"{data}/pages.parquet")
    for r in extract.extract(d, field).join(d.select("page_id", "html"), "page_id").collect():
        a = r.html
        inner = a[a.index("<article>") : a.index("</article>")]
        assert r.text == "\n\n".join(b.text for b in extract.blocks(inner)) and r.n_chars == len(r.text)


def test_extract_edge_cases(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "plain words &amp; &eacute; &#233;"), (4, "u", "<p>a < b <b>c<br>d</p><p>\u00a0</p>"), (None, "u", "<script>x<p>y</script><!-- <p>z -->"), (6, "u", "<p title='a>b'>x &lt;p&gt;" + "y" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    field = extract.ChainField(moves=np.zeros((2, 2)), first=np.array([0.0, 1.0]))
    field.weights[:, 1] = 1.0
    got = {r.page_id: r.text for r in extract.extract(df, field).collect()}
    assert got == {1: "", 2: "", 3: "plain words & é é", 4: "a < b c d", None: "", 6: "x <p>" + "y" * 100_000}
    assert extract.extract(df.limit(0)).collect() == []


def _chain_total(field, scores, path):
    return field.first[path[0]] + scores[0][path[0]] + sum(field.moves[a, b] + s[b] for a, b, s in zip(path, path[1:], scores[1:]))


def test_extract_viterbi_and_gradient():
    import itertools

    rng = np.random.default_rng(1)
    field = extract.ChainField(moves=rng.normal(size=(2, 2)), first=rng.normal(size=2))
    for n in range(1, 7):
        s = rng.normal(size=(n, 2))
        paths = list(itertools.product((0, 1), repeat=n))
        totals = np.array([_chain_total(field, s, p) for p in paths])
        assert tuple(field.decode(s)) == paths[totals.argmax()]
        odds = np.exp(totals - np.logaddexp.reduce(totals))
        one, _, _ = field.gradient(s, np.zeros(n, int))
        assert np.allclose([sum(o for p, o in zip(paths, odds) if p[i] == 1) for i in range(n)], -one[:, 1])


def test_pipeline_stages_take_effect(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    docs = rows
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < 4:
            assert out.columns == rows.columns, name
            out = out.checkpoint()
            if i < 3:
                assert out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        docs = out
    first = corpus_pipeline.STAGES[2][1](spark, rows, data)
    want = _groups({r.doc_id: r.text for r in rows.collect()})
    assert {r.doc_id for r in first.select("doc_id").collect()} == {d for d, (_, c) in want.items() if c == d}
    assert docs.count() > 0 and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_pipeline_stages_on_odd_rows(spark, data):
    names = ["budget", "source_rows", "taken", "score", "size", "component_id", "_skey", "told", "h", "statistics"]
    base = spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in base]
    rows += [(900001, None, None, None), (900002, "", "en", None), (None, rows[0][1], None, "web"), (None, None, None, None), rows[0], rows[0], (rows[1][0], "an other text of the same id as one before it here", "en", None)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names)
    docs = spark.createDataFrame([(*r, *range(7, 7 + len(names))) for r in rows], schema)
    given = {}
    for r in docs.collect():
        given[tuple(r)] = given.get(tuple(r), 0) + 1
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < 4:
            got = out.collect()
            assert out.columns == docs.columns and got
            most = 2 if i == 3 else 1
            for r in got:
                assert got.count(r) <= most * given[tuple(r)]
        else:
            assert out.count() == len(rows) and {r.budget for r in out.collect()} == {7}
        empty = stage(spark, docs.limit(0), data)
        assert empty.columns == out.columns and empty.count() == 0
    one = near.keep_one(docs)
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert kept.count(rows[0][:2]) == (1 if rows[0][0] == min(r[0] for r in rows if r[0] is not None and r[1] == rows[0][1]) else 0)
    assert (900001, None) in kept and (900002, "") in kept and kept.count((None, None)) == 1
    assert (rows[1][0], rows[-1][1]) in kept
    assert sorted(map(str, one.collect())) == sorted(map(str, near.keep_one(docs.repartition(3)).collect()))


def test_every_numbered_query_is_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
