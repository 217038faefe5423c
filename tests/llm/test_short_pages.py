"""Main text of pages with few blocks, links, other scripts, notes inside and long comments; names that operators use inside; ids that repeat."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trailweave.llm import bpe, extract, lattice, near, quality, queries
from trailweave.llm.common import SHARES, in_share


@pytest.fixture(scope="module")
def field_and_words(data):
    rng = random.Random(1)
    said = sorted({w for h in pq.read_table(f"{data}/pages.parquet", columns=["html"]).column("html").to_pylist() for b in extract.blocks(h or "") for w in b.text.split()})
    words = sorted(rng.sample(said, min(5000, len(said))))
    return extract.fit_field(words), words


def _cases(words, seed):
    rng = random.Random(seed)
    p = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    unspaced = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) + "。"
    a, b, c, e, y, z = p(30), p(45), p(12), p(60), unspaced(90), unspaced(60)
    foot, nav = f"<footer>&copy; 2024 {p(4)}</footer>", f"<nav><ul><li><a href=/>Home</a></li><li><a href=/x>{p(2)}</a></li></ul></nav>"
    side = f'<aside class="sidebar"><h3>{p(2)}</h3><p>{p(10)}</p></aside>'
    comments = '<div class="comments"><h3>Comments</h3>' + "".join(f'<div class="comment"><p>{p(40)}</p></div>' for _ in range(5)) + "</div>"
    page = lambda inner: f"<html><body>{inner}</body></html>"
    return [
        (page(f"<main><p>{a}</p></main>{foot}"), [a]), (page(f"<p>{a}</p><p>{b}</p>"), [a, b]), (page(f"<p>{e}</p>"), [e]), (a, [a]), (page(e), [e]), (page(f"<div><p>{z}</p></div>{foot}"), [z]),
        (page(f"{nav}<article><h1>{unspaced(9)}</h1><p>{y}</p><p>{z}</p></article>{foot}"), [y, z]), (page(nav + "<article>" + "".join(f"<p><a href=/l{i}>{x}</a></p>" for i, x in enumerate((a, b, e))) + f"</article>{foot}"), [a, b, e]),
        (page(f"{nav}<article><p>{a} <a href=/q>more</a> {c}</p><p>{b}</p></article>{foot}"), [f"{a} more {c}", b]), (page(f"{nav}<article><h1>{c}</h1><p>{a}</p>{side}<p>{b}</p><p>{e}</p></article>{foot}"), [c, a, b, e]),
        (page(f"<article><p>{a}</p>{side}<p>{b}</p></article>"), [a, b]), (page(f"{nav}<article><p>{a}</p></article>{comments}{foot}"), [a]), (page(f"<main><h1>{c}</h1><p>{e}</p></main>{comments}"), [c, e]), (page(f"{nav}<p>{e}</p>"), [e]),
        (page(f"{nav}{side}<div class=content><p>{e}</p></div>{foot}"), [e]), (page(f'<div class="cookie-notice">{p(15)}<button>OK</button></div>{nav}<div id=content><p>{a}</p><p>{b}</p></div>{foot}'), [a, b]), (page(f"<article><p>{c}</p></article>{foot}"), [c]),
        (page(f"<div><div>{a}</div><div>{b}</div></div>{foot}"), [a, b]), (page(f"<h1>{c}</h1><p>{a}</p>{foot}"), [c, a]), (page(f"<section><p>{b}</p><ul><li>{c}</li><li>{p(8)}</li></ul></section>{foot}"), [b, c]),
    ]


def test_short_and_plain_pages_keep_their_text(field_and_words):
    field, words = field_and_words
    right = wrong = lost = 0
    for seed in (5, 6, 7):
        for page, want in _cases(words, seed):
            got = extract.main_text(page, field).split("\n\n")
            assert got != [""], page
            right += len(set(got) & set(want))
            lost += len(set(want) - set(got))
            wrong += sum(any(n in x for n in ("©", "Home", "Comments")) for x in got)
    assert 2 * right / (2 * right + wrong + lost) > 0.95


def test_shares_are_never_none(spark):
    tiny = spark.range(1).select(in_share(F.lit(0).cast("long"), 1e-15).alias("a"), in_share(F.lit(SHARES - 1), 0.5).alias("b"), in_share(F.lit(-1).cast("long"), 1.0).alias("c")).first()
    assert (tiny.a, tiny.b, tiny.c) == (True, False, True) and int(SHARES * 1e-15) > 0


NAMES = ("_k1", "_k2", "_len", "__told", "__id", "__place", "__statistics", "__one", "told", "id", "part", "place", "one", "statistics", "n_shingles", "component_id", "words")


def test_columns_of_any_name_pass_through(spark, data):
    rows = [(i, f"{t} text number {i} with some words in it", *range(len(NAMES))) for i, t in enumerate(["alpha", "beta", "gamma"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in NAMES))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    for made in (near.keep_one(docs), quality.keep_quality(docs, labels, threshold=0.0), bpe.encode_digest(docs, queries.tokenizer_path())):
        got = made.collect()
        assert len(got) == 3 and all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in got)


def test_rows_of_one_id_with_unlike_texts_keep_groups_of_their_own(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, one, "a"), (1, two, "b"), (2, one, "c"), (3, two, "d"), (4, two + " nine ten eleven twelve", "e")], "doc_id long, text string, mark string")
    assert sorted(r.mark for r in near.keep_one(docs).collect()) == ["a", "b", "e"]
    assert sorted((r.doc_id, r.component_id) for r in near.jaccard_components(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_vectors_of_one_id_link_each_by_its_own(spark):
    e1, e2 = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, e1), (1, e2), (3, [1.0, 0.01, 0.0, 0.0]), (4, [0.01, 1.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 1, 1, False), (5, 0, 5, True)]
