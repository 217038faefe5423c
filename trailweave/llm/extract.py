"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into blocks: runs of text without a block-level tag between them, each with its open
ancestors. A block's features come from ancestor tags, their class and id words, and its text; the
field scores main text against the rest with weights for features and for pairs of neighbours.
Weights are fitted on labelled pages, which ``labelled_pages`` lays out from a stated grammar of page
parts with the words of a bounded sample of pages; Viterbi decodes each page.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_share, small_batches

#: Hashed features, labelled pages, passes over them, pages that lend words, about.
FEATURES, PAGES, PASSES, WORD_PAGES = 1 << 13, 1000, 10, 200

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg canvas title select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SAME_CLOSES = frozenset("li dt dd tr td th option p thead tbody tfoot".split())

# Attributes: up to 30 quoted ones, else up to the next angle bracket; possessive, so that broken quotes cost little.
_ATTRS = r"(?:(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,60}+(?=>)|[^<>]*+)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(RAW)) + rf")\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>{_ATTRS})>|<[!?][^<>]*+>|[^<]+|<",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_SPACES = re.compile(r"[\s\x1c-\x1f]+")
_STOPS = ".!?:;…\"»”)。！？"
_SENTENCE = re.compile(r"[.!?…](?:\s|$)|[。！？]")
_UNSPACED = re.compile("[\u2e80-\u9fff\uac00-\ud7af\u0e00-\u0eff]")  # scripts that set few spaces or none
# Elements that stand inside a part of a page rather than make one, and those of tables.
_INNER = frozenset("p li dt dd ul ol dl h1 h2 h3 h4 h5 h6 blockquote figure figcaption pre caption address".split())
_TABLE = frozenset("td th tr tbody thead tfoot table".split())


class Block:
    __slots__ = ("path", "names", "text", "linked", "home")

    def __init__(self, path, names, text, linked, home=0):
        self.path, self.names, self.text, self.linked, self.home = path, names, text, linked, home


def _home(stack) -> int:
    """The number of the element that makes the part of the page which a block stands in."""
    i = len(stack) - 1
    while i >= 0 and (stack[i][0] in _INNER or (stack[i][0] in _TABLE and (i + 1 == len(stack) or stack[i + 1][0] in _TABLE))):
        i -= 1
    return stack[i][2] if i >= 0 else 0


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: open tags, words of their classes and ids, text, characters inside links."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []  # block-level elements, numbered; inline ones only matter for links
    parts: list[str] = []
    linked = links = made = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(tuple(t for t, _, _ in stack), tuple(n for _, names, _ in stack for n in names), text, min(linked, len(text)), _home(stack)))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            told = m[0]
            if m["raw"] is not None or told[:2] in ("<!", "<?"):
                continue
            parts.append(told)
            if links:
                linked += len(told)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        links = 0
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if stack and (stack[-1][0] in CLOSED_BY_BLOCK or (stack[-1][0] == tag and tag in SAME_CLOSES)):
                stack.pop()
            names = ()
            if m["attrs"]:
                names = tuple(n for a in _ATTR.findall(m["attrs"]) for n in _NAME.findall("".join(a).lower()))
            made += 1
            stack.append((tag, names, made))
    flush()
    return out


def _feature(*told, known: dict = {}) -> int:  # noqa: B006  hashes of names met before
    if told not in known:
        if len(known) > 50_000:
            known.clear()
        known[told] = zlib.crc32("\0".join(map(str, told)).encode()) % FEATURES
    return known[told]


def features(found: list[Block]) -> list[list[int]]:
    """Hashed features of each block, of its neighbours and of the part of the page it stands in."""
    out, n = [], len(found)
    plain: dict[int, int] = {}
    for b in found:
        plain[b.home] = plain.get(b.home, 0) + len(b.text) - b.linked
    total, most = max(1, sum(plain.values())), max(plain.values(), default=0)
    looks = [(min(9, len(b.text).bit_length()), min(4, 4 * b.linked // len(b.text)), b.text[-1] in _STOPS) for b in found]
    for i, b in enumerate(found):
        size, text = len(b.text), b.text
        bits, links, ends = looks[i]
        words = text.count(" ") + 1 + len(_UNSPACED.findall(text)) // 2
        mine = {_feature("bias"), _feature("leaf", b.path[-1] if b.path else ""), _feature("size", bits), _feature("words", min(8, words.bit_length()))}
        mine.update(_feature("in", t) for t in b.path)
        mine.update(_feature("named", w) for w in b.names)
        mine.add(_feature("links", links))
        mine.add(_feature("ends", ends))
        mine.add(_feature("prose", bits > 6 and links == 0 and ends))
        mine.add(_feature("sentences", min(4, len(_SENTENCE.findall(text)))))
        mine.add(_feature("sign", text[0] in "©®→»|•"))
        mine.add(_feature("first", i == 0, min(4, n)))
        mine.add(_feature("last", i == n - 1, min(4, n)))
        mine.add(_feature("few", min(4, n), bits, links))
        mine.add(_feature("depth", min(6, len(b.path))))
        mine.add(_feature("share", min(9, 10 * plain[b.home] // total), plain[b.home] == most))
        for side, j in (("before", i - 1), ("behind", i + 1)):
            if 0 <= j < n:
                mine.add(_feature(side, min(4, looks[j][0] // 2), looks[j][1], looks[j][2]))
                mine.add(_feature(side, "together", found[j].home == b.home))
        out.append(sorted(mine))
    return out


class ChainField:
    """Weights of features by label (0 the rest, 1 main text), of neighbouring labels, of the first label."""

    def __init__(self, weights=None, moves=None, first=None):
        self.weights = np.zeros((FEATURES, 2)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves
        self.first = np.zeros(2) if first is None else first

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        return np.add.reduceat(self.weights[flat], np.cumsum([0, *map(len, rows)])[:-1])

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the labels of the best chain."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        s = scores.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        came = []
        for x, y in s[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 > b + m11
            came.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + m00 if from_a else b + m10), y + (a + m01 if from_b else b + m11)
        out = [0 if a > b else 1]
        for back in reversed(came):
            out.append(back[out[-1]])
        return out[::-1]

    def gradient(self, scores: np.ndarray, labels: np.ndarray):
        """Of the log-likelihood: by block and label, by move, by first label; forward-backward in logs."""
        n = len(scores)
        fore, aft = np.empty((n, 2)), np.zeros((n, 2))
        fore[0] = scores[0] + self.first
        for i in range(1, n):
            fore[i] = scores[i] + np.logaddexp.reduce(fore[i - 1][:, None] + self.moves, 0)
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp.reduce(self.moves + (scores[i + 1] + aft[i + 1])[None], 1)
        total = np.logaddexp.reduce(fore[-1])
        told = np.eye(2)[labels]
        one = told - np.exp(fore + aft - total)
        two = np.zeros((2, 2))
        for i in range(n - 1):
            two -= np.exp(fore[i][:, None] + self.moves + (scores[i + 1] + aft[i + 1])[None] - total)
            two[labels[i], labels[i + 1]] += 1
        return one, two, told[0] - np.exp(fore[0] + aft[0] - total)

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], passes: int = PASSES, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> ChainField:
        """Stochastic gradient ascent with per-weight step sizes and decay towards zero."""
        seen = [np.full(w.shape, 1e-8) for w in (self.weights, self.moves, self.first)]
        order = list(range(len(pages)))
        rng = random.Random(seed)
        for _ in range(passes):
            rng.shuffle(order)
            for k in order:
                rows, labels = pages[k]
                if not rows:
                    continue
                one, two, start = self.gradient(self.scores(rows), np.array(labels))
                flat = np.fromiter((f for r in rows for f in r), np.int64)
                used, at = np.unique(flat, return_inverse=True)
                g = np.zeros((len(used), 2))
                np.add.at(g, at, np.repeat(one, [len(r) for r in rows], 0))
                g -= decay * self.weights[used]
                seen[0][used] += g * g
                self.weights[used] += rate * g / np.sqrt(seen[0][used])
                for w, d, s in ((self.moves, two, seen[1]), (self.first, start, seen[2])):
                    s += d * d
                    w += rate * d / np.sqrt(s)
        return self


# A grammar of pages: what their parts are often called; as often, training gives parts names that say nothing.
_MAIN = ("article", "main", "div.content", "div.post", "div.entry", "section.story", "div.article-body", "div#content", "article.post", "div.text", "div")
_REST = {
    "nav": ("nav", "ul.menu", "div.navigation", "div.nav", "div.breadcrumb", "nav.menu", "div#menu"),
    "header": ("header", "div.header", "div.masthead", "div#header", "header.site-header", "div.logo", "div.topbar"),
    "footer": ("footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.legal"),
    "side": ("aside", "div.sidebar", "div.related", "aside.widget", "div.widget", "div#sidebar", "div.popular", "section.recommended"),
    "notice": ("div.cookie", "div.notice", "div.consent", "div.banner", "div.alert", "div.cookie-notice", "div.popup", "div.modal", "section.notice"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.promo", "div.promo", "div#ad", "section.sponsor"),
    "form": ("form", "form.search", "form.newsletter", "div.subscribe", "form.login", "div.signup", "form#comment-form"),
    "comments": ("div.comments", "section.comments", "div#comments", "ol.comments", "ul.comment-list", "div.comment", "section.discussion", "div.replies"),
    "share": ("div.share", "div.social", "ul.tags", "div.meta", "div.byline"),
}


def labelled_pages(words: list[str], pages: int = PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages laid out at random from the parts above, with the label of each of their blocks."""
    rng = random.Random(seed)

    unspaced = False

    def said(low: int, high: int) -> str:
        if unspaced:
            return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2 * rng.randint(low, high))) + rng.choice("。。。！？,")
        some = [rng.choice(words) for _ in range(rng.randint(low, high))]
        return html.escape(" ".join(some)[:1].upper() + " ".join(some)[1:], quote=False) + rng.choice((".", ".", ".", "", "!", "?"))

    def invented() -> str:
        return "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 8)))

    def wrapped(inner: str, most: int) -> str:
        for _ in range(rng.randint(0, most)):
            inner = f'<div class="{rng.choice((invented(), invented(), "wrapper", "inner", "container", "row", "page", "col"))}">{inner}</div>'
        return inner

    def opened(told: str, inner: str, unnamed: float = 0.0) -> str:
        tag, mark, name = re.match(r"(\w+)([.#]?)(.*)", told).groups()
        if rng.random() < unnamed:
            tag, mark, name = rng.choice(("div", "div", "section")), ".", invented()
        if mark == "." and rng.random() < 0.2:
            name += " " + rng.choice(("box", "block", "wrap", "inner", "clearfix"))
        attrs = f' {"class" if mark == "." else "id"}="{name}"' if mark else ""
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def linked(n: int) -> tuple[str, int]:
        items = [f'<a href="/{i}">{said(1, 3).rstrip(".!?")}</a>' for i in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", n
        return "<div>" + " | ".join(items) + "</div>", 1

    def rest(kind: str) -> tuple[str, int]:
        if kind == "nav" or (kind in ("side", "share", "footer") and rng.random() < 0.5):
            inner, n = linked(rng.randint(2, 7))
        elif kind == "form":
            inner, n = f"<label>{said(1, 3)}</label><input name=q><button>{said(1, 2)}</button>", 2
        elif kind == "comments":
            n = rng.randint(1, 7)
            inner = "".join(rng.choice(("<div class=\"comment\">{}</div>", "<p>{}</p>", "<li>{}</li>", "<div class=\"reply\"><p>{}</p></div>")).format(said(*rng.choice(((3, 40), (20, 60))))) for _ in range(n))
            if rng.random() < 0.5:
                inner, n = f"<h3>{said(1, 3)}</h3>" + inner, n + 1
        elif kind == "footer":
            inner, n = rng.choice(("&copy; ", "&#169; 2024 ", "")) + said(2, 12), 1
        elif rng.random() < 0.3:
            inner, n = f"<h3>{said(1, 4)}</h3><p>{said(3, 20)}</p>", 2
        else:
            inner, n = rng.choice(("{}", "<p>{}</p>", "<span>{}</span>")).format(said(3, 25)), 1
        return opened(rng.choice(_REST[kind]), inner, 0.0 if kind in ("notice", "advert", "comments") else 0.3), n

    def prose(low: int, high: int) -> str:
        """Words, of which some may be links."""
        if rng.random() < 0.8:
            return said(low, high)
        return " ".join(rng.choice(("{}", '<a href="/x">{}</a>', "<em>{}</em>")).format(said(low, high)) for _ in range(rng.randint(2, 4)))

    out = []
    for _ in range(pages):
        body, labels = [], []
        unspaced, short, all_linked = rng.random() < 0.08, rng.random() < 0.35, rng.random() < 0.04
        often = rng.choice((0.0, 0.2, 0.45)) if short else 0.45  # pages of a block or two have few other parts

        def add(part: tuple[str, int], label: int):
            body.append(part[0])
            labels.extend([label] * part[1])

        for kind in ("notice", "header", "nav", "form", "advert", "side"):
            if rng.random() < often:
                add(rest(kind), 0)
        main, marks = [], []
        if rng.random() < (0.3 if short else 0.8):
            main.append(f"<h1>{said(2, 9)}</h1>")
            marks.append(1)
        for _ in range(rng.randint(1, 2) if short else rng.randint(1, 14)):
            roll = rng.uniform(0.2, 1.0) if short else rng.random()
            if roll < 0.08:
                head = rng.choice(("h2", "h2", "h3", "h4"))
                main.append(f"<{head}>{said(1, 6)}</{head}>")
                marks.append(1)
            elif roll < 0.12:
                n = rng.randint(2, 5)
                main.append(rng.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{said(2, 12)}</li>" for _ in range(n))))
                marks += [1] * n
            elif roll < 0.15:
                rows, columns = rng.randint(2, 4), rng.randint(2, 4)
                head = "".join(f"<th>{said(1, 2)}</th>" for _ in range(columns))
                cells = "".join("<tr>" + "".join(f"<td>{rng.choice((said(1, 3), str(rng.randint(1, 9999))))}</td>" for _ in range(columns)) + "</tr>" for _ in range(rows))
                main.append(f"<table><tr>{head}</tr>{cells}</table>")
                marks += [1] * ((rows + 1) * columns)
            elif roll < 0.16:
                main.append(f"<figure><img src=x><figcaption>{said(2, 12)}</figcaption></figure><pre>{said(3, 20)}</pre><dl><dt>{said(1, 2)}</dt><dd>{said(2, 9)}</dd></dl>")
                marks += [1] * 4
            elif roll < 0.18:
                main.append(f"<blockquote>{said(5, 40)}</blockquote>")
                marks.append(1)
            elif roll < 0.24:
                inner, n = rest(rng.choice(("advert", "share", "side", "form")))
                main.append(inner)
                marks += [0] * n
            else:
                text = prose(*rng.choice(((4, 20), (10, 60), (20, 120)) if short else ((1, 6), (5, 40), (20, 120))))
                text = f'<a href="/y">{text}</a>' if all_linked and "<" not in text else text
                main.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br><p>", "<div>{}</div>")).format(text))
                marks.append(1)
        held = "".join(main)
        roll = rng.random()
        if short and len(main) == 1 and marks == [1] and roll < 0.3:
            body.append(re.sub("</?(?:p|div|h1)>", "", held))  # bare text
            labels += marks
        elif roll < (0.35 if short else 0.1):
            body.append(held)  # no element of its own
            labels += marks
        elif roll < 0.22:  # a table lays the page out
            side, n = rest("nav")
            body.append(f"<table><tr><td>{side}</td><td>{held}</td></tr></table>")
            labels += [0] * n + marks
        else:
            body.append(wrapped(opened(rng.choice(_MAIN), wrapped(held, 2), 0.35), 2))
            labels += marks
        for kind in ("share", "comments", "side", "advert", "form", "nav", "footer"):
            if rng.random() < (max(often, 0.35) if kind == "comments" else often):
                add(rest(kind), 0)
        page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + wrapped("".join(body), 1) + "</body></html>"
        if len(blocks(page)) == len(labels):
            out.append((page, labels))
    return out


def fit_field(words: list[str], pages: int = PAGES) -> ChainField:
    labelled = [(features(blocks(p)), y) for p, y in labelled_pages(words, pages)]
    return ChainField().fit(labelled)


@functools.lru_cache(maxsize=8)
def fitted(words: tuple[str, ...]) -> ChainField:
    """fit_field, once for the same words."""
    return fit_field(list(words))


def sample_words(pages: DataFrame, most_pages: int = WORD_PAGES, most_words: int = 5000) -> list[str]:
    """Words of about ``most_pages`` pages, chosen by a hash of their html, ``most_words`` at most; a few fixed ones if there are none."""
    share = min(1.0, most_pages / max(1, pages.count()))

    def words(batches):
        for batch in batches:
            said = sorted({w for page in batch.column("html").to_pylist() for b in blocks(page or "") for w in b.text.split()})
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], ["word"])

    some = pages.where(in_share(F.xxhash64(F.lit(2), "html"), share)).select("html")
    got = some.mapInArrow(words, "word string").distinct().orderBy(F.xxhash64("word")).limit(most_words).collect()
    return sorted(r["word"] for r in got) or ["one", "two", "three"]


def main_text(page: str, field: ChainField) -> str:
    found = blocks(page)
    if not found:
        return ""
    labels = field.decode(field.scores(features(found)))
    return "\n\n".join(b.text for b, y in zip(found, labels) if y)


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html), from the whole html.

    Defined cases: null, empty and textless html gives an empty text; text outside any element counts
    as a block; unclosed elements end where their parents do; null ids and urls pass through;
    repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    field = field or fitted(tuple(sample_words(pages)))
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p or "", shared.value) for p in column.to_pylist()], pa.string())

    told = pages.select("page_id", "url", F.arrow_udf(texts, "string")("html").alias("text"))
    return told.withColumn("n_chars", F.length("text").cast("long"))
