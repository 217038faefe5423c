"""Names, slugs, labels and tags as Column builders."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin-1 letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Prefixes of tag keys that mark what is no longer or not yet in service.
LIFECYCLE = ("abandoned:", "construction:", "demolished:", "disused:", "proposed:", "razed:")


@functools.cache
def _folds(form: str, ascii_only: bool) -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one, what to, and those that fold to several, by Unicode's decompositions; without Hangul, which has thousands."""
    one, many = {}, {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xF900, 0x1F200))):
        whole = unicodedata.normalize(form, c)
        kept = "".join(x for x in whole if (x < "\x80" if ascii_only else not "\u0300" <= x <= "\u036f"))
        if whole != c and kept:
            (one if len(kept) == 1 else many)[c] = kept
    return "".join(one), "".join(one.values()), many


def _folded(text, form: str, ascii_only: bool) -> Column:
    frm, to, many = _folds(form, ascii_only)
    text = F.translate(text, frm, to)
    told = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    there = F.array_distinct(F.regexp_extract_all(text, F.lit(_any_of(many)), F.lit(0)))
    return F.aggregate(there, text, lambda s, c: F.replace(s, c, F.element_at(told, c)))


def _any_of(chars) -> str:
    """A pattern that finds one of the characters; most others are ruled out at a glance."""
    runs = []
    for n in sorted(map(ord, chars)):
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    shown = lambda some: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in some)
    near, far = shown(r for r in runs if r[0] < 256), shown(r for r in runs if r[0] >= 256)
    return (f"[{near}]|" if near else "") + f"(?=[^\\x{{0}}-\\x{{ff}}])[{far}]"


def plain(text) -> Column:
    """Letters without their accents: canonical decompositions without combining marks."""
    return F.regexp_replace(_folded(text, "NFD", False), "[\u0300-\u036f]", "")


def ascii_plain(text) -> Column:
    """What compatibility decompositions leave of a text in ASCII."""
    return F.regexp_replace(_folded(text, "NFKD", True), r"[^\x00-\x7F]", "")


def fold(text) -> Column:
    """Lower case without accents, for comparing."""
    return F.lower(plain(text))


def slug(text) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    words = F.regexp_replace(F.lower(ascii_plain(text)), r"[^a-z0-9_\s-]", "")
    return F.trim(F.regexp_replace(words, r"[\s-]+", "-"), F.lit("-"))


def station_slug(text) -> Column:
    """Words of two letters or more joined by hyphens."""
    words = F.split(F.regexp_replace(fold(text), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: F.length(w) > 1), "-")


def short_hash(text, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def first_filled(*columns) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def split_tags(text, mark: str = ";") -> Column:
    """Parts of a list in a text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, mark), lambda p: F.trim(p)), lambda p: p != "")


def out_of_service(keys) -> Column:
    """Whether a tag key starts with a life-cycle prefix."""
    return F.exists(keys, lambda k: k.rlike("^(" + "|".join(LIFECYCLE) + ")"))


def duration_long(minutes) -> Column:
    """1h30min; hours alone or minutes alone where the other is none."""
    h, m = F.floor(minutes / 60).cast("long"), F.floor(F.pmod(minutes, F.lit(60.0)) + 0.5).cast("long")
    return F.when(h == 0, F.concat(m.cast("string"), F.lit("min"))).when(m == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("min")))


def duration_short(minutes) -> Column:
    """1h05; under an hour 59min. Minutes are rounded after the hours are taken off."""
    h, m = F.floor(minutes / 60).cast("long"), F.floor(F.pmod(minutes, F.lit(60.0)) + 0.5).cast("long")
    padded = F.when(m < 10, F.concat(F.lit("0"), m.cast("string"))).otherwise(m.cast("string"))
    return F.when(h == 0, F.concat(m.cast("string"), F.lit("min"))).otherwise(F.concat(h.cast("string"), F.lit("h"), padded))


def natural_list(words, default: str) -> Column:
    """a, b and c."""
    n = F.size(words)
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, F.lit(default)).when(n == 1, F.element_at(words, 1)).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(words, F.lit(-1))))


# What landmarks of a kind are called in a picture's description.
LANDMARK_PROSE = {
    "castle": "a hilltop medieval castle",
    "ruins": "weathered stone ruins overgrown with ivy",
    "fort": "an old stone fortress",
    "monument": "a stately stone monument",
    "memorial": "a quiet memorial cross",
    "archaeological_site": "ancient archaeological remains",
    "tower": "a lone watchtower",
    "wayside_cross": "a wayside stone cross",
    "viewpoint": "a panoramic viewpoint over the valley",
    "attraction": "a scenic local attraction",
    "peak": "a prominent rocky peak",
    "cliff": "dramatic limestone cliffs",
    "cave_entrance": "the dark mouth of a cave",
    "waterfall": "a cascading waterfall",
    "lighthouse": "a tall coastal lighthouse",
}


def landmark_prose(marks) -> Column:
    """The first three of an array of landmarks (name, kind) in words; unnamed ones of an unknown kind are left out."""
    words = F.create_map(*(F.lit(x) for both in LANDMARK_PROSE.items() for x in both))

    def told(mark):
        known = F.try_element_at(words, mark["kind"])
        named = F.concat(mark["name"], F.lit(" ("), F.coalesce(known, F.replace(mark["kind"], F.lit("_"), F.lit(" "))), F.lit(")"))
        return F.when(mark["name"] != "", named).otherwise(known)

    some = F.slice(F.coalesce(marks, F.array()), 1, 3)
    return F.array_join(F.filter(F.transform(some, told), lambda x: x.isNotNull()), ", ")


def transport_kind(tags) -> Column:
    """train or bus by a map of tags: stations and halts first, then bus stops and platforms for buses; train otherwise."""
    tag = lambda key: F.try_element_at(tags, F.lit(key))
    bus = (tag("highway") == "bus_stop") | ((tag("public_transport") == "platform") & (tag("bus") == "yes"))
    return F.when(tag("railway").isin("station", "halt"), "train").when(bus, "bus").otherwise("train")


def kind_counts(rows) -> Column:
    """An array of (kind, n) as "3 bus, 2 train", kinds in order."""
    return F.array_join(F.transform(F.sort_array(rows), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["kind"])), ", ")


def replace_once(text, mark, value) -> Column:
    """The first ``mark`` in the text replaced by ``value``."""
    at = F.instr(text, mark) if isinstance(mark, str) else F.locate(mark, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + len(mark), F.length(text)))).otherwise(text)


# White space and the ends of words as Unicode has them, as classes that mean the same in Java and in RE2.
_SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DESTINATION = rf"^{_SPACE}*(?:De|Du|Des)(?:[^\p{{L}}\p{{N}}_\n][^\n]*?)?{_SPACE}+(?:à|au|aux){_SPACE}+([A-ZÀÂÉÈÊÎÔÛÇ][^,]*?[^,{_SPACE[1:]}){_SPACE}*\z"


def destination(name: Column) -> Column:
    """What follows à/au/aux in a name that starts with De/Du/Des, if it has a capital and no comma; else null."""
    return F.nullif(F.regexp_extract(name, DESTINATION, 1), F.lit(""))
