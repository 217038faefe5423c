"""Queries over names, tags, templates, addresses and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geo import rounded
from .derive import table

ACCENTS = f"'{tx.ACCENTED}', '{tx.PLAIN}'"
PLAIN = f"translate({{}}, {ACCENTS})"


def _slugs(spark, d):
    """Hashes of the slugs of whole texts."""
    c = table(spark, d, "documents")
    return c.select("doc_id", F.sha2(tx.slug(F.col("text")), 256).alias("slug"), F.sha2(tx.station_slug(F.col("text")), 256).alias("station_slug"))


SLUG_SQL = (
    "WITH t AS (SELECT doc_id, " + PLAIN.format("text") + " AS a FROM documents) SELECT doc_id, "
    "sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(a), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9_\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '-')) AS slug, "
    "sha256(array_to_string(list_filter(string_split(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1), '-')) AS station_slug FROM t"
)


def _ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.short_hash(F.concat(F.col("p_brand"), F.lit(":"), F.col("p_partkey").cast("string"))).alias("route_id"), tx.short_hash(F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")), 16).alias("cache_key"))


def _tags(spark, d):
    """Key from the JSON text; line lists split; the first filled of several tags; life-cycle keys left out."""
    e = table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    lists = F.concat(F.col("event_type"), F.lit("; "), F.col("k").cast("string"), F.lit(";;x "))
    keys = F.array("event_type", F.concat(F.when(F.col("k") % 7 == 0, F.lit("disused:")).otherwise(F.lit("")), F.lit("station")))
    one = tx.first_filled(F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.col("k").cast("string")), F.when(F.col("k") % 2 == 0, F.col("event_type")), F.concat(F.lit("id"), F.col("event_id").cast("string")))
    kind = F.when(F.col("event_type").isin("view", "click"), "train").when(F.col("event_type") == "purchase", "bus").when((F.col("event_type") == "error") & (F.col("k") > 50), "bus").otherwise("train")
    return e.where(~tx.out_of_service(keys)).select("event_id", one.alias("code"), F.array_join(tx.split_tags(lists), "|").alias("tags"), kind.alias("kind"))


TAGS_SQL = """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT event_id, coalesce(nullif(CASE WHEN k % 3 = 0 THEN '' ELSE k::VARCHAR END, ''), nullif(CASE WHEN k % 2 = 0 THEN event_type END, ''), 'id' || event_id) AS code,
 event_type || '|' || k || '|x' AS tags, CASE WHEN event_type IN ('view','click') THEN 'train' WHEN event_type = 'purchase' THEN 'bus' WHEN event_type = 'error' AND k > 50 THEN 'bus' ELSE 'train' END AS kind FROM e WHERE k % 7 <> 0"""


def _durations(spark, d):
    m = F.col("value") * 3
    return table(spark, d, "events").select("event_id", tx.duration_long(m).alias("long_form"), tx.duration_short(m).alias("short_form"))


_h, _m = "floor(m/60)::BIGINT", "floor(m - 60*floor(m/60) + 0.5e0)::BIGINT"
DURATION_SQL = f"""WITH e AS (SELECT event_id, value*3 AS m FROM events), f AS (SELECT event_id, {_h} AS h, {_m} AS n FROM e)
SELECT event_id, CASE WHEN h = 0 THEN n || 'min' WHEN n = 0 THEN h || 'h' ELSE h || 'h' || n || 'min' END AS long_form, CASE WHEN h = 0 THEN n || 'min' ELSE h || 'h' || CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END END AS short_form FROM f"""

# The words that the labels below are made of.
WORDS = (("en", "count.none", "no part"), ("en", "count.one", "one part"), ("en", "count.many", "{n} of {n} parts"), ("fr", "count.none", "aucune"), ("fr", "count.many", "{n} pièces"))


def _labels(spark, d):
    """Plural labels by locale, the default locale where it lacks one; a mark is replaced once."""
    dim = spark.createDataFrame(list(WORDS), "locale string, key string, template string")
    p = table(spark, d, "part").groupBy("p_brand").agg(F.sum((F.col("p_size") % 3 == 0).cast("long")).alias("n"))
    p = p.withColumn("n", F.pmod(F.col("n"), F.lit(3))).withColumn("locale", F.when(F.length("p_brand") % 2 == 0, "fr").otherwise("de"))
    p = p.withColumn("key", F.when(F.col("n") == 0, "count.none").when(F.col("n") == 1, "count.one").otherwise("count.many"))
    en = dim.where("locale = 'en'").select("key", F.col("template").alias("fallback"))
    j = p.join(dim, ["locale", "key"], "left").join(en, "key", "left")
    told = F.coalesce("template", "fallback", "key")
    return j.select("p_brand", "n", tx.replace_once(told, "{n}", F.col("n").cast("string")).alias("label"))


LABELS_SQL = f"""WITH w(locale, key, template) AS (VALUES {", ".join(str(w) for w in WORDS)}), p0 AS (SELECT p_brand, sum((p_size % 3 = 0)::INT)::BIGINT % 3 AS n FROM part GROUP BY 1),
p AS (SELECT *, CASE WHEN length(p_brand) % 2 = 0 THEN 'fr' ELSE 'de' END AS locale, CASE n WHEN 0 THEN 'count.none' WHEN 1 THEN 'count.one' ELSE 'count.many' END AS key FROM p0)
SELECT p_brand, n, regexp_replace(coalesce(a.template, b.template, p.key), '\\{{n\\}}', n::VARCHAR) AS label FROM p LEFT JOIN w a ON a.locale = p.locale AND a.key = p.key LEFT JOIN w b ON b.locale = 'en' AND b.key = p.key"""


def _urls(spark, d):
    """Host, locale, alternate and shared state of the pages' addresses."""
    p = table(spark, d, "pages").select("page_id", "url")
    path = F.coalesce(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), F.lit(""))
    locale = F.element_at(F.split(path, "/"), 2)
    alternate = F.when(locale == "en", F.regexp_replace(path, "^/en", "")).otherwise(F.concat(F.lit("/en"), path))
    state = F.concat_ws("&", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("from="), F.col("page_id").cast("string"))), F.concat(F.lit("view="), locale))
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), locale.alias("locale"), alternate.alias("alternate"), state.alias("state"))


URLS_SQL = """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages), q AS (SELECT *, string_split(path, '/')[2] AS locale FROM p)
SELECT page_id, host, locale, CASE WHEN locale = 'en' THEN regexp_replace(path, '^/en', '') ELSE '/en' || path END AS alternate, concat_ws('&', CASE WHEN page_id % 2 = 0 THEN 'from=' || page_id END, 'view=' || locale) AS state FROM q"""


def _prompt(spark, d):
    """Stored text where there is one, else destination, fixed words and a natural list of tags."""
    p = table(spark, d, "part")
    words = F.array_sort(F.split("p_name", " "))
    built = F.concat_ws(", ", F.when(F.col("p_size") > 10, F.concat(F.lit("to "), F.col("p_brand"))), F.lit("wide view"), tx.natural_list(words, "open land"))
    stored = F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("stored "), F.col("p_name")))
    return p.select("p_partkey", F.coalesce(stored, built).alias("prompt"))


PROMPT_SQL = """WITH p AS (SELECT *, list_sort(string_split(p_name, ' ')) AS w FROM part) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 50 = 0 THEN 'stored ' || p_name END,
 concat_ws(', ', CASE WHEN p_size > 10 THEN 'to ' || p_brand END, 'wide view', CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) = 2 THEN w[1] || ' and ' || w[2] ELSE array_to_string(w[1:len(w)-1], ', ') || ' and ' || w[len(w)] END)) AS prompt FROM p"""


def _destination(spark, d):
    """What follows the first 'to', 'of', 'de' or 'von' in the first line that has one; ``destination_lines`` gives every line's by the reference's rule."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.regexp_extract("text", r"(?md)^[A-Z]\S* .*?\b(?:to|of|de|von) ([A-Za-z]\S*)", 1).alias("destination"))


def _destination_lines(spark, d):
    """The destination in each line of the whole texts, by its number from 1; null where a line has none."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return t.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), tx.destination(F.col("line")).alias("destination"))


def _lines(spark, d):
    """Lines of the texts: how many, how many are empty after a trim, the longest."""
    t = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    return t.select("doc_id", F.size("ls").alias("n"), F.size(F.filter("ls", lambda x: F.trim(x) == "")).alias("empty"), F.array_max(F.transform("ls", lambda x: F.length(x))).alias("longest"))


def _members(spark, d):
    """Relation members in order: an order's lines looked up in parts; missing parts are skipped, places stay in order."""
    l = table(spark, d, "lineitem")  # noqa: E741
    p = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    j = l.join(p, "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("m"))
    return j.select("l_orderkey", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["l_partkey"].cast("string")), ",").alias("members"))


def _labels_stats(spark, d):
    """Quality marks by source: share good, share toxic."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("quality"), 3).alias("good"), rounded(F.avg("toxic"), 3).alias("toxic"))


QUERIES = {
    "slugs": (_slugs, SLUG_SQL),
    "route_id": (_ids, "SELECT p_partkey, substr(sha256(p_brand || ':' || p_partkey),1,12) AS route_id, substr(sha256(p_partkey || ',' || p_size),1,16) AS cache_key FROM part"),
    "tag_parse": (_tags, TAGS_SQL),
    "duration_format": (_durations, DURATION_SQL),
    "template_fill": (_labels, LABELS_SQL),
    "locale_from_url": (_urls, URLS_SQL),
    "prompt_content": (_prompt, PROMPT_SQL),
    "destination_regex": (_destination, "SELECT doc_id, regexp_extract(text, '(?m)^[A-Z]\\S* .*?\\b(?:to|of|de|von) ([A-Za-z]\\S*)', 1) AS destination FROM documents"),
    "destination_lines": (
        _destination_lines,
        f"WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM t) SELECT doc_id, line_no, nullif(regexp_extract(line, '{tx.DESTINATION}', 1), '') AS destination FROM l",
    ),
    "split_lines": (
        _lines,
        "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, len(ls)::INT AS n, len(list_filter(ls, lambda x: trim(x) = ''))::INT AS empty, list_max(list_transform(ls, lambda x: length(x)))::INT AS longest FROM t",
    ),
    "relation_members": (
        _members,
        "SELECT l_orderkey, count(*)::INT AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, p_name) AS members FROM lineitem JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey GROUP BY 1",
    ),
    "label_shares": (_labels_stats, "SELECT source, count(*) AS n, floor(avg(quality)*1e3+0.5e0)/1e3 AS good, floor(avg(toxic)*1e3+0.5e0)/1e3 AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source"),
}
