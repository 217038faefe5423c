"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, extract, gif, langid, lattice, mixing, near, quality, sharding, variants, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def tokenizer_path() -> str:
    """The public byte-level tokenizer's file; it stays where the library has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digest(chat.chat_examples(turns))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.cut(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size")))
    return mixing.fair_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def piece_model() -> bytes:
    """The public piece tokenizer's model, read where the library has it."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path(), encoding="utf-8") as f:
        return align.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), f.read(), piece_model())


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.page_digest(warc.archive_pages(pages))


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bpe": op2_bpe,
        "op3_language_id": op3_language_id,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_lattice_dedup": op5_lattice_dedup,
        "op6_chat_format": op6_chat_format,
        "op7_mix_sources": op7_mix_sources,
        "op8_html_extract": op8_html_extract,
        "op9_gif_media": op9_gif_media,
        "op10_shard": op10_shard,
        "op11_align": op11_align,
        "op12_variants": op12_variants,
        "op13_warc": op13_warc,
    }


_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
u AS (SELECT DISTINCT doc_id, g FROM s), c AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100*k >= 80*(x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, q.m AS component_id FROM documents d LEFT JOIN c USING (doc_id) JOIN (SELECT n, min(m) AS m FROM r GROUP BY n) q ON q.n = d.doc_id"""

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95e0),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n), q AS (SELECT n, min(m) AS m FROM r GROUP BY n), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, q.m AS component_id, q.m = vec_id AS kept FROM embeddings JOIN q ON q.n = vec_id LEFT JOIN k ON k.a = vec_id"""

_SAID = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '#', '\h'), '<', '\l')"
OP6 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  4 + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + 2 + length({_ESCAPED.format("text")}) + 9 AS size FROM t),
k AS (SELECT *, count(*) FILTER (WHERE role = 'assistant' OR i = n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shown FROM n),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS told, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size * shown)::BIGINT AS formatted_chars FROM k GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

OP7 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size FROM documents),
s AS (SELECT source, coalesce('s' || source, 'n') AS skey, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
r AS (SELECT *, source_size*2e0 AS most, source_size*2e0/weight AS room, sum(source_size) OVER ()*1.5e0 AS budget FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY room, skey) AS pos, (budget - coalesce(sum(most) OVER b, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS level FROM r WINDOW b AS (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, min(CASE WHEN room > level THEN pos END) OVER () AS open_at FROM l), f AS (SELECT *, min(CASE WHEN pos = open_at THEN level END) OVER () AS final FROM o),
t AS (SELECT source, skey, source_size, budget, CASE WHEN open_at IS NULL OR pos < open_at THEN most ELSE weight*final END AS target FROM f),
p AS (SELECT doc_id, size, skey, source_size, budget, target, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, row_number() OVER () AS rid, sum(size) OVER (PARTITION BY skey ORDER BY u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS done FROM p),
v AS (SELECT *, (done + epoch*source_size)::DOUBLE/target AS finish FROM (SELECT *, unnest([0, 1]) AS epoch FROM c WHERE size > 0 AND target > 0)),
x AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS total FROM v),
k AS (SELECT rid, count(*) AS copies FROM x WHERE total <= budget GROUP BY rid)
SELECT doc_id, size, source_size, target, (size*coalesce(copies, 0))::BIGINT AS taken FROM c LEFT JOIN k USING (rid)"""


_BITS = "flatten(list_transform(range(1, octet_length(raw)+1), lambda i: list_transform(range(0, 8), lambda k: (('0x' || substr(hex(raw), (2*i-1)::INT, 2))::BIGINT >> k) & 1)))"
OP12 = rf"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM t WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, c, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS raw FROM d),
h AS (SELECT run, c, xor(list_reduce([4294967295::BIGINT] || {_BITS}, lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) AS h FROM b),
g AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM g WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, n, i, left(word, (i-1)::INT) || substr(word, (i+1)::INT) AS rest FROM (SELECT word, n, unnest(range(1, length(word)+1)) AS i FROM w)),
l AS (SELECT DISTINCT x.word AS a, w.word AS b FROM x JOIN w ON w.word = x.rest), p AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT u.word, v.word FROM x u JOIN x v ON u.i = v.i AND u.rest = v.rest AND u.word <> v.word),
k AS (SELECT p.a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS form, max(w.n) AS m FROM p JOIN w ON w.word = p.b GROUP BY p.a),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.m >= 10*w.n THEN k.form END AS form, CASE WHEN k.m >= 10*w.n THEN k.m END AS form_n FROM w LEFT JOIN k USING (word)),
r(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e USING (word)"""

OP13 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    """Trained models, tokenizers, media formats and packing are beyond SQL; tests hold those against brute force."""
    return {"op4_ngram_jaccard": OP4, "op5_lattice_dedup": OP5, "op6_chat_format": OP6, "op7_mix_sources": OP7, "op12_variants": OP12, "op13_warc": OP13}
