"""The corpus pipeline: documents in, the token digest of a cleaned, deduplicated, mixed corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import bpe, langid, mixing, near, quality
from trailweave.llm.common import aside, cut, table
from trailweave.llm.queries import tokenizer_path

#: A document goes if less than this share of its letters is in its main language, or if it has no letter.
LEAST_LANGUAGE_SHARE = 0.5


# All stages: columns beyond doc_id, text, lang and source pass through untouched, whatever their names;
# an empty table gives an empty one; rows that repeat are judged alike; whole texts are read.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good; null and empty texts are scored as empty ones."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that most of their letters are in; texts that are null or without letters go."""
    slim, back = aside(docs, "doc_id", "text", "lang")
    told = langid.identify(slim)
    return back(told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id; rows without an id or a word stay."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their finish times; those without words go."""
    slim, back = aside(docs, "doc_id", "source")
    return back(mixing.mixed_stream(slim.withColumn("size", mixing.word_count("__aside.text"))))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and hashes of its ids and of the text decoded from them; null texts have none."""
    return bpe.encode_digest(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is cut off from its lineage for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
