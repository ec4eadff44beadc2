"""From raw documents to token ids, in five stages of the operators in papertrace.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes
each stage's result as Parquet in the shared folder and reads it back for the next, so that a lost executor
costs no more than a part of one stage; it is deleted, with what the
next stage stored on its way, when the next one's result is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrace.llm import bpe, mixing, pii, quality, simhash
from papertrace.llm.common import clear, cut, ready, stored, table
from papertrace.llm.queries import PII_KEY, word_bpe_path


def _sized(df: DataFrame) -> DataFrame:
    """df with n_chars of the text that it now has."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in df.columns else df


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the corpus's own thresholds let pass."""
    ready(spark)
    return quality.judge(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies (five-word shingles, Jaccard
    similarity 0.8 or more)."""
    ready(spark)
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal values replaced by pseudonyms of their format."""
    ready(spark)
    return _sized(pii.pseudonymise(docs, PII_KEY)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole pass over a document, and one for what the last pass takes of it."""
    ready(spark)
    return _sized(mixing.materialise(docs)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each row of the mix."""
    ready(spark)
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), word_bpe_path()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can't express the fingerprints, the keyed permutations or the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, others = table(spark, sf_dir, "documents"), stored()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        clear(spark, others, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
