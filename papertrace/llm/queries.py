"""The registered queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, mixing, neighbors, pii, quality, sharding, simhash, substrings, warc
from .common import cut, scratch, table

#: The key of the registered query's pseudonyms; production passes its own secret.
PII_KEY = "papertrace-registered-query"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_bpe_path()
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    back = bpe.decode(docs, path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc.read(spark, warc.write(pages, scratch(spark)))
    refers = F.regexp_extract(F.coalesce(warc.field("WARC-Refers-To"), F.lit("")), r"^<urn:x-page:(-?[0-9]+):[0-9]+>$", 1)
    return records.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), warc.field("WARC-Type").alias("record_type"), F.nullif(refers, F.lit("")).cast("long").alias("refers_to"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality.verdict(cut(quality.counts(docs).drop("text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text_digest", "license", "notices")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count="n_pseudonyms").select("doc_id", "n_pseudonyms", "text")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), scratch(spark)
    sharding.write(docs, path)
    out, text = sharding.read(spark, path, docs), F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.linked(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_substrings": op7_substrings,
    "op8_hilbert": op8_hilbert,
    "op9_mixing": op9_mixing,
    "op10_neighbors": op10_neighbors,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS rid FROM pages),
g AS (SELECT sha256(html) AS d, max(page_id) AS holder FROM p GROUP BY 1)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM p JOIN g ON sha256(html) = d
""",
    "op4_quality": quality.oracle(),
    "op5_licenses": licenses.oracle(),
    "op7_substrings": substrings.oracle(),
    "op9_mixing": mixing.oracle(),
    "op10_neighbors": neighbors.oracle(),
}
