"""The queries of this subpackage, with their production parameters, and the SQL of those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hnsw, html, licenses, quality, sharding, simhash, tokencount, urls
from .common import table

URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
MULTILINGUAL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), [1.0] * 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged, perplexity, keep = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col(perplexity).alias("perplexity"), F.col(keep).alias("keep"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.attribute(table(spark, sf_dir, "documents"), ["text"], MULTILINGUAL, public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), MULTILINGUAL, public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_url_filter, op3_sharding, op4_quality, op5_token_counts, op6_decontamination,
        op7_html_text, op8_embedding_dedup, op9_simhash, op10_byte_bpe,
    )
}
SQL = {"op1_license_scan": licenses.sql(), "op2_url_filter": urls.sql(URL_RULES), "op3_sharding": sharding.sql()}
