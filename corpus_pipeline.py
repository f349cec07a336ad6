"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``docs``. Whatever is null, empty, repeated or named alike is handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm import bpe, decontaminate, quality, simhash
from lyrebird.llm.catalogue import MULTILINGUAL
from lyrebird.llm.common import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model of trusted text does not reject."""
    judged, _, keep = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document's whole text encodes to, as digests."""
    return bpe.digests(docs, MULTILINGUAL, public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("byte_bpe", token_ids)]

#: SQL expresses neither the fingerprints, nor the alignment, nor the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
