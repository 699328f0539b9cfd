"""From documents to packed training sequences: five stages, each a written table that the next one reads.

All stages but the last return the columns of documents, whatever further columns there are, and an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from trialframe.llm.common import staged, table
from trialframe.llm.queries import vocabulary

# SQL has no Viterbi decoding, signatures or tokenizer: tests/llm compares every stage with a brute-force version
ORACLE_SQL = None

MAX_REPEATS = 1.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose lines are mostly boilerplate, go. A null or empty text has no words and goes."""
    return quality.keep_good(docs, quality.train_lines(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest stays, then the smallest id; of repeated rows one."""
    return exact_dedup.drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts with linked five-word multisets the smallest id stays; of repeated rows one."""
    return near_dedup.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to one and a half times as often as the largest; every document stays at least once. Rows
    come in order of the mixture's blocks; a null source is a source."""
    return mixing.apply_mixture(docs, target_entropy=None, max_repeats=MAX_REPEATS, budget="cover")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a repeated row is packed again, a null text is its end token."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("source_mix", source_mix), ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
