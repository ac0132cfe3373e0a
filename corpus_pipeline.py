"""A pipeline over `documents`: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, decontamination, exact_dedup, minhash, packing, quality, tokens

ORACLE_SQL = None  # a fitted classifier and a tokenizer have no SQL; the tests hold each stage against brute force


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    with common.owned("pipeline"):
        return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    with common.owned("pipeline"):
        return exact_dedup.drop_exact_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest id stays."""
    with common.owned("pipeline"):
        return minhash.drop_near_copies(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    with common.owned("pipeline"):
        return decontamination.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    with common.owned("pipeline"):
        return packing.pack(docs, tokens.public("word_bpe_49k.json"), kind="word", end_id=1, cached=100_000)


STAGES = [("quality", quality_classifier), ("exact", exact), ("near", near), ("benchmark", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = common.Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.table(stage(spark, docs, sf_dir), name)
    last = STAGES[-1][1](spark, docs, sf_dir)
    return last.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
