"""From raw documents to token ids in five stages, each one an operator of strata.llm over all that the last one kept."""

from __future__ import annotations

import uuid

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, mixing, near_dedup, quality_rules, secrets
from strata.llm.common import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.apply_rules(docs).where("keep").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mask; n_chars follows."""
    masked = secrets.masked(secrets.scan(docs)).withColumn("n_chars", F.length("text").cast("bigint"))
    return masked.select(*COLUMNS)


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics."""
    return mixing.mix(docs).where("sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests of the ids and of what they decode to."""
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), path, tokenizers.PATTERN).drop("text")


STAGES = [("quality rules", quality), ("near duplicates", dedup), ("secret scan", redact), ("source mixing", balance), ("byte-level BPE", encode)]

#: Near duplicates and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        if i:  # what the stage before left has been used up
            old = path(f"{place}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
