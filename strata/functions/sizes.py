"""Sizes in the storage model: logical bytes, run bytes, amplification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.segment import BEFORE, segments
from strata.schema import BLOCK_BYTES, ENTRY_BYTES, TOMBSTONE_BYTES


def logical_bytes(key: str = "key", value: str = "value", deleted: str = "deleted") -> Column:
    """Bytes that an operation adds to a memtable: its key, and its value or a delete's marker."""
    v = F.when(F.coalesce(F.col(deleted), F.lit(False)), F.lit(TOMBSTONE_BYTES)).otherwise(F.coalesce(F.octet_length(value), F.lit(0)))
    return (F.octet_length(key) + v).cast("bigint")


def run_bytes(entries: DataFrame, run: str, key_bytes: str, value_bytes: str, order: list[str], fpp: float = 0.01) -> DataFrame:
    """(run, n_entries, run_bytes): what each run's file takes, with its filter, blocks, index and footer."""
    sized = entries.withColumn("__e", (F.lit(ENTRY_BYTES) + F.col(key_bytes) + F.col(value_bytes)).cast("bigint"))
    packed = segments(sized, "__e", BLOCK_BYTES, BEFORE, order, by=run, out="__block")
    blocks = packed.groupBy(run, "__block").agg(F.sum("__e").alias("e"), F.count("*").alias("n"), F.min_by(key_bytes, F.struct(*order)).alias("k"))
    n = F.sum("n")
    bloom = 25 + 8 * F.ceil(F.ceil(n * F.lit(-math.log(fpp) / math.log(2) ** 2)) / 64)
    return blocks.groupBy(run).agg(n.cast("bigint").alias("n_entries"), (bloom + F.sum("e") + F.sum(F.lit(14) + F.col("k")) + 13).cast("bigint").alias("run_bytes"))


def footprint(spark, path: str) -> DataFrame:
    """(kind, n_files, bytes) of the files below path, by extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
