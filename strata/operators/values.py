"""Value separation, dereference, integrity, and garbage among separated values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.segment import BEFORE, offsets, segments
from strata.schema import RECORD_BYTES


def placement(df: DataFrame, threshold: int, value: str = "value") -> DataFrame:
    """df plus ``n_bytes`` and ``separate``: values of more than threshold bytes go to the value log."""
    return df.withColumn("n_bytes", F.octet_length(value).cast("bigint")).withColumn("separate", F.coalesce(F.col("n_bytes") > threshold, F.lit(False)))


def separate(log: DataFrame, threshold: int, segment_max: int, first_segment: int = 1, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, blobs): large values moved to blobs and replaced by references.

    Segment numbers start at first_segment; with ``by`` (an integer column) every stream has numbers of
    its own, ``by`` times 2**32 apart, so streams are cut independently.
    """
    large = F.octet_length("value") > threshold
    blobs = placed(log.where(large), segment_max, first_segment, by)
    vref = F.struct("segment_id", "offset", "value_len", "checksum")
    rest = [c for c in log.columns if c not in ("value", "vref")]
    far = blobs.select(*rest, F.lit(None).cast("binary").alias("value"), vref.alias("vref"))
    near = log.where(~F.coalesce(large, F.lit(False))).select(*rest, F.col("value").cast("binary").alias("value"), F.lit(None).cast(far.schema["vref"].dataType).alias("vref"))
    return near.unionByName(far), blobs.select("segment_id", "offset", "key", F.col("value").cast("binary").alias("value"), "checksum")


def placed(large: DataFrame, segment_max: int, first_segment: int = 1, by: str | None = None) -> DataFrame:
    """large plus each value's place: segment_id, offset, value_len, checksum (streams as in separate)."""
    sized = large.withColumn("__n", (F.lit(RECORD_BYTES) + F.octet_length("key") + F.octet_length("value")).cast("bigint"))
    cut = segments(sized, "__n", segment_max, BEFORE, ["seq", "key"], by, "__s")
    base = F.lit(first_segment) + (F.shiftleft(F.col(by).cast("bigint"), 32) if by else F.lit(0))
    cut = cut.withColumn("segment_id", (F.col("__s") + base).cast("bigint"))
    out = offsets(cut, "__n", "segment_id", ["seq", "key"]).withColumn("checksum", F.crc32("value"))
    return out.withColumn("value_len", F.octet_length("value").cast("bigint")).drop("__n", "__s")


#: Made-up segments, all negative, over which rows without a reference are spread in the join.
SPREAD = 1 << 20


def resolve(entries: DataFrame, blobs: DataFrame, check: bool = True) -> DataFrame:
    """entries with values in place of references; a dangling or damaged reference fails the query when check is set.

    Rows without a reference join on segments that do not exist, spread by key, instead of all on null.
    """
    b = blobs.select(F.col("segment_id").alias("__s"), F.col("offset").alias("__o"), F.col("value").alias("__v"))
    none = -1 - F.pmod(F.xxhash64("key"), F.lit(SPREAD))
    asked = entries.withColumn("__rs", F.coalesce(F.col("vref.segment_id"), none)).withColumn("__ro", F.coalesce(F.col("vref.offset").cast("bigint"), F.lit(0).cast("bigint")))
    joined = asked.join(b, (F.col("__rs") == F.col("__s")) & (F.col("__ro") == F.col("__o")), "left")
    found = F.col("__v")
    if check:
        fine = (F.octet_length("__v") == F.col("vref.value_len")) & (F.crc32("__v") == F.col("vref.checksum"))
        failure = F.raise_error(F.concat(F.lit("value log: bad reference to segment "), F.col("vref.segment_id").cast("string"))).cast("binary")
        found = F.when(F.coalesce(fine, F.lit(False)), F.col("__v")).otherwise(failure)
    value = F.when(F.col("vref").isNotNull(), found).otherwise(F.col("value"))
    return joined.withColumn("value", value).drop("__s", "__o", "__v", "__rs", "__ro")


def damaged(blobs: DataFrame) -> DataFrame:
    """Blobs whose value does not have its checksum."""
    return blobs.where(F.coalesce(F.crc32("value") != F.col("checksum"), F.lit(True)))


def garbage(blobs: DataFrame, live: DataFrame) -> DataFrame:
    """Blobs that no live entry refers to."""
    refs = live.where("vref IS NOT NULL").select(F.col("vref.segment_id").alias("segment_id"), F.col("vref.offset").alias("offset"))
    return blobs.join(refs, ["segment_id", "offset"], "left_anti")


def valid_prefix(records: DataFrame, by: str | None = None, pos: str = "pos", ok: str = "ok") -> DataFrame:
    """Records of each log before its first bad one."""
    keys = [by] if by else []
    bad = records.where(~F.col(ok)).groupBy(*keys).agg(F.min(pos).alias("__bad"))
    joined = records.join(bad, by, "left") if by else records.join(F.broadcast(bad), F.lit(True), "left")  # one row
    return joined.where(F.col("__bad").isNull() | (F.col(pos) < F.col("__bad"))).drop("__bad")
