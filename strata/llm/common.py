"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word (space and 0x09-0x0D).
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of df's, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of the operator's own only where that is unset, on a local master (tests)."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared checkpoint folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Buckets, of 2**15 bits each, of the bitmap that ``flagged`` broadcasts: 8 MB, whatever the size of the data.
BUCKETS = 2048


def flagged(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left plus a boolean column: false only if right has no row with equal, non-null ``on``.

    A bitmap of right's key hashes, of fixed size, decides on each row without a shuffle of left.  A
    hash that two keys share makes a true flag too many, never a false one: a join must follow.
    """
    bit, bucket, bits = fresh(left, f"{name}_bit"), fresh(left, f"{name}_bucket"), fresh(left, f"{name}_bits")
    spot = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in on)), F.lit(BUCKETS << 15))
    held = right.select(spot.alias(bit)).select(F.shiftright(bit, 15).cast("int").alias(bucket), (F.col(bit) % 32768).alias(bit))
    maps = cut(held.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bits)))
    own = left.withColumn(bit, spot).withColumn(bucket, F.shiftright(bit, 15).cast("int")).withColumn(bit, (F.col(bit) % 32768).cast("int"))
    byte = F.conv(F.hex(F.col(bits).substr(F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(F.coalesce(byte, F.lit(0)), F.col(bit) % 8) == 1
    return own.join(F.broadcast(maps), bucket, "left").withColumn(name, hit).drop(bit, bucket, bits)


#: Rows of a side that may be broadcast, once a count has shown that it has no more.
BROADCAST_ROWS = 20_000


def beside(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that broadcasts its right side only if a count finds it small; else a plain one, which
    adaptive execution can split where a key is hot."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)
