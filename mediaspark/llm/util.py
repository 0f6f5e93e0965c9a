"""Written tables that cut lineage, gapless numbering and joins that stand a hot key."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import save, scratch  # noqa: F401

#: Rows of a driver-checked table that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES for this session, unless it has a bound of its own: whole texts make batches of 64 MB by Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; otherwise unhinted, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def gapless(df: DataFrame, group: list[str], order: list[str], rows: int, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group is numbered in hash buckets of about 20,000 rows, each behind the sum of the buckets before it, so no task
    sees a whole group. ``df`` is read twice: give it as a saved table.
    """
    buckets = max(64, rows // 20_000)
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = keyed.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(starts, [*group, "_bucket"]).withColumn(out, F.col("_start") + F.col("_row")).drop("_bucket", "_start", "_row")


def attach(left: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int, spread: Column) -> DataFrame:
    """``left`` joined to ``table``, which holds in ``copies`` how many rows of ``left`` have a row's key.

    Keys with more than a quarter of a partition's fair share are salted: their rows of ``left`` are dealt by ``spread``
    and their rows of ``table`` are repeated. At most 4 x partitions keys can be that heavy, so their list, which is
    broadcast, is bounded whatever the data. Every task then has at most a quarter of a fair share of one key.
    """
    fair = max(1, total // (4 * partitions(left.sparkSession)))
    heavy = table.filter(F.col(copies) > fair).select(*keys, F.ceil(F.col(copies) / fair).cast("int").alias("_salts")).distinct()
    dealt = left.join(F.broadcast(heavy), keys, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")))).drop("_salts")
    salts = F.greatest(F.lit(1), F.when(F.col(copies) > fair, F.ceil(F.col(copies) / fair))).cast("int")
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("_salt", F.col("_salt").cast("bigint"))
    return dealt.withColumn("_salt", F.col("_salt").cast("bigint")).join(repeated, [*keys, "_salt"]).drop("_salt")


def parts_for(rows: int, each: int) -> int:
    return max(1, ceil(rows / each))


def row_key(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a 128-bit key (_k1, _k2) of doc_id and text that is never null; rows alike in both share it."""
    return df.withColumn("_k1", F.xxhash64(F.lit(1), "doc_id", text)).withColumn("_k2", F.xxhash64(text, F.lit(2), "doc_id"))
