"""Comparing all rows of a bucket without one task for a bucket and without a row for each pair.

A bucket of n rows is parted into about n / size chunks by a hash of the id. Each row goes to one block for every chunk of
its bucket, its own included, and a block compares its two chunks. A block holds about two chunks of rows however large the
bucket is, and the result of a block has at most one row for each row in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def into_blocks(rows: DataFrame, bucket: str, count: str, id_: str, size: int) -> DataFrame:
    """Adds block (a hash of the bucket and its two chunks), side (0: the first chunk, 1: the second one) and alike (one chunk by itself)."""
    chunks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_), F.lit(11)), chunks).cast("int")
    out = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    return out.select(
        *rows.columns,
        F.xxhash64(bucket, lo, hi).alias("block"),
        F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).cast("int").alias("side"),
        (F.col("_own") == F.col("_other")).alias("alike"),
    )
