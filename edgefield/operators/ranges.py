"""Ranges of an order: what a global sort or one window over all rows would say, without one task that holds them all."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _indexed(rows: DataFrame, value: str, cuts: list[float], out: str) -> DataFrame:
    """out: how many of the cuts are at or below the value. Nulls come first, NaN last, as in a sort."""
    splits = [-math.inf, *(cuts or [0.0]), math.inf]
    at = rows.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(-math.inf)))
    return Bucketizer(splits=splits, inputCol="_v", outputCol=out, handleInvalid="keep").transform(at).drop("_v")


def ordered_ranges(rows: DataFrame, value: str, tie: str, out: str, parts: int = 512) -> DataFrame:
    """Adds out, a number that rises in the order of (value, tie), equal for about three shares of 1/parts of the rows at most.

    Cuts are quantiles of the value; a value that is three of them or more is a range of its own, cut again by quantiles of the
    tie, so neither crowded values nor a value that many rows share make a large range. The driver holds 2 * parts numbers.
    Only rows that share both value and tie stay together whatever their number."""
    shares = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    at = lambda c: F.percentile_approx(F.col(c).cast("double"), shares, 10 * parts)
    found = rows.agg(at(value).alias("v"), at(tie).alias("t")).first()
    values, ties = (Counter(c for c in cs or [] if math.isfinite(c)) for cs in found)
    marked = _indexed(_indexed(rows, value, sorted(values), "_i"), tie, sorted(ties), "_j")
    # the cut at a range's lower end where many rows share it
    shared = F.lit([math.nan, *(v if values[v] > 2 else math.nan for v in sorted(values))])
    is_shared = F.coalesce(F.get(shared, F.col("_i").cast("int")) == F.when(~F.isnan(value), F.col(value).cast("double")), F.lit(False))
    place = F.col("_i").cast("long") * 2 + F.when(is_shared, 0).otherwise(1)
    return marked.withColumn(out, place * (parts + 2) + F.when(is_shared, F.col("_j").cast("long")).otherwise(0)).drop("_i", "_j")


def first_ranks(rows: DataFrame, group: list[str], value: str, out: str, parts: int = 512) -> DataFrame:
    """group, a numeric value and out: rank() of the value within its group, which may hold any share of the rows.

    Equal values are counted first and are one row here; what stands before a range comes from sums by range."""
    counted = ordered_ranges(rows.groupBy(*group, value).agg(F.count("*").alias("_n")), value, "_n", "_r", parts)
    ahead = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.groupBy(*group, "_r").agg(F.sum("_n").alias("_m")).select(*group, "_r", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counted.join(before, [*group, "_r"]).select(*group, value, (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + 1).alias(out))
