"""Two-dimensional maps of verdicts: edges, uncovered cells, nearest cells of the other verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(cells: DataFrame) -> DataFrame:
    """cells: i, j, failed. Sides where neighbours differ: left (between i-1 and i) and top (between j-1 and j)."""
    left = F.lag("failed").over(Window.partitionBy("j").orderBy("i"))
    top = F.lag("failed").over(Window.partitionBy("i").orderBy("j"))
    both = cells.withColumn("_l", left).withColumn("_t", top).select("i", "j", F.expr("stack(2, 'left', _l != failed, 'top', _t != failed) AS (side, edge)"))
    return both.where("edge").select("i", "j", "side")


def in_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """cells: i, j, x, y; regions: axis (x or y), a, b, ends in either order and inclusive. Adds uncovered: any region holds the cell."""
    value = F.when(F.col("axis") == "x", F.col("x")).otherwise(F.col("y"))
    inside = value.between(F.least("a", "b"), F.greatest("a", "b"))
    hit = cells.join(F.broadcast(regions), inside, "left_semi").select("i", "j", F.lit(True).alias("_hit"))  # an axis has two regions at most
    return cells.join(hit, ["i", "j"], "left").withColumn("uncovered", F.coalesce("_hit", F.lit(False))).drop("_hit")


def nearest_other(cells: DataFrame, far: int = 1_000_000) -> DataFrame:
    """cells: i, j, failed (not null). Chebyshev distance of each cell to the nearest with another verdict; far if there is none.

    Two passes: windows along i say how far the nearest cell of either verdict is within a column, and each row of the map then
    takes the best column as an array of its own. No cell is joined with a rim; a row holds as many cells as the map is wide."""
    column = Window.partitionBy("j").orderBy("i")
    below, above = column.rowsBetween(Window.unboundedPreceding, 0), column.rowsBetween(0, Window.unboundedFollowing)

    def away(verdict: Column) -> Column:
        at = F.when(verdict, F.col("i"))
        return F.least(F.col("i") - F.last(at, ignorenulls=True).over(below), F.first(at, ignorenulls=True).over(above) - F.col("i"), F.lit(far))

    near = cells.select("i", "j", "failed", away(F.col("failed")).alias("to_failed"), away(~F.col("failed")).alias("to_passed"))
    rows = near.groupBy("i").agg(F.collect_list(F.struct("j", "failed", "to_failed", "to_passed")).alias("row"))

    def nearest(c: Column) -> Column:
        gap = F.transform("row", lambda o: F.greatest(F.abs(o["j"] - c["j"]), F.when(c["failed"], o["to_passed"]).otherwise(o["to_failed"])))
        return F.struct(c["j"].alias("j"), c["failed"].alias("failed"), F.least(F.array_min(gap), F.lit(far)).alias("distance"))

    return rows.select("i", F.inline(F.transform("row", nearest)))


def survival(rows: DataFrame, wide: int) -> DataFrame:
    """rows: map, i, j. The share of a map's rows that lie at or beyond each of its wide x wide cells in both directions: map, i, j, value.

    Rows are counted by cell first; what is summed along rows and columns then has wide x wide rows a map. Rows with a null, or outside
    the map, are not counted."""
    inside = rows.select("map", "i", "j").na.drop().where(F.col("i").between(0, wide - 1) & F.col("j").between(0, wide - 1))
    counted = inside.groupBy("map", "i", "j").agg(F.count("*").alias("n"))
    axis = F.sequence(F.lit(0), F.lit(wide - 1))
    every = counted.select("map").distinct().withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    full = every.join(counted, ["map", "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    beyond = full.withColumn("n", F.sum("n").over(Window.partitionBy("map", "j").orderBy(F.desc("i"))))
    beyond = beyond.withColumn("n", F.sum("n").over(Window.partitionBy("map", "i").orderBy(F.desc("j"))))
    return beyond.select("map", "i", "j", (F.col("n") / F.max("n").over(Window.partitionBy("map"))).alias("value"))


def validity(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Cells whose verdict is wrong, and whether every one lies within a cell of the true edge."""
    wrong = truth.join(found.withColumnRenamed("failed", "said"), ["i", "j"]).where("said != failed").select("i", "j")
    near = nearest_other(truth)
    return near.join(wrong, ["i", "j"]).agg(F.count("*").alias("n_wrong"), F.coalesce(F.max("distance") <= 1, F.lit(True)).alias("valid"))
