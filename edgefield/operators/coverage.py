"""What part of an axis a validation set covers, and interpolating look-ups of a value on a curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgefield.operators.ranges import ordered_ranges


def segments(curve: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """A curve's points as segments: by, x0, y0, x1, y1, and its ends x_lo, x_hi. Points of equal x count in the order of y."""
    order = Window.partitionBy(*by).orderBy(x, y)
    whole = Window.partitionBy(*by)
    return curve.select(
        *by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1"), F.min(x).over(whole).alias("x_lo"), F.max(x).over(whole).alias("x_hi")
    )


def interpolated(points: DataFrame, at: str, curve: DataFrame, x: str, y: str, by: list[str], out: str) -> DataFrame:
    """points with out: the curve at `at`, linear between its points and level beyond its ends. points has the columns by.

    Curves have few points; each is one array by key, so a look-up is an equi-join and a fold, whatever the number of points."""
    arrays = curve.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_c"))
    rows = points.join(arrays, by, "left") if by else points.crossJoin(F.broadcast(arrays))  # one row
    at_ = F.col(at)
    below, above = F.filter("_c", lambda p: p["x"] <= at_), F.filter("_c", lambda p: p["x"] > at_)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    line = a["y"] + (b["y"] - a["y"]) * ((at_ - a["x"]) / (b["x"] - a["x"]))
    return rows.withColumn(out, F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(line)).drop("_c")


def population_sweep(measured: DataFrame) -> DataFrame:
    """measured: axis, value, metric of every frame, read twice. The median over the frames at each value, exact.

    Quantiles that are off by a thousandth of the frames at most bound each median from both sides; what lies between them, about a fiftieth
    of the frames, is counted by metric, and of the rest only how many lie below. No group holds all its metrics."""
    rows = measured.select("axis", "value", F.col("metric").cast("double").alias("metric"))
    bounds = F.percentile_approx(F.when(F.isnan("metric"), math.inf).otherwise(F.col("metric")), [0.49, 0.51], 1000)
    groups = rows.groupBy("axis", "value").agg(bounds.alias("b"), F.count("metric").alias("n"))
    groups = groups.select(F.col("axis").alias("a"), F.col("value").alias("v"), F.col("b")[0].alias("lo"), F.when(F.col("b")[1] == math.inf, math.nan).otherwise(F.col("b")[1]).alias("hi"), "n")
    same = F.col("axis").eqNullSafe(F.col("a")) & F.col("value").eqNullSafe(F.col("v"))
    near = rows.join(F.broadcast(groups), same & (F.col("metric") <= F.col("hi")))  # one row for each axis and value
    counted = near.groupBy("a", "v", "n", F.when(F.col("metric") >= F.col("lo"), F.col("metric")).alias("m")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("a", "v").orderBy(F.asc_nulls_first("m")).rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("upto", upto)
    at = lambda place: F.max(F.when((F.col("upto") - F.col("k") <= place) & (place < F.col("upto")), F.col("m")))
    middle = counted.groupBy("a", "v").agg(at(F.floor((F.col("n") - 1) / 2)).alias("m0"), at(F.floor(F.col("n") / 2)).alias("m1"))
    median = F.when(F.col("m0") == F.col("m1"), F.col("m0")).otherwise(0.5 * F.col("m0") + 0.5 * F.col("m1"))
    middle = middle.select(F.col("a").alias("axis"), F.col("v").alias("value"), median.alias("metric"))
    return groups.select("a", "v").join(middle, same, "left").select(F.col("a").alias("axis"), F.col("v").alias("value"), "metric")


def column_figures(rows: DataFrame, names: list[str]) -> dict[str, tuple[float | None, float | None, float | None]]:
    """Least, most and exact median of columns of numbers, by name; nulls do not count, NaN comes last. rows is read three times; no names where it has none.

    As in population_sweep, quantiles bound each median, and only what lies between them is counted by value. No rows are grouped
    but those. The driver gets a handful of figures for each column."""
    if not names:
        return {}
    col = lambda c: F.col(f"`{c}`").cast("double")
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), col(c).alias("m")) for i, c in enumerate(names)))))
    quantiles = F.percentile_approx(F.when(F.isnan("m"), math.inf).otherwise(F.col("m")), [0.49, 0.51], 1000)
    told = each.groupBy("i").agg(quantiles.alias("q"), F.count("m").alias("n"), F.min("m").alias("least"), F.max("m").alias("most"))
    of = {names[r["i"]]: r for r in told.collect()}
    known = [c for c in names if c in of and of[c]["n"]]
    lo = {c: of[c]["q"][0] for c in known}
    hi = {c: math.nan if of[c]["q"][1] == math.inf else of[c]["q"][1] for c in known}
    medians = {}
    if known:
        below = rows.agg(*(F.count(F.when(col(c) < lo[c], 1)).alias(f"_{i}") for i, c in enumerate(known))).first()
        near = F.array(*(F.struct(F.lit(i).alias("i"), F.when((col(c) >= lo[c]) & (col(c) <= hi[c]), col(c)).alias("m")) for i, c in enumerate(known)))
        counted = rows.select(F.inline(near)).where("m IS NOT NULL").groupBy("i", "m").agg(F.count("*").alias("k"))
        ahead = F.get(F.lit(list(below)), F.col("i"))
        upto = ahead + F.sum("k").over(Window.partitionBy("i").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
        n = F.get(F.lit([of[c]["n"] for c in known]), F.col("i"))
        at = lambda place: F.max(F.when((F.col("upto") - F.col("k") <= place) & (place < F.col("upto")), F.col("m")))
        middle = counted.withColumn("upto", upto).groupBy("i").agg(at(F.floor((n - 1) / 2)).alias("m0"), at(F.floor(n / 2)).alias("m1"))
        median = F.when(F.col("m0") == F.col("m1"), F.col("m0")).otherwise(0.5 * F.col("m0") + 0.5 * F.col("m1"))
        medians = {known[r["i"]]: r["m"] for r in middle.select("i", median.alias("m")).collect()}
    return {c: (r["least"], r["most"], medians.get(c)) for c, r in of.items()}


def axis_coverage(axes: DataFrame, sweep: DataFrame, native: DataFrame) -> DataFrame:
    """axes: axis, lo, hi; sweep: axis, value, metric; native: axis, metric of undegraded frames.

    The native range is clipped to what the sweep reached, read back as axis values, and clipped to the axis. Adds covered_lo,
    covered_hi (null where nothing is reached), fraction and uncovered, the regions left."""
    reach = sweep.groupBy("axis").agg(F.min("metric").alias("r_lo"), F.max("metric").alias("r_hi"))
    span = native.groupBy("axis").agg(F.min("metric").alias("n_lo"), F.max("metric").alias("n_hi"))
    rows = axes.join(reach, "axis").join(span, "axis").withColumn("c_lo", F.greatest("n_lo", "r_lo")).withColumn("c_hi", F.least("n_hi", "r_hi"))
    rows = interpolated(rows, "c_lo", sweep, "metric", "value", ["axis"], "a")
    rows = interpolated(rows, "c_hi", sweep, "metric", "value", ["axis"], "b")
    none = (F.col("c_hi") < F.col("c_lo")) | (F.col("hi") <= F.col("lo"))
    lo, hi = F.greatest(F.least("a", "b"), "lo"), F.least(F.greatest("a", "b"), "hi")
    rows = rows.withColumn("covered_lo", F.when(~none, lo)).withColumn("covered_hi", F.when(~none, hi))
    width = F.col("hi") - F.col("lo")
    fraction = F.when(none, 0.0).otherwise(F.greatest(F.col("covered_hi") - F.col("covered_lo"), F.lit(0.0)) / width)
    region = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    whole = F.array(region(F.col("lo"), F.col("hi")))
    left = F.when(F.col("covered_lo") - F.col("lo") > width * 1e-6, F.array(region(F.col("lo"), F.col("covered_lo"))))
    right = F.when(F.col("hi") - F.col("covered_hi") > width * 1e-6, F.array(region(F.col("covered_hi"), F.col("hi"))))
    empty = F.array().cast("array<struct<from:double,to:double>>")
    return rows.select("axis", "lo", "hi", "covered_lo", "covered_hi", fraction.alias("fraction"), F.when(none, whole).otherwise(F.concat(F.coalesce(left, empty), F.coalesce(right, empty))).alias("uncovered"))


def compared_bins(bins: DataFrame, curve: DataFrame, threshold: float) -> DataFrame:
    """bins: bin, lux, real, and synthetic (null: taken from the curve). Adds gap and whether either fails."""
    rows = interpolated(bins, "lux", curve, "value", "map50", [], "on_curve")
    rows = rows.withColumn("synthetic", F.coalesce("synthetic", "on_curve"))
    return rows.withColumn("gap", F.col("real") - F.col("synthetic")).withColumn("synthetic_failed", F.col("synthetic") < threshold).withColumn("real_failed", F.col("real") < threshold)


def gap_summary(compared: DataFrame, boundary_lo: float) -> DataFrame:
    """One row: how often the two disagree and which way, and a bound on the gap where no real bin fails."""
    one = lambda c: F.sum(c.cast("long"))
    s, r = F.col("synthetic_failed"), F.col("real_failed")
    out = compared.agg(
        one(s == r).alias("agree"), one(s & ~r).alias("synthetic_only"), one(r & ~s).alias("real_only"), F.min("lux").alias("darkest_lux"), F.min_by("real", "lux").alias("darkest_real"), F.max(F.when(r, F.col("lux"))).alias("brightest_failing_lux")
    )
    way = F.when(F.col("synthetic_only") > F.col("real_only"), "synthetic").when(F.col("real_only") > F.col("synthetic_only"), "real").otherwise("none")
    return out.withColumn("direction", way).withColumn("overstated_by", F.when(F.col("brightest_failing_lux").isNull(), F.lit(boundary_lo) / F.col("darkest_lux")))


def equal_bins(rows: DataFrame, value: str, tie: str, k: int, ranges: int = 512) -> DataFrame:
    """Bins of equal counts in the order of value, the first ones larger by one where it does not divide.

    Ranks are counted within ranges of the value and ranges are summed up, so no task sorts all rows."""
    ranged = ordered_ranges(rows, value, tie, "_g", ranges)
    per = ranged.groupBy("_g").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand ranges
    before = per.select("_g", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(value, tie)) - 1 + F.col("_before")
    small, extra = F.floor(F.col("_all") / k), F.col("_all") % k
    first = extra * (small + 1)
    bin_ = F.when(rank < first, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - first) / F.greatest(small, F.lit(1))))
    return ranged.join(before, "_g").withColumn("bin", (bin_ + 1).cast("int")).drop("_g", "_before", "_all")


def uncertain(value: Column, lo: float, hi: float) -> Column:
    """Outside a model's range, and where it is clipped to."""
    return F.struct((~value.between(lo, hi)).alias("outside"), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)).alias("clipped"))
