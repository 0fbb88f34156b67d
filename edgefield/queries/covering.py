"""Coverage of axes, simulation against real photos, image and frame picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgefield.functions.geometry import exif_lux as lux_of
from edgefield.operators import coverage as C
from edgefield.sources.tables import table, truths
from edgefield.queries import fixtures as X


def _measured(spark, d):
    """Three axes by return flag; values are lines, metrics fall with them."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("axis"), F.col("l_linenumber").cast("double").alias("value"), (100.0 - 8 * F.col("l_linenumber") + F.col("l_quantity") / 16).alias("metric"))


_MEASURED = "m AS (SELECT l_returnflag AS axis, l_linenumber::DOUBLE AS value, 100.0::DOUBLE - 8 * l_linenumber + l_quantity / 16 AS metric FROM lineitem)"


def population_median_sweep(spark, d):
    return C.population_sweep(_measured(spark, d))


def axis_coverage(spark, d):
    sweep = C.population_sweep(_measured(spark, d))
    axes = sweep.select("axis").distinct().select("axis", F.lit(0.5).alias("lo"), F.lit(8.0).alias("hi"))
    native = _measured(spark, d).where("value BETWEEN 2 AND 4").where("axis != 'N'").unionByName(_measured(spark, d).where("axis = 'N' AND value = 1").withColumn("metric", F.col("metric") + 100))
    r = lambda c: F.round(c, 9).alias(c)
    return C.axis_coverage(axes, sweep, native).select("axis", r("covered_lo"), r("covered_hi"), r("fraction"), F.size("uncovered").alias("n_uncovered"), F.round(F.aggregate("uncovered", F.lit(0.0), lambda a, u: a + u["to"] - u["from"]), 9).alias("uncovered_width"))


_CURVE = ((0.5, 0.05), (5.0, 0.2), (20.0, 0.4), (60.0, 0.55), (100.0, 0.6))


def _curve(spark):
    return spark.createDataFrame(_CURVE, "value double, map50 double")


_CURVE_SQL = "curve AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _CURVE) + ") t(value, map50))"
_LERP = """(SELECT CASE WHEN lo.value IS NULL THEN hi.map50 WHEN hi.value IS NULL THEN lo.map50 ELSE lo.map50 + (hi.map50 - lo.map50) * (({x} - lo.value) / (hi.value - lo.value)) END
  FROM (SELECT max(value) AS value, max_by(map50, value) AS map50 FROM curve WHERE value <= {x}) lo, (SELECT min(value) AS value, min_by(map50, value) AS map50 FROM curve WHERE value > {x}) hi)"""


def interp_curve(spark, d):
    """An interpolating as-of look-up of every event's value on a curve."""
    points = table(spark, d, "events").select("event_id", "value")
    return C.interpolated(points, "value", _curve(spark), "value", "map50", [], "map50").select("event_id", F.round("map50", 9).alias("map50"))


def exif_lux(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("t"), (1 + F.col("l_discount") * 100).alias("n"), (F.col("l_quantity") * 100).alias("iso"))
    return li.groupBy("l_linenumber").agg(F.count(lux_of(F.col("t"), F.col("n"), F.col("iso"))).alias("n_known"), F.count("*").alias("n"), F.round(F.max(lux_of(F.col("t"), F.col("n"), F.col("iso"))), 6).alias("brightest"), F.round(F.min(lux_of(F.col("t"), F.col("n"), F.col("iso"), F.lit(0.045))), 6).alias("darkest_corrected"))


def lux_bins(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("lux"))
    binned = C.equal_bins(rows, "lux", "event_id", 7)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("lux").alias("lo"), F.max("lux").alias("hi"), F.median("lux").alias("lux_median"))


def gap_summary(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("lux"), "event_type")
    bins = C.equal_bins(rows, "lux", "event_id", 7).groupBy("bin").agg(F.median("lux").alias("lux"), (F.sum((F.col("event_type") != "error").cast("long")) / F.count("*") * 0.6).alias("real"))
    bins = bins.withColumn("synthetic", F.when(F.col("bin") == 3, 0.1))
    out = C.gap_summary(C.compared_bins(bins, _curve(spark), 0.36), 12.0)
    return out.select("agree", "synthetic_only", "real_only", "direction", F.round("darkest_lux", 6).alias("darkest_lux"), F.round("darkest_real", 9).alias("darkest_real"), F.round("overstated_by", 6).alias("overstated_by"))


def axis_clip(spark, d):
    rows = table(spark, d, "events").select("event_id", C.uncertain(F.col("value"), 5.0, 80.0).alias("u"))
    return rows.groupBy("u.outside").agg(F.count("*").alias("n"), F.min("u.clipped").alias("lo"), F.max("u.clipped").alias("hi"))


def main_subject_filter(spark, d):
    """Images stay unless their largest box is of label 0; empty ones stay."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    main = truths(spark, d).groupBy("image_id").agg(F.max_by("label", F.struct(area, -F.col("label"), -F.col("gt_idx"))).alias("main_label"), F.count("*").alias("n"))
    return main.where("main_label != 0")


def relabel_sensitivity(spark, d):
    """Labels 1, 2 and 3 scored as 1; and a variant that leaves 2 and 3 out."""
    t = truths(spark, d)
    merged = t.withColumn("label", F.when(F.col("label").isin(1, 2, 3), 1).otherwise(F.col("label"))).withColumn("variant", F.lit("merged"))
    alone = t.where("label NOT IN (2, 3)").withColumn("variant", F.lit("alone"))
    return merged.unionByName(alone).groupBy("variant", "label").agg(F.count("*").alias("n"))


def evidence_pick(spark, d):
    """By order priority, one frame of licence 4 with few persons: the best induced score of at least 0.5, else the most lost; ties by id."""
    f = table(spark, d, "orders").select(
        "o_orderpriority", F.col("o_orderkey").alias("image_id"), (F.pmod("o_custkey", F.lit(8)) + 1).alias("licence"), F.pmod("o_orderkey", F.lit(4)).alias("baseline_tp"), (F.pmod("o_custkey", F.lit(10)) / 10.0).alias("person_share"),
        F.when(F.pmod("o_orderkey", F.lit(9)) < 3, F.pmod(F.col("o_orderkey") * 37, F.lit(100)) / 100.0).alias("fp_score"), F.pmod("o_custkey", F.lit(6)).alias("tp_loss"),
    )
    ok = f.where("licence = 4 AND baseline_tp > 0 AND person_share < 0.5")
    by = Window.partitionBy("o_orderpriority")
    first = by.orderBy((F.coalesce("fp_score", F.lit(0.0)) >= 0.5).desc(), F.when(F.col("fp_score") >= 0.5, F.col("fp_score")).otherwise(0.0).desc(), F.desc("tp_loss"), "image_id")
    out = ok.withColumn("k", F.row_number().over(first)).where("k = 1")
    return out.select("o_orderpriority", "image_id", F.when(F.col("fp_score") >= 0.5, "induced").otherwise("missed").alias("mode"), F.coalesce("fp_score", F.lit(0.0)).alias("fp_score"), "tp_loss")


_BINS = "b AS (SELECT ntile(7) OVER (ORDER BY value, event_id)::INT AS bin, value AS lux, event_type FROM events)"
QUERIES = {f.__name__: f for f in (population_median_sweep, axis_coverage, interp_curve, exif_lux, lux_bins, gap_summary, axis_clip, main_subject_filter, relabel_sensitivity, evidence_pick)}
SQL = {
    "population_median_sweep": f"WITH {_MEASURED} SELECT axis, value, median(metric) AS metric FROM m GROUP BY ALL",
    "axis_coverage": f"""WITH {_MEASURED}, s AS (SELECT axis, value, median(metric) AS metric FROM m GROUP BY ALL),
n AS (SELECT axis, metric FROM m WHERE value BETWEEN 2 AND 4 AND axis <> 'N' UNION ALL SELECT axis, metric + 100 FROM m WHERE axis = 'N' AND value = 1),
r AS (SELECT axis, min(metric) AS rl, max(metric) AS rh FROM s GROUP BY 1), q AS (SELECT axis, min(metric) AS nl, max(metric) AS nh FROM n GROUP BY 1),
c AS (SELECT axis, greatest(rl, nl) AS cl, least(rh, nh) AS ch FROM r JOIN q USING (axis)),
i AS (SELECT c.axis, cl, ch, t, (SELECT CASE WHEN lo.x IS NULL THEN hi.v WHEN hi.x IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * ((t - lo.x) / (hi.x - lo.x)) END
   FROM (SELECT max(metric) AS x, max_by(value, metric) AS v FROM s WHERE s.axis = c.axis AND metric <= t) lo, (SELECT min(metric) AS x, min_by(value, metric) AS v FROM s WHERE s.axis = c.axis AND metric > t) hi) AS v
   FROM c, LATERAL (VALUES (cl), (ch)) z(t)),
k AS (SELECT axis, any_value(ch) < any_value(cl) AS none, greatest(min(v), 0.5) AS a, least(max(v), 8.0) AS b FROM i GROUP BY axis)
SELECT axis, round(CASE WHEN NOT none THEN a END, 9) AS covered_lo, round(CASE WHEN NOT none THEN b END, 9) AS covered_hi, round(CASE WHEN none THEN 0.0 ELSE greatest(b - a, 0) / 7.5 END, 9) AS fraction,
  CASE WHEN none THEN 1 ELSE (a - 0.5 > 7.5e-6)::INT + (8.0 - b > 7.5e-6)::INT END AS n_uncovered,
  round(CASE WHEN none THEN 7.5 ELSE CASE WHEN a - 0.5 > 7.5e-6 THEN a - 0.5 ELSE 0 END + CASE WHEN 8.0 - b > 7.5e-6 THEN 8.0 - b ELSE 0 END END, 9) AS uncovered_width FROM k""",
    "interp_curve": f"WITH {_CURVE_SQL} SELECT event_id, round({_LERP.format(x='e.value')}, 9) AS map50 FROM events e",
    "exif_lux": "WITH l AS (SELECT l_linenumber, CASE WHEN l_tax <> 0 AND l_quantity <> 0 THEN 250.0::DOUBLE * (1 + l_discount * 100) * (1 + l_discount * 100) / (l_tax * (l_quantity * 100)) END AS lux FROM lineitem) SELECT l_linenumber, count(lux) AS n_known, count(*) AS n, round(max(lux), 6) AS brightest, round(min(lux * 0.045::DOUBLE / 0.18::DOUBLE), 6) AS darkest_corrected FROM l GROUP BY 1",
    "lux_bins": f"WITH {_BINS} SELECT bin, count(*) AS n, min(lux) AS lo, max(lux) AS hi, median(lux) AS lux_median FROM b GROUP BY 1",
    "gap_summary": f"""WITH {_CURVE_SQL}, {_BINS}, k AS (SELECT bin, median(lux) AS lux, sum((event_type <> 'error')::INT) / count(*) * 0.6::DOUBLE AS real_, CASE WHEN bin = 3 THEN 0.1::DOUBLE END AS given FROM b GROUP BY bin),
c AS (SELECT *, coalesce(given, {_LERP.format(x='k.lux')}) < 0.36 AS s, real_ < 0.36 AS r FROM k),
t AS (SELECT sum((s = r)::INT)::BIGINT AS agree, sum((s AND NOT r)::INT)::BIGINT AS so, sum((r AND NOT s)::INT)::BIGINT AS ro, min(lux) AS dl, min_by(real_, lux) AS dr, max(CASE WHEN r THEN lux END) AS bf FROM c)
SELECT agree, so AS synthetic_only, ro AS real_only, CASE WHEN so > ro THEN 'synthetic' WHEN ro > so THEN 'real' ELSE 'none' END AS direction, round(dl, 6) AS darkest_lux, round(dr, 9) AS darkest_real, round(CASE WHEN bf IS NULL THEN 12.0::DOUBLE / dl END, 6) AS overstated_by FROM t""",
    "axis_clip": "SELECT NOT value BETWEEN 5 AND 80 AS outside, count(*) AS n, min(least(greatest(value, 5.0), 80.0)) AS lo, max(least(greatest(value, 5.0), 80.0)) AS hi FROM events GROUP BY 1",
    "main_subject_filter": f"WITH {X.TRUTHS}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (x1 - x0) * (y1 - y0) DESC, label, gt_idx) AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM truths) SELECT image_id, label AS main_label, n FROM k WHERE rk = 1 AND label <> 0",
    "relabel_sensitivity": f"WITH {X.TRUTHS} SELECT 'merged' AS variant, CASE WHEN label IN (1, 2, 3) THEN 1 ELSE label END AS label, count(*) AS n FROM truths GROUP BY 2 UNION ALL SELECT 'alone', label, count(*) FROM truths WHERE label NOT IN (2, 3) GROUP BY 2",
    "evidence_pick": """WITH f AS (SELECT o_orderpriority, o_orderkey AS image_id, o_custkey % 8 + 1 AS licence, o_orderkey % 4 AS baseline_tp, (o_custkey % 10) / 10.0::DOUBLE AS person_share, CASE WHEN o_orderkey % 9 < 3 THEN (o_orderkey * 37 % 100) / 100.0::DOUBLE END AS fp, o_custkey % 6 AS tp_loss FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (coalesce(fp, 0) >= 0.5) DESC, CASE WHEN fp >= 0.5 THEN fp ELSE 0 END DESC, tp_loss DESC, image_id) AS rk FROM f WHERE licence = 4 AND baseline_tp > 0 AND person_share < 0.5)
SELECT o_orderpriority, image_id, CASE WHEN fp >= 0.5 THEN 'induced' ELSE 'missed' END AS mode, coalesce(fp, 0) AS fp_score, tp_loss FROM k WHERE rk = 1""",
}
