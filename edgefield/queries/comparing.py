"""Agreement of arms, inverses of the letterbox and of the lens, detections as a table function."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from edgefield.functions import geometry as G
from edgefield.operators import agreement as A
from edgefield.operators import lateral
from edgefield.operators.lenses import worst_round_trip
from edgefield.plans.probe import BrightBoxes
from edgefield.queries.recording import TILE, tiles
from edgefield.sources.tables import table


def _results(spark, d):
    """Line items as probes of three arms with five runs each: a probe's figure is its mean discount, in steps of a fortieth of a percent point."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.pmod("l_suppkey", F.lit(5)).alias("run"), F.pmod("l_partkey", F.lit(40)).alias("probe_id"), F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("cents"))
    return li.groupBy("arm", "run", "probe_id").agg((F.floor(F.sum("cents") * 4 / F.count("*")) / 40.0).alias("map50"))


def arm_agreement(spark, d):
    """For every two arms, on how many probes they agree to the bit, and how far they are apart at most."""
    return A.agreement(_results(spark, d)).select("base", "cand", "compared", "identical", F.round("max_abs_difference", 9).alias("max_abs_difference"))


def arm_repeats(spark, d):
    """Whether the runs of an arm repeat each other."""
    return A.repeats(_results(spark, d))


def arm_processors(spark, d):
    """The processors that the runs of each arm had."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.pmod("l_partkey", F.lit(97)).alias("run")).agg(F.sum("l_linenumber").alias("n"))
    runs = li.select("arm", "run", F.when(F.col("n") % 4 > 0, F.concat(F.lit("model "), (F.col("n") % 4).cast("string"))).alias("cpu_model"))
    return A.processors(runs).select("arm", "cpu_model", F.to_json("cpu_models").alias("cpu_models"))


def letterbox_back(spark, d):
    """Boxes of line items through the letterbox of their part's image, to whole pixels there and back: the largest shift and the least overlap."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 700).cast("double").alias("w"), (F.pmod("p_partkey", F.lit(50)) * 29 + 500).cast("double").alias("h"))
    x0, y0 = F.pmod(F.col("l_orderkey") * 7, F.lit(600)).cast("double"), F.pmod(F.col("l_suppkey") * 53, F.lit(400)).cast("double")
    boxes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + 2 * F.col("l_quantity")).alias("x1"), (y0 + 16 + F.col("l_quantity")).alias("y1"))
    box = tuple(F.least(c, side - 1) for c, side in zip(map(F.col, G.BOX), (F.col("w"), F.col("h")) * 2))
    scale = G.letterbox_scale(F.col("w"), F.col("h"))
    back = G.out_of_letterbox(tuple(F.floor(c + 0.5) for c in G.into_letterbox(box, scale)), scale)
    rows = boxes.join(p, "p_partkey").select("p_partkey", F.greatest(*[F.abs(a - b) for a, b in zip(box, back)]).alias("px"), G.iou(box, back).alias("overlap"))
    return rows.groupBy("p_partkey").agg(F.count("*").alias("n"), F.round(F.max("px"), 9).alias("shift_px"), F.round(F.min("overlap"), 9).alias("overlap"))


def lens_round_trip(spark, d):
    """For the lens of every part, 81 pixels undistorted and distorted again: the largest error, and whether it is under a pixel."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 16 + 320.0).alias("w"), (F.pmod(key, F.lit(50)) * 8 + 240.0).alias("h"), (F.pmod(key, F.lit(41)) / 100.0).alias("k1"), (F.pmod(key, F.lit(11)) / 100.0).alias("k2"),
        ((F.pmod(key, F.lit(7)) - 3) / 1000.0).alias("p1"), ((F.pmod(key, F.lit(5)) - 2) / 1000.0).alias("p2"),
    )
    return worst_round_trip(p, "p_partkey").groupBy("p_partkey").agg(F.round(F.max("error_px"), 6).alias("error_px")).withColumn("faithful", F.col("error_px") < 1)


def lateral_detections(spark, d):
    """What a table function detects in every vector's frame, asked for in SQL."""
    lateral.register(spark, "bright_boxes", partial(BrightBoxes, 2, 40.0))
    return spark.sql("SELECT f.image_id, b.* FROM {frames} f, LATERAL bright_boxes(f.image_id, f.height, f.width, f.pixels) b", frames=tiles(spark, d))


_R = "r AS (SELECT l_returnflag AS arm, l_suppkey % 5 AS run, l_partkey % 40 AS probe_id, (sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) * 4 // count(*))::DOUBLE / 40 AS map50 FROM lineitem GROUP BY ALL)"
QUERIES = {f.__name__: f for f in (arm_agreement, arm_repeats, arm_processors, letterbox_back, lens_round_trip, lateral_detections)}
SQL = {
    "arm_agreement": f"WITH {_R}, f AS (SELECT arm, probe_id, arg_min(map50, run) AS v FROM r GROUP BY ALL) SELECT a.arm AS base, b.arm AS cand, count(*) AS compared, count(*) FILTER (a.v = b.v) AS identical, round(max(abs(a.v - b.v)), 9) AS max_abs_difference FROM f a JOIN f b ON a.probe_id = b.probe_id AND a.arm < b.arm GROUP BY ALL",
    "arm_repeats": f"WITH {_R}, n AS (SELECT arm, count(DISTINCT run) AS runs FROM r GROUP BY 1), p AS (SELECT arm, probe_id, count(*) AS k, count(DISTINCT map50) AS vs FROM r GROUP BY ALL) SELECT arm, any_value(runs) AS runs, count(*) AS probes, bool_and(vs = 1 AND k = runs) AS identical FROM p JOIN n USING (arm) GROUP BY 1",
    "arm_processors": """WITH r AS (SELECT l_returnflag AS arm, l_partkey % 97 AS run, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY ALL), m AS (SELECT arm, run, CASE WHEN n % 4 > 0 THEN 'model ' || (n % 4) ELSE 'unknown' END AS m FROM r),
c AS (SELECT arm, m, count(*) AS n, min(run) AS first FROM m GROUP BY ALL) SELECT arm, arg_min(m, first) AS cpu_model, '{' || string_agg('"' || m || '":' || n, ',' ORDER BY m) || '}' AS cpu_models FROM c GROUP BY 1""",
    "letterbox_back": """WITH p AS (SELECT p_partkey, (p_size * 37 + 700)::DOUBLE AS w, (p_partkey % 50 * 29 + 500)::DOUBLE AS h, least(640.0::DOUBLE / (p_size * 37 + 700), 640.0::DOUBLE / (p_partkey % 50 * 29 + 500)) AS s FROM part),
b AS (SELECT p_partkey, s, least((l_orderkey * 7 % 600)::DOUBLE, w - 1) AS x0, least((l_suppkey * 53 % 400)::DOUBLE, h - 1) AS y0, least((l_orderkey * 7 % 600)::DOUBLE + 20 + 2 * l_quantity, w - 1) AS x1, least((l_suppkey * 53 % 400)::DOUBLE + 16 + l_quantity, h - 1) AS y1 FROM lineitem JOIN p ON p_partkey = l_partkey),
n AS (SELECT *, floor(least(640, x0 * s) + 0.5::DOUBLE) / s AS u0, floor(least(640, y0 * s) + 0.5::DOUBLE) / s AS v0, floor(least(640, x1 * s) + 0.5::DOUBLE) / s AS u1, floor(least(640, y1 * s) + 0.5::DOUBLE) / s AS v1 FROM b),
o AS (SELECT *, (least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0)) AS common FROM n)
SELECT p_partkey, count(*) AS n, round(max(greatest(abs(x0 - u0), abs(y0 - v0), abs(x1 - u1), abs(y1 - v1))), 9) AS shift_px, round(min(common / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - common)), 9) AS overlap FROM o GROUP BY 1""",
    "lens_round_trip": """WITH RECURSIVE p AS (SELECT p_partkey, p_size * 16 + 320::DOUBLE AS w, p_partkey % 50 * 8 + 240::DOUBLE AS h, (p_partkey % 41) / 100::DOUBLE AS k1, (p_partkey % 11) / 100::DOUBLE AS k2, (p_partkey % 7 - 3) / 1000::DOUBLE AS p1, (p_partkey % 5 - 2) / 1000::DOUBLE AS p2, i % 9 / 8::DOUBLE AS u, i // 9 / 8::DOUBLE AS v FROM part, range(81) r(i)),
q AS (SELECT *, 0.9::DOUBLE * greatest(w, h) AS f, (w - 1) / 2 AS cx, (h - 1) / 2 AS cy, u * (w - 1) AS px, v * (h - 1) AS py FROM p), n AS (SELECT *, (px - cx) / f AS a, (py - cy) / f AS b FROM q),
s AS (SELECT n.*, 0 AS k, a AS x, b AS y FROM n UNION ALL SELECT * REPLACE (k + 1 AS k, (a - (2 * p1 * x * y + p2 * (x * x + y * y + 2 * x * x))) / (1 + k1 * (x * x + y * y) + k2 * (x * x + y * y) * (x * x + y * y)) AS x, (b - (p1 * (x * x + y * y + 2 * y * y) + 2 * p2 * x * y)) / (1 + k1 * (x * x + y * y) + k2 * (x * x + y * y) * (x * x + y * y)) AS y) FROM s WHERE k < 20),
e AS (SELECT *, x * x + y * y AS r FROM s WHERE k = 20), g AS (SELECT p_partkey, greatest(abs((x * (1 + k1 * r + k2 * r * r) + (2 * p1 * x * y + p2 * (r + 2 * x * x))) * f + cx - px), abs((y * (1 + k1 * r + k2 * r * r) + (p1 * (r + 2 * y * y) + 2 * p2 * x * y)) * f + cy - py)) AS d FROM e)
SELECT p_partkey, round(max(d), 6) AS error_px, round(max(d), 6) < 1 AS faithful FROM g GROUP BY 1""",
    "lateral_detections": f"WITH {TILE}, c AS (SELECT image_id, list_sum(g) / 64 AS mean, y, x, (g[16 * y + 2 * x + 1] + g[16 * y + 2 * x + 2] + g[16 * y + 2 * x + 9] + g[16 * y + 2 * x + 10]) / 4 AS v FROM t, range(4) a(y), range(4) b(x)) SELECT image_id, 0::INT AS label, least(1::DOUBLE, (v - mean) / 128) AS score, 2.0::DOUBLE * x AS x0, 2.0::DOUBLE * y AS y0, 2.0::DOUBLE * x + 2 AS x1, 2.0::DOUBLE * y + 2 AS y1 FROM c WHERE v - mean > 40",
}
