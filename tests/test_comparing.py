import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgefield.functions import geometry as G
from edgefield.operators import agreement as A
from edgefield.operators import kernels as K
from edgefield.operators import lateral
from edgefield.operators import lenses as lens
from edgefield.plans import probe
from edgefield.sources import scene

RESULTS = "arm string, run int, probe_id string, map50 double"


def test_agreement_is_that_of_each_two_arms(spark):
    rng = random.Random(5)
    rows = [(arm, run, f"p{p}", rng.choice([0.1, 0.2, 0.3, None])) for arm in "abcde" for run in range(3) for p in range(40) if rng.random() < 0.7]
    rows += rows[:30] + [(None, 0, "p1", 0.1), ("a", None, "p1", 9.0), ("a", 0, None, 9.0), ("z", 0, "alone", 0.5)]
    held = {}
    for arm, run, p, v in rows:
        if None not in (arm, run, p, v):
            held[arm, p] = min(held.get((arm, p), (run, v)), (run, v))
    want = []
    for a, b in itertools.combinations(sorted({x for x, _ in held}), 2):
        ps = [p for x, p in held if x == a and (b, p) in held]
        if ps:
            apart = [abs(held[a, p][1] - held[b, p][1]) for p in ps]
            want.append((a, b, len(ps), sum(x == 0 for x in apart), max(apart)))
    df = spark.createDataFrame(rows, RESULTS).withColumn("v", F.lit("clash")).withColumn("base", F.lit("clash"))
    assert sorted(map(tuple, A.agreement(df).collect())) == want
    assert A.agreement(df.limit(0)).count() == 0


def test_agreement_of_odd_figures(spark):
    nan = float("nan")
    rows = [("a", 0, "p", nan), ("b", 0, "p", nan), ("a", 0, "q", 1.0), ("b", 0, "q", nan)]
    (r,) = A.agreement(spark.createDataFrame(rows, RESULTS)).collect()
    assert (r.compared, r.identical) == (2, 1) and math.isnan(r.max_abs_difference)


def test_repeats(spark):
    rows = [("same", r, p, v) for r in (1, 2) for p, v in (("p", 0.5), ("q", None))] * 2
    rows += [("gap", 1, "p", 0.5), ("gap", 2, "p", 0.5), ("gap", 2, "q", 0.5), ("apart", 1, "p", 0.5), ("apart", 2, "p", 0.25)]
    rows += [("null", 1, "p", 0.5), ("null", 2, "p", None), ("lone", 1, "p", 0.5), (None, 1, "p", 0.5)]
    got = {r.arm: (r.runs, r.probes, r.identical) for r in A.repeats(spark.createDataFrame(rows, RESULTS)).collect()}
    assert got == {"same": (2, 2, True), "gap": (2, 2, False), "apart": (2, 1, False), "null": (2, 1, False), "lone": (1, 1, True)}


def test_processors(spark):
    rows = [("a", 3, "x"), ("a", 3, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", 1, None), (None, 1, "x"), ("c", None, "x")]
    got = {r.arm: (r.cpu_model, r.cpu_models) for r in A.processors(spark.createDataFrame(rows, "arm string, run int, cpu_model string")).collect()}
    assert got == {"a": ("y", {"x": 2, "y": 1}), "b": ("unknown", {"unknown": 1})}


@pytest.mark.parametrize("k1, k2, p1, p2", [(0.0, 0.0, 0.0, 0.0), (0.4, 0.1, 0.0, 0.0), (0.2, 0.05, 0.003, -0.002), (-0.1, 0.0, 0.0, 0.001)])
def test_a_lens_undone_is_under_a_pixel(spark, k1, k2, p1, p2):
    w, h, lens = 256.0, 192.0, tuple(map(F.lit, (k1, k2, p1, p2)))
    points = spark.createDataFrame([(float(x), float(y)) for x in range(10, 246, 12) for y in range(10, 182, 12)], "x double, y double")
    assert points.agg(F.max(G.round_trip_px(F.lit(w), F.lit(h), lens, F.col("x"), F.col("y"))).alias("e")).first()["e"] < 0.01


def test_the_kernel_samples_where_the_lens_shows(spark):
    """A frame whose grey is its column number, distorted: each pixel has the column that the expression names."""
    w, h, p = 64, 48, {"k1": 0.3, "k2": 0.05, "p1": 0.002, "p2": -0.001}
    image = np.repeat(np.tile(np.arange(w, dtype=np.uint8) * 3, (h, 1))[:, :, None], 3, axis=2)
    out = K.lens_distortion(image, p, None)[:, :, 0] / 3
    f, cx, cy = 0.9 * w, (w - 1) / 2, (h - 1) / 2
    pts = [(x, y) for x in range(0, w, 7) for y in range(0, h, 7)]
    d = G.distorted((F.col("x") - cx) / f, (F.col("y") - cy) / f, tuple(F.lit(p[k]) for k in ("k1", "k2", "p1", "p2")))
    for r in spark.createDataFrame(pts, "x int, y int").select("x", "y", (d["x"] * f + cx).alias("u"), (d["y"] * f + cy).alias("v")).collect():
        if 0 <= r.u <= w - 1 and 0 <= r.v <= h - 1:
            assert abs(out[r.y, r.x] - r.u) < 0.4


def test_letterbox_inverse(spark):
    box = (3.0, 5.0, 1200.0, 700.0)
    s = G.letterbox_scale(F.lit(1280.0), F.lit(720.0))
    into = G.into_letterbox(tuple(map(F.lit, box)), s)
    back = G.out_of_letterbox(into, s)
    row = spark.range(1).select(*[c.alias(f"i{k}") for k, c in enumerate(into)], *[c.alias(f"b{k}") for k, c in enumerate(back)]).first()
    assert list(row[:4]) == [1.5, 2.5, 600.0, 350.0] and list(row[4:]) == list(box)
    outside = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(G.into_letterbox(tuple(map(F.lit, (-9.0, 0.0, 9999.0, 1.0))), s))]).first()
    assert list(outside)[0] == 0.0 and list(outside)[2] == 640.0


def test_lateral_detections_are_the_waves(spark):
    frames = scene.frames(spark, 6, 96)
    want = probe.wave(frames, {"baseline": {}}, probe.BrightBoxes, 1).drop("probe_id")
    lateral.register(spark, "boxes_of_scene", probe.BrightBoxes)
    odd = frames.limit(1).select(F.lit(-1).cast("long").alias("image_id"), F.lit(5).alias("height"), "width", "pixels").unionByName(frames.limit(1).select(F.lit(-2).cast("long").alias("image_id"), "height", "width", F.lit(None).cast("binary").alias("pixels")))
    got = spark.sql("SELECT f.image_id, d.* FROM {f} f, LATERAL boxes_of_scene(f.image_id, f.height, f.width, f.pixels) d", f=frames.select(*odd.columns).unionByName(odd).repartition(3))
    rows = lambda df: sorted(map(tuple, df.select("image_id", "label", "score", "x0", "y0", "x1", "y1").collect()))
    assert rows(got) == rows(want) and rows(want)


def test_a_pipeline_is_built_once_a_process():
    seen = []
    for _ in range(3):
        lateral.loaded("once", lambda: seen.append(1) or "pipeline")
    assert seen == [1]


def test_lenses_at_once_are_the_columns_and_rows_do_not_grow(spark):
    lenses = spark.createDataFrame([(i, 320.0 + 31 * i, 240.0 + 47 * i, i / 20, i / 70, (i - 5) / 900, (3 - i) / 900) for i in range(12)], "id long, w double, h double, k1 double, k2 double, p1 double, p2 double")
    at = lenses.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(80))))
    px, py = F.pmod("i", F.lit(9)) / 8.0 * (F.col("w") - 1), F.floor(F.col("i") / 9) / 8.0 * (F.col("h") - 1)
    one_by_one = at.groupBy("id").agg(F.max(G.round_trip_px(F.col("w"), F.col("h"), tuple(map(F.col, ("k1", "k2", "p1", "p2"))), px, py)).alias("e"))
    got = lens.worst_round_trip(lenses, "id", at_once=5)
    assert dict(got.collect()) == dict(one_by_one.collect())
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
