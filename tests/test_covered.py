import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgefield import cli
from edgefield.functions.axes import AXES
from edgefield.operators import coverage
from edgefield.operators import kernels as K
from edgefield.operators import measures
from edgefield.plans import covered
from edgefield.sources import scene

SEED = 20260906


def brute(images, axis, values):
    """Coverage by plain interpolation: (covered interval, fraction)."""
    name = covered.SHOWN_BY[axis]
    sweep = [float(np.median([measures.measured(K.degraded(i, {axis: v}, SEED))[name] for i in images])) for v in values]
    native = [measures.measured(i)[name] for i in images]
    lo, hi = max(min(native), min(sweep)), min(max(native), max(sweep))
    if hi < lo:
        return None, 0.0
    order = np.argsort(sweep)
    ends = sorted(float(np.interp(t, np.array(sweep)[order], np.array(values)[order])) for t in (lo, hi))
    a = AXES[axis]
    ends = [max(ends[0], a.lo), min(ends[1], a.hi)]
    return ends, max(ends[1] - ends[0], 0.0) / (a.hi - a.lo)


def test_coverage_of_a_run_is_that_of_its_frames(spark, tmp_path, capsys):
    images = [scene.scene(96, SEED + i) for i in range(4)]
    probed = {"fog.beta_per_m": [0.0, 0.03, 0.06, 0.09, 0.12], "jpeg.quality": [5.0, 50.0, 100.0], "lens_distortion.k1": [0.0, 0.4]}
    got = covered.described(scene.frames(spark, 4, 96), probed, SEED)
    assert got.keys() == {"fog.beta_per_m", "jpeg.quality"}
    for axis, r in got.items():
        ends, fraction = brute(images, axis, probed[axis])
        assert r["percent"] == round(100 * fraction, 2) < 100
        assert (r["covered_lower"], r["covered_upper"]) == (pytest.approx(tuple(ends)) if ends else (None, None))
        assert sum(u["width"] for u in r["uncovered"]) == pytest.approx((1 - fraction) * (AXES[axis].hi - AXES[axis].lo))
    with pytest.raises(ValueError):
        covered.measured(scene.frames(spark, 1, 96), {"fog.beta_per_m": [9.0]}, SEED)


def test_the_command_reports_what_the_set_covers(spark, tmp_path, capsys):
    files = {f"{i}.bgr": scene.scene(96, SEED + i) for i in range(2)}
    for name, image in files.items():
        (tmp_path / name).write_bytes(image.tobytes())
    objects = [{"label": "object", "box": [16, 16, 32, 32]}]
    (tmp_path / "manifest.json").write_text(json.dumps({"images": [{"file": f, "objects": objects} for f in files]}))
    assert cli.main(["run", "--dataset", str(tmp_path), "--axis", "fog.beta_per_m"]) == 0
    told = json.loads(capsys.readouterr().out)
    (c,) = told["coverage"]
    ends, fraction = brute(list(files.values()), "fog.beta_per_m", c["probed"])
    assert c["percent"] == round(100 * fraction, 2) < 100 and c["measure"] == "rms_contrast" and c["uncovered"]
    assert list(told) == ["run", "coverage", "findings"]


def test_frames_of_one_size_are_degraded_and_measured_together(spark, monkeypatch):
    stack = np.concatenate([scene.scene(96, SEED + i)[:40] for i in range(5)], axis=2)
    for q in (5.0, 50.0, 100.0):
        seen = K.degraded_stack(stack, {"jpeg.quality": q}, SEED)
        assert (seen == np.concatenate([K.degraded(np.ascontiguousarray(stack[..., k : k + 3]), {"jpeg.quality": q}, SEED) for k in range(0, 15, 3)], axis=2)).all()
    calls = []
    monkeypatch.setitem(K.KERNELS, "jpeg", lambda image, p, rng: calls.append(image.shape) or image)
    K.degraded_stack(stack, {"jpeg.quality": 50.0}, SEED)
    assert calls == [(40, 96, 15)]  # one call for all five
    assert measures.measured_stack(stack, ("blockiness",)).keys() == {"blockiness"}


def test_frames_are_degraded_once_and_blurred_by_no_more_weights_than_there_are(spark, monkeypatch):
    out = covered.covered(covered.measured(scene.frames(spark, 2, 96), {"fog.beta_per_m": [0.0, 0.06, 0.12]}, SEED))
    assert "MapInPandas" not in out._jdf.queryExecution().toString()  # what says it reads measurements, not frames
    pads, pad = [], np.pad
    monkeypatch.setattr(np, "pad", lambda a, widths, **k: pads.append(tuple(map(tuple, widths))) or pad(a, widths, **k))
    K.correlated(scene.scene(96, SEED), K.line_psf(20.0, 0.0))
    assert pads[0][0] == (0, 0) and pads[0][1][0] >= 10


@pytest.mark.parametrize("n", [1, 2, 3, 4, 999, 5000, 5001])
def test_medians_are_those_of_whole_groups(spark, n):
    metric = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN pmod(id * 7919, 1009) / 8.0 ELSE -double(id) END"
    rows = spark.range(6 * n).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' END AS axis", "double(id % 6 DIV 2) AS value", f"CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN double(id) WHEN 2 THEN IF(id % 4 = 0, double('NaN'), 1.0D) WHEN 3 THEN 5.0D ELSE {metric} END AS metric")
    told = lambda df: sorted(str((r.axis, r.value, r.metric)) for r in df.collect())
    out = coverage.population_sweep(rows)
    assert told(out) == told(rows.groupBy("axis", "value").agg(F.median("metric").alias("metric")))
    assert "median" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_frames_without_colour_go_as_one_plane(monkeypatch):
    rng = np.random.default_rng(SEED)
    for h, w in ((8, 8), (17, 23)):
        stack = np.repeat(rng.integers(0, 256, (h, w, 5)).astype(np.uint8), 3, axis=2)
        planes = K.levels(stack)
        assert planes.shape == (h, w, 5) and K.levels(rng.integers(0, 256, (h, w, 15)).astype(np.uint8)) is None
        for axis, a in AXES.items():
            for severity in (0.0, 0.3, 1.0):
                condition = {axis: a.from_severity(severity)}
                got = K.degraded_levels(planes, condition, SEED)
                if axis.startswith("low_light"):
                    assert got is None  # noise differs by channel
                else:
                    assert (np.repeat(got, 3, axis=2) == K.degraded_stack(stack, condition, SEED)).all()
                    assert (got[..., 2:3] == K.degraded_levels(planes[..., 2:3], condition, SEED)).all()  # alone as in its stack


@pytest.mark.parametrize("n", [1, 2, 3, 4, 999, 5000, 5001])
def test_figures_of_columns_are_those_of_whole_columns(spark, n):
    rows = spark.range(n).selectExpr(
        "CAST(NULL AS DOUBLE) AS none", "double(id) AS `a.b|0.5`", "IF(id % 4 = 0, double('NaN'), 1.0D) AS nan", "IF(id % 3 > 0, double('NaN'), 1 - id) AS most_nan", "5.0D AS same",
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN pmod(id * 7919, 1009) / 8.0 ELSE -double(id) END AS mixed", "IF(id % 2 = 0, double('-Infinity'), double('Infinity')) AS ends",
    )
    got = coverage.column_figures(rows, rows.columns)
    for c in rows.columns:
        want = rows.agg(F.min(f"`{c}`"), F.max(f"`{c}`"), F.median(f"`{c}`")).first()
        assert str(got[c]) == str(tuple(want)), c
    assert coverage.column_figures(rows.limit(0), rows.columns) == {}


def test_a_frame_is_one_row_of_measurements(spark):
    probed = {"fog.beta_per_m": [0.0, 0.12, 0.12, -0.0], "low_light.illuminance_lux": [5.0], "lens_distortion.k1": [0.1]}
    rows = covered.measured(scene.frames(spark, 3, 96), probed, SEED)
    assert rows.columns == ["fog.beta_per_m", "low_light.illuminance_lux", "fog.beta_per_m|0.0", "fog.beta_per_m|0.12", "low_light.illuminance_lux|5.0"]
    image = scene.scene(96, SEED)
    want = [measures.measured(i)[m] for i, m in ((image, "rms_contrast"), (image, "snr_db"), *((K.degraded(image, {a: v}, SEED), covered.SHOWN_BY[a]) for a, v in (("fog.beta_per_m", 0.0), ("fog.beta_per_m", 0.12), ("low_light.illuminance_lux", 5.0))))]
    assert rows.count() == 3 and any(np.allclose(tuple(r), want, rtol=1e-12) for r in rows.collect())
    assert covered.covered(covered.measured(scene.frames(spark, 1, 96), {"lens_distortion.k1": [0.1]}, SEED)).collect() == []
    assert covered.covered(covered.measured(scene.frames(spark, 1, 96).limit(0), probed, SEED)).collect() == []
