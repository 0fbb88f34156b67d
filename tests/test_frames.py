import hashlib
import json
import math

import numpy as np
import pytest

from edgefield.functions.axes import AXES
from edgefield.operators import kernels as K
from edgefield.operators import measures
from edgefield.operators.maps import nearest_other, validity
from edgefield.plans import probe, report
from edgefield.sources import scene, selection

SEED = 20260906


@pytest.fixture(scope="module")
def image():
    return scene.scene()


def test_published_figures(image):
    m = lambda c: measures.measured(K.degraded(image, c, SEED))
    assert hashlib.sha256(image.tobytes()).hexdigest().startswith("115349bf")
    clean = measures.measured(image)
    assert round(clean["laplacian_var"], 2) == 2314.91 and round(clean["rms_contrast"], 2) == 64.19
    assert round(m({"motion_blur.exposure_ms": 40.0})["laplacian_var"], 2) == pytest.approx(125.17, abs=0.01)
    assert round(m({"fog.beta_per_m": 0.12})["rms_contrast"], 2) == 15.37
    assert round(m({"low_light.illuminance_lux": 0.5})["snr_db"], 2) == pytest.approx(2.81, abs=0.01)
    assert round(m({"low_light.illuminance_lux": 400.0})["snr_db"], 2) == 27.38


@pytest.mark.parametrize("name", sorted(AXES))
def test_kernels_are_pure_and_mild_at_the_benign_end(image, name):
    before = image.copy()
    np.random.seed(1)
    state = np.random.get_state()[1].tolist()
    kernel, _, field = name.partition(".")
    rest = {f"{a.degradation}.{a.field}": a.from_severity(0.0) for a in AXES.values() if a.degradation == kernel and a.field != field}
    one = K.degraded(image, {name: AXES[name].from_severity(1.0)}, 3)
    assert (one == K.degraded(image, {name: AXES[name].from_severity(1.0)}, 3)).all()
    assert (image == before).all() and np.random.get_state()[1].tolist() == state
    assert (kernel in K.STOCHASTIC) == bool((one != K.degraded(image, {name: AXES[name].from_severity(1.0)}, 4)).any())
    mild = K.degraded(image, {name: AXES[name].from_severity(0.0), **rest}, 3)
    assert np.abs(mild.astype(int) - image).mean() < 40


@pytest.mark.parametrize("name,metric,rises", [("motion_blur.exposure_ms", "laplacian_var", False), ("defocus.subject_distance_m", "laplacian_var", True), ("fog.beta_per_m", "rms_contrast", False), ("low_light.illuminance_lux", "snr_db", True), ("jpeg.quality", "blockiness", False)])
def test_physics_is_monotone(image, name, metric, rises):
    axis = AXES[name]
    values = np.linspace(axis.lo, axis.hi, 7)
    got = [measures.measured(K.degraded(image[:128, :128].copy(), {name: float(v)}, 3))[metric] for v in values]
    rank = np.corrcoef(np.argsort(np.argsort(got)), np.arange(7))[0, 1]
    assert (rank if rises else -rank) > 0.8


def test_steps_are_checked_and_ordered():
    order = [k for k, _ in K.steps({"jpeg.quality": 50.0, "low_light.illuminance_lux": 5.0, "fog.beta_per_m": 0.01, "defocus.subject_distance_m": 2.0})]
    assert order == ["fog", "defocus", "low_light", "jpeg"]
    assert dict(K.steps({"motion_blur.exposure_ms": 10.0}))["motion_blur"]["angular_velocity_deg_s"] == 60.0
    assert dict(K.steps({"motion_blur.exposure_ms": 10.0}, {"motion_blur.exposure_ms": 1.0, "motion_blur.direction_deg": 90.0}))["motion_blur"]["exposure_ms"] == 10.0
    for bad in ({"fog.beta_per_m": 9.0}, {"fog.nothing": 1.0}, {"nothing.x": 1.0}):
        with pytest.raises(ValueError):
            K.steps(bad)
    with pytest.raises(TypeError):
        K.degraded(np.zeros((4, 4), np.uint8), {"fog.beta_per_m": 0.1}, 1)


def test_frames_on_spark_are_those_of_numpy(spark):
    frames = scene.frames(spark, 3, 96)
    out = {r.image_id: bytes(r.pixels) for r in K.apply(frames, {"fog.beta_per_m": 0.05, "low_light.illuminance_lux": 20.0}, 5).collect()}
    for i in range(3):
        assert out[i] == K.degraded(scene.scene(96, SEED + i), {"fog.beta_per_m": 0.05, "low_light.illuminance_lux": 20.0}, 5).tobytes()
    got = {r.image_id: r for r in measures.measure(frames, ["image_id"]).collect()}
    assert got[1].blockiness == pytest.approx(measures.measured(scene.scene(96, SEED + 1))["blockiness"])


def test_a_search_over_frames(spark):
    frames = scene.frames(spark, 3, 96)
    clean = probe.wave(frames, {"clean": {}}, probe.BrightBoxes, SEED)
    truths = clean.selectExpr("image_id", "label", "CAST(row_number() OVER (PARTITION BY image_id, label ORDER BY x0, y0) AS INT) AS gt_idx", "x0", "y0", "x1", "y1")
    base, found = probe.search_axis(frames, truths, "fog.beta_per_m", probe.BrightBoxes, SEED, steps=9, verify=0)
    assert base == pytest.approx(1.0) and found.status == "located" and 0 <= found.lower < found.upper <= 0.12
    store = spark.createDataFrame([("a", 0.5)], "store_key string, map50 double")
    wanted = spark.createDataFrame([("a",), ("b",)], "store_key string")
    assert [r.store_key for r in probe.missing(wanted, store).collect()] == ["b"]
    assert {r.store_key: r.hit for r in probe.remembered(wanted, store).collect()} == {"a": True, "b": False}


def test_manifest_and_pixels(spark, tmp_path):
    image = scene.scene(96)
    (tmp_path / "a.bgr").write_bytes(image.tobytes())
    data = {"images": [{"file": "a.bgr", "objects": [{"label": "car", "box": [0, 0, 5, 5]}, {"label": "cat", "box": [0, 0, 1, 1]}, {"label": "car", "box": [1, 1, 5, 5]}]}, {"file": "missing.bgr", "objects": []}, {"file": "c.bgr", "objects": []}]}
    (tmp_path / "manifest.json").write_text(json.dumps(data))
    frames, truths = selection.manifest(spark, str(tmp_path / "manifest.json"), ["car"], limit=2)
    assert frames.count() == 2 and [(r.gt_idx, r.x0) for r in truths.orderBy("gt_idx").collect()] == [(1, 0.0), (2, 1.0)]
    (row,) = selection.with_pixels(frames, f"{tmp_path}/*.bgr").collect()
    assert row.file == "a.bgr" and row.sha256 == hashlib.sha256(image.tobytes()).hexdigest()
    lines = spark.createDataFrame([("% bbGt",), ("Car 1 2 3 4 0 0",), ("",), ("Bus 1 x 3 4",), ("Bus 1",)], "value string")
    assert [(r.cls, r.x1, r.y1) for r in selection.parse_annotations(lines).collect()] == [("Car", 4.0, 6.0)]


def test_maps(spark):
    cells = spark.createDataFrame([(i, j, i + j > 5) for i in range(6) for j in range(6)], "i int, j int, failed boolean")
    got = {(r.i, r.j): r.distance for r in nearest_other(cells).collect()}
    for (i, j), d in got.items():
        assert d == min(max(abs(i - a), abs(j - b)) for a in range(6) for b in range(6) if (a + b > 5) != (i + j > 5))
    same = cells.selectExpr("i", "j", "true AS failed")
    assert {r.distance for r in nearest_other(same).collect()} == {1_000_000}
    found = cells.selectExpr("i", "j", "CASE WHEN i = 3 AND j = 2 THEN true ELSE failed END AS failed")
    r = validity(cells, found).first()
    assert (r.n_wrong, r.valid) == (1, True)


def test_report_rules(spark):
    f = spark.createDataFrame([("a", "located", 2.0, 1.0), ("b", "located", 1.0, 2.0), ("c", "passes_throughout", None, None)], "axis string, status string, lower double, upper double")
    c = spark.createDataFrame([("a", 50.0), ("b", 101.0)], "axis string, percent double")
    assert {(r.axis, r.rule) for r in report.broken_rules(f, c, ["x"] * 4).collect()} == {("a", "bounds"), ("b", "percent"), ("", "limitations")}
    text = json.loads(report.rendered({"id": 1}, c, f, {"ms": None, "x": {"value": 1, "unit": "ms", "source": "s"}}, ["x"] * 5))
    assert list(text)[:3] == ["run", "coverage", "findings"] and text["measurements"]["ms"] == "not measured"
    assert {r.image for r in report.with_evidence(f, spark.createDataFrame([("a", "1.png")], "axis string, image string")).collect()} == {"1.png", "set-level"}


def test_ledger_files(spark, tmp_path):
    from edgefield.operators.ledgers import latest
    from edgefield.sources import ledger

    rows = spark.createDataFrame([("r1", "p1", "{}", 1, 0.5, 10, "x", "d"), ("r2", "p1", "{}", 1, 0.4, 10, "x", "d")], "run_id string, probe_id string, condition string, seed int, map50 double, n_frames int, pipeline string, dataset string")
    path = str(tmp_path / "ledger")
    ledger.append_probes(rows, path)
    ledger.append_probes(rows.withColumn("seed", rows.seed + 1).withColumn("map50", rows.map50 / 2), path)
    got = latest(ledger.run_records(spark, path, "r1", ["run_id", "probe_id", "seed", "map50"]), ["run_id", "probe_id"], ["seed"]).collect()
    assert [(r.probe_id, r.map50) for r in got] == [("p1", 0.25)]
    with pytest.raises(ValueError):
        ledger.append_probes(rows.drop("map50"), path)


def test_area_resize_is_block_means_and_fractions():
    image = np.random.default_rng(3).integers(0, 256, (12, 18, 3), dtype=np.uint8)
    half = measures.area_resized(image, 9)
    want = np.rint(image.reshape(6, 2, 9, 2, 3).astype(float).mean(axis=(1, 3)))
    assert half.shape == (6, 9, 3) and (half == want).all()
    assert measures.area_resized(image, 18) is image
    odd = measures.area_resized(np.repeat(image[:1], 5, 0)[:, :7], 3)  # 5 x 7 to 2 x 3: each new pixel covers 7 / 3 columns
    row = image[0, :7].astype(float)
    cover = np.array([[max(0, min(x + 1, (k + 1) * 7 / 3) - max(x, k * 7 / 3)) for x in range(7)] for k in range(3)]) / (7 / 3)
    assert odd.shape == (2, 3, 3) and (odd == np.rint(cover @ row)[None]).all()
    assert measures.mean_linear(np.full((4, 4, 3), 255, np.uint8)) == 1.0


def test_pins_records_and_coupled_maps(spark):
    frames = scene.frames(spark, 2, 96)
    clean = probe.wave(frames, {"c": {}}, probe.BrightBoxes, 7)
    truths = clean.where("score > 0.5").selectExpr("image_id", "label", "CAST(row_number() OVER (PARTITION BY image_id, label ORDER BY x0, y0) AS INT) AS gt_idx", "x0", "y0", "x1", "y1")
    assert probe.pinned({"low_light.illuminance_lux": 5.0}, {"low_light.exposure_ms": 3.0, "fog.airlight": 0.5}) == {"low_light.exposure_ms": 3.0}
    with pytest.raises(ValueError):
        probe.wave(frames, {"x": {"low_light.illuminance_lux": 5.0}}, probe.BrightBoxes, 7, fixed={"low_light.nothing": 1.0})
    told = probe.record(frames, "p", {"low_light.illuminance_lux": 5.0}, 7, {"low_light.exposure_ms": 3.0})
    assert told["steps"][0]["parameters"]["exposure_ms"] == 3.0 and told["degraded"]["mean_level"] < told["clean"]["mean_level"]
    got = {(r.i, r.j): r.map50 for r in probe.coupled_map(frames, truths, ("motion_blur.exposure_ms", [0.0, 30.0]), ("low_light.illuminance_lux", [400.0, 1.0]), probe.BrightBoxes, 7, lambda ms, lux: {"low_light.exposure_ms": max(ms, 1.0)}).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)} and got[0, 1] <= got[0, 0]


def test_digest_filter(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(name.encode() * 10)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = spark.createDataFrame([("a", digest(b"a" * 10).upper()), ("b", digest(b"a" * 10)), ("d", digest(b""))], "file string, sha256 string")
    assert [r.file for r in selection.intact(wanted, str(tmp_path)).collect()] == ["a"]


def test_frames_of_one_size_go_through_together_as_they_would_alone(spark):
    rng = np.random.default_rng(4)
    sizes = {1: (8, 8), 2: (8, 8), 3: (9, 17), 4: (8, 8), 5: (1, 3), 6: (70, 64)}
    images = {i: rng.integers(0, 256, (*hw, 3), dtype=np.uint8) for i, hw in sizes.items()}
    images[4][:] = 9  # a flat frame
    frames = spark.createDataFrame([(i, *x.shape[:2], x.tobytes(), "clash") for i, x in images.items()], "image_id long, height int, width int, pixels binary, value string")
    conditions = [(n, a.from_severity(s)) for n, a in AXES.items() for s in (0.0, 1.0)]
    got = {(r.image_id, r.axis, r.value): r for r in K.sweep(frames.unionByName(frames.where("image_id = 1")), conditions, SEED, measures.measured_stack, measures.NAMES).collect()}
    assert len(got) == len(images) * len(conditions)
    for (i, axis, value), r in got.items():
        alone = K.degraded(images[i], {axis: value}, SEED)
        assert r.sha256 == hashlib.sha256(alone.tobytes()).hexdigest()
        told = measures.measured(alone)
        assert [r[n] for n in measures.NAMES] == pytest.approx([told[n] for n in measures.NAMES], abs=1e-9)
    assert K.sweep(frames.limit(0), conditions, SEED, measures.measured_stack, measures.NAMES).count() == 0
    with pytest.raises(ValueError):
        K.sweep(frames, [("fog.beta_per_m", 9.0)], SEED, measures.measured_stack, measures.NAMES)
    batch = frames.toPandas()
    assert sorted(i for rows, _ in K.stacks(batch, 400) for i in rows) == list(range(6)) and max(s.shape[2] // 3 for _, s in K.stacks(batch, 400)) == 2


def test_the_spectrum_of_a_stack_is_that_of_each_frame(image):
    g = measures.grey(image[:61, :47])
    g -= g.mean()
    power = np.abs(np.fft.fftshift(np.fft.fft2(g * np.outer(np.hanning(61), np.hanning(47)).astype(np.float32))))
    rings: dict[int, list[float]] = {}
    for y in range(61):
        for x in range(47):
            rings.setdefault(int(math.hypot(y - 30, x - 23)), []).append(power[y, x])
    profile = [np.mean(rings[k]) / np.mean(rings[0]) for k in range(23)]
    i = next(k for k, v in enumerate(profile) if v < 0.5)
    assert float(measures.mtf50(g)) == pytest.approx(0.5 * (i - 1 + (profile[i - 1] - 0.5) / (profile[i - 1] - profile[i])) / 23)
