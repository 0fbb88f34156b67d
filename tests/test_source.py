import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from edgefield.operators import kernels as K
from edgefield.sources import frames as S


@pytest.fixture()
def pack(tmp_path):
    """Twelve lines: files 0 to 6 are whole, 7 is missing, 8 cut off, 9 no image, then a line that is no JSON and a repeat of 1; a blank one between."""
    rng = np.random.default_rng(1)
    images = {f"i{i}.ppm": rng.integers(0, 256, (4 + i, 6, 3), dtype=np.uint8) for i in range(9)}
    for name, x in images.items():
        if name != "i7.ppm":
            body = x[..., ::-1].tobytes()
            (tmp_path / name).write_bytes(b"P6\n# made\n6 %d\n255\n" % len(x) + (body[:-1] if name == "i8.ppm" else body))
    (tmp_path / "i9.ppm").write_bytes(b"nothing")
    objects = [{"label": "car", "box": [0, 1, 2, 3.5]}, {"label": "ship", "box": [0, 0, 1, 1]}, {"label": "car", "box": [4, 5, 6, 7]}, {"label": None}, {"label": "person", "box": None}]
    lines = [json.dumps({"file": f"i{i}.ppm", "objects": objects[: i + 1], "height": "clash"}) for i in range(10)] + ["{no", json.dumps({"file": "i1.ppm", "objects": None})]
    manifest = tmp_path / "manifest.jsonl"
    manifest.write_text("\n".join(lines[:5]) + "\n  \n" + "\n".join(lines[5:]))
    return str(manifest), images, lines


def load(spark, path, schema=None, **options):
    spark.dataSource.register(S.Frames)
    reader = spark.read.format("frames").options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


@pytest.mark.parametrize("split", [1, 7, 64, 100, 1 << 20])
def test_every_line_is_read_once_whatever_the_ranges(spark, pack, split):
    path, images, _ = pack
    got = load(spark, path, split_bytes=split).orderBy("image_id").collect()
    assert [r.file for r in got] == [*(f"i{i}.ppm" for i in range(10)), None, "i1.ppm"]
    assert [r.problem for r in got] == [None] * 7 + ["missing", "pixels", "header", "line", None]
    raw = open(path, "rb").read()
    for r in got:
        assert r.file is None or raw[r.image_id :].split(b"\n")[0].startswith(b'{"file": "%s"' % r.file.encode())
        if r.problem is None:
            assert (r.height, r.width) == images[r.file].shape[:2] and bytes(r.pixels) == images[r.file].tobytes()


def test_a_limit_opens_no_file_beyond_it(spark, pack):
    path, _, lines = pack
    got = load(spark, path, limit=6).collect()
    assert len(got) == 6 and all(r.problem is None for r in got)
    assert load(spark, path, limit=6).rdd.getNumPartitions() == 1
    reader = S.FrameReader({"path": path, "limit": "6", "split_bytes": "10"}, ["image_id"], S.Frames.decoders)
    assert reader.partitions()[-1].end == sum(len(x) + 1 for x in lines[:6]) + 3  # the rest of the manifest is no task's
    assert load(spark, path, limit=0).count() == load(spark, path, limit=99).count() == 12


def test_only_what_the_schema_asks_for_is_read(spark, pack, tmp_path):
    path, images, _ = pack
    sizes = {r.file: r.height for r in load(spark, path, "file string, height int").collect()}
    assert sizes["i8.ppm"] == 12 and sizes["i7.ppm"] is None  # a header is enough
    for f in tmp_path.glob("*.ppm"):
        f.unlink()
    assert load(spark, path, "image_id long, objects array<struct<label:string,box:array<double>>>").count() == 12
    with pytest.raises(PySparkException):
        load(spark, path, "image_id long, colour string").collect()


def test_bounds_on_the_id_leave_out_ranges(spark, pack):
    path, _, _ = pack
    ids = sorted(r.image_id for r in load(spark, path, "image_id long").collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, path, "image_id long", split_bytes=50, bounds="true").where(f"image_id >= {ids[3]} AND image_id < {ids[5]}")
        assert sorted(r.image_id for r in df.collect()) == ids[3:5]
        assert df.rdd.getNumPartitions() <= (ids[5] - ids[3]) // 50 + 2 < load(spark, path, "image_id long", split_bytes=50).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_frames_that_cannot_be_read_are_left_out_and_counted(spark, pack):
    path, images, _ = pack
    good, seen = S.frames(spark, path, split_bytes=200)
    out = K.apply(good.select("image_id", "file", "height", "width", "pixels"), {"fog.beta_per_m": 0.05}, 3).collect()
    assert sorted(r.file for r in out) == sorted([*(f"i{i}.ppm" for i in range(7)), "i1.ppm"])
    assert all(bytes(r.pixels) == K.degraded(images[r.file], {"fog.beta_per_m": 0.05}, 3).tobytes() for r in out)
    assert seen.get == {"found": 8, "missing": 1, "undecodable": 3}


def test_truths_of_known_labels_in_order(spark, pack):
    path, _, _ = pack
    good, _ = S.frames(spark, path, limit=3)
    last = max(r.image_id for r in good.collect())
    got = sorted(map(tuple, S.truths(good, ["person", "car"]).where(f"image_id = {last}").collect()))
    assert got == [(last, 1, 1, 0.0, 1.0, 2.0, 3.5), (last, 1, 2, 4.0, 5.0, 6.0, 7.0)]
    assert S.truths(load(spark, path, limit=5), ["person"]).collect()[0][1:] == (0, 1, None, None, None, None)


def test_an_empty_manifest_has_no_rows_and_none_is_an_error(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n \n")
    assert load(spark, str(tmp_path / "m.jsonl")).count() == 0
    with pytest.raises(PySparkException):
        load(spark, str(tmp_path / "other.jsonl")).collect()
