import threading

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from edgefield.plans import probe
from edgefield.sources import scene
from edgefield.sources.store import ProbeStore

KIND = "dataset string, frames long, pipeline string, condition map<string,double>, seed long, map50 double"


def probes(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind)


@pytest.fixture
def store(spark, tmp_path):
    return ProbeStore(spark, f"file://{tmp_path}/store")


def row(value, map50, seed=1, **more):
    return ("set", 10, "boxes", {"fog.beta_per_m": value, **more}, seed, map50)


def found(store, wanted):
    return [(r.hit, r.map50) for r in sorted(store.get(wanted.drop("map50").withColumn("n", F.monotonically_increasing_id()).coalesce(1), ["map50"]).collect(), key=lambda r: r.n)]


def test_hits_misses_and_retries(spark, store):
    wanted = probes(spark, [row(0.1 + 0.2, None), row(0.3, None, seed=2), row(-0.0, None), row(0.3, None, **{"jpeg.quality": 5.0})])
    assert found(store, wanted) == [(False, None)] * 4 and store.records() is None
    store.put(probes(spark, [row(0.3, 0.5), row(0.0, 0.25)]))
    assert found(store, wanted) == [(True, 0.5), (False, None), (True, 0.25), (False, None)]
    store.put(probes(spark, [row(0.3, 0.75)]))
    assert found(store, wanted)[0] == (True, 0.75) and store.records().count() == 2
    store.put(probes(spark, [row(0.3, 0.1), row(0.3, 0.2)]), ["map50"])
    assert found(store, wanted)[0] == (True, 0.2)
    with pytest.raises(Exception, match="no nulls"):
        store.put(probes(spark, [("set", None, "boxes", {"a": 1.0}, 1, 0.5)]))
    with pytest.raises(Exception, match="no nulls"):
        store.put(probes(spark, [row(None, 0.5)]))


def test_marks_in_names_are_no_separators(spark, store):
    store.put(probes(spark, [("a|1", 10, "b", {"x": 1.0}, 1, 0.5)]))
    wanted = probes(spark, [("a", 10, "1|b", {"x": 1.0}, 1, None), ('a|1', 10, "b", {"x": 1.0}, 1, None), ('a","p":"', 10, "b", {}, 1, None)])
    assert found(store, wanted) == [(False, None), (True, 0.5), (False, None)]


def test_compaction_keeps_what_others_put(spark, store):
    for i in range(4):
        store.put(probes(spark, [row(float(i), i / 10), row(100.0, i / 10)]))
    live = store._live(store._entries())
    real = store._written

    def interrupted(keyed):
        batch = real(keyed)
        store._written = real
        store.put(probes(spark, [row(100.0, 0.9), row(200.0, 0.8)]))  # published while the compaction writes
        return batch

    store._written = interrupted
    store.compact()
    wanted = probes(spark, [row(float(i), None) for i in (0, 1, 2, 3, 100, 200)])
    want = [(True, 0.0), (True, 0.1), (True, 0.2), (True, 0.3), (True, 0.9), (True, 0.8)]
    assert found(store, wanted) == want
    assert len(store._live(store._entries())) == 2 and len(live) == 4
    assert store.vacuum(older_than_s=-1) == 4
    assert found(store, wanted) == want and len(store._entries()) == 2


def test_an_unpublished_batch_is_not_there(spark, store):
    store.put(probes(spark, [row(1.0, 0.5)]))
    keyed = store.records().withColumn("bucket", F.lit(0)).withColumn("map50", F.lit(0.99))
    store._written(keyed)  # its writer died before it was published
    assert found(store, probes(spark, [row(1.0, None)])) == [(True, 0.5)]
    assert store.vacuum(older_than_s=3600) == 0 and store.vacuum(older_than_s=-1) == 1


def test_two_writers_lose_nothing(spark, store):
    def write(k):
        for i in range(3):
            store.put(probes(spark, [row(float(10 * k + i), k / 10)]))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store.compact()
    assert store.records().count() == 9


def test_batches_with_other_results(spark, store):
    store.put(probes(spark, [row(1.0, 0.5)]))
    store.put(probes(spark, [(*row(2.0, 0.5), "x")], KIND + ", note string"))
    assert {r.note for r in store.records().collect()} == {None, "x"}


def test_a_search_is_served_from_the_store(spark, store):
    frames = scene.frames(spark, 3, 96)
    truths = probe.wave(frames, {"clean": {}}, probe.BrightBoxes, 7).select("image_id", "label", F.row_number().over(Window.partitionBy("image_id", "label").orderBy("x0", "y0")).alias("gt_idx"), "x0", "y0", "x1", "y1")
    memory = probe.Memory(store, "scene", 3, "bright boxes")
    plain = probe.search_axis(frames, truths, "fog.beta_per_m", probe.BrightBoxes, 7, steps=5, verify=0)
    runs = []
    real = probe.wave
    probe.wave = lambda *a, **k: (runs.append(len(a[1])), real(*a, **k))[1]
    try:
        first = probe.search_axis(frames, truths, "fog.beta_per_m", probe.BrightBoxes, 7, steps=5, verify=0, memory=memory)
        asked = sum(runs)
        again = probe.search_axis(frames, truths, "fog.beta_per_m", probe.BrightBoxes, 7, steps=5, verify=0, memory=memory)
        assert first == again == plain and sum(runs) == asked == store.records().count() == 1 + plain[1].probes_used
    finally:
        probe.wave = real
