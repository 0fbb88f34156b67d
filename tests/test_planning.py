import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from edgefield.plans import rounds
from edgefield.streaming import planning

RECORD = "run_id long, probe_id string, axis string, value double, map50 double, seen long"
AXIS = "fog.beta_per_m"


def defined(spark, ids):
    runs = spark.createDataFrame([(i, 1.0, 0.01, 0.0, 0.6, 5) for i in ids], "run_id long, budget double, price double, prepaid double, share double, verify int")
    axes = spark.createDataFrame([(i, AXIS, 0, 1 / 32, None) for i in ids], "run_id long, axis string, place int, width double, cap int")
    return runs, axes


def record(run, s, map50, seen):
    return (run, f"{AXIS}#{s}", AXIS, 0.12 * s, map50, seen)


RECORDS = [
    (1, "baseline", None, None, 0.6, 0), *[record(1, s, 0.6 if s < 0.6 else 0.1, i + 1) for i, s in enumerate((0.0, 0.25, 0.5, 0.75, 1.0, 0.625))],
    (2, "baseline", None, None, 0.5, 7), record(2, 0.0, 0.5, 8), record(2, 0.5, 0.1, 9), (3, "x", AXIS, 0.01, 0.2, 10),
]
RETRIES = [record(1, 0.625, 0.6, 99), record(2, 0.5, 0.6, 98), record(2, 0.0, 0.5, 8), (None, "x", AXIS, 0.0, 0.1, 0), (2, None, AXIS, 0.0, 0.1, 0)]


def plain(df, *names):
    return sorted(map(str, df.select(*names).collect()))


def results(spark, to):
    return plain(planning.actions(spark, to), "run_id", "action", "requested", "paid", "spent"), plain(planning.wanted(spark, to), "run_id", "probe_id", "value")


def test_one_batch_or_many_a_repeated_one_and_a_restart_plan_the_same(spark, tmp_path):
    runs, axes = defined(spark, (1, 2, 3, 4))
    df = lambda rows: spark.createDataFrame(rows, RECORD).withColumn("bucket", F.lit("clash"))
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    planning.planner(runs, axes, one, 4)(df(RECORDS + RETRIES), 0)
    batches = [RETRIES[:1] + RECORDS[:4], [], RECORDS[4:8], RECORDS[4:6] + RECORDS[8:] + RETRIES[1:]]
    for n, rows in enumerate(batches):
        planning.planner(runs, axes, many, 4)(df(rows), n)  # a planner of its own for each batch: nothing is kept in memory
        if n == 2:
            planning.planner(runs, axes, many, 4)(df(rows), n)
    got = results(spark, many)
    assert got == results(spark, one) and len(got[0]) == 3
    whole = rounds.plan_rounds(*defined(spark, (1, 2, 3)), planning.recorded(spark, one, 0))
    assert got == (plain(whole.actions, "run_id", "action", "requested", "paid", "spent"), plain(whole.probes, "run_id", "probe_id", "value"))


def test_only_runs_of_a_batch_are_planned_in_it(spark, tmp_path):
    runs, axes = defined(spark, (1, 2))
    plan = planning.planner(runs, axes, str(tmp_path), 4)
    plan(spark.createDataFrame(RECORDS[:7], RECORD), 0)
    plan(spark.createDataFrame(RECORDS[7:9], RECORD), 1)
    planned = spark.read.parquet(f"{tmp_path}/plans").select("run_id", "batch").collect()
    assert sorted(map(tuple, planned)) == [(1, 0), (2, 1)]
    assert sorted(os.listdir(tmp_path / "ledger")) == ["batch=0", "batch=1"]


def test_lost_probes_are_asked_for_again_and_those_under_way_are_not(spark, tmp_path):
    runs, axes = defined(spark, (2,))
    to = str(tmp_path)
    plan = planning.planner(runs, axes, to, 4)
    plan(spark.createDataFrame(RECORDS[7:10], RECORD), 0)  # the scan lacks 0.25, 0.75 and 1
    first = planning.dispatched(spark, to, 0)
    assert {r.attempt for r in first.collect()} == {1} and first.count() == 3
    planning.sent(first, to, 0)
    assert planning.dispatched(spark, to, 0).count() == 0
    plan(spark.createDataFrame([record(2, 0.25, 0.5, 20)], RECORD), 1)
    assert planning.dispatched(spark, to, 0).count() == 0
    again = planning.dispatched(spark, to, 1)
    assert sorted((round(float(r.probe_id.split("@")[1]) / 0.12, 6), r.attempt) for r in again.collect()) == [(0.75, 2), (1.0, 2)]


def plans(spark, run):
    """The plans of all that Spark executed during run(), as they were at their end."""
    store = spark._jsparkSession.sharedState().statusStore()
    told = lambda: {x.executionId(): x.physicalPlanDescription() for x in map(store.executionsList().apply, range(store.executionsList().size()))}
    before = set(told())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return [text for i, text in told().items() if i not in before]


@pytest.mark.parametrize("name", ["round_findings", "round_plan", "round_probes", "streamed_plan", "streamed_probes", "grid_crossing"])
def test_no_table_of_runs_or_axes_is_sent_to_the_driver_for_a_join(spark, name):
    ran = plans(spark, lambda: entry.queries()[name](spark, "/root/testdata/sf0.001").collect())
    assert any("SortMergeJoin" in text for text in ran)
    assert not any("BroadcastHashJoin" in text for text in ran)
