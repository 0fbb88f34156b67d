"""Rounds planned from the ledger as a stream: each batch plans the next wave of the runs that it reports on, and of no others.

Under one folder, every batch has its own place, written over when the batch is repeated: ledger/batch=N/bucket=B with the batch's
records, plans/batch=N with a row for each run that it planned and the run's next wave in it, a bounded number of probes. Nothing is
kept in memory between batches, so a restart plans what the stream would have planned, and the same records in one batch or in many
end in the same plan of every run.

Records: run_id, probe_id, axis, value, map50, seen (whatever orders a probe's retries; the least counts). A record without run or
probe is of none and goes. Repeated records change nothing; a batch without records plans nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgefield.plans import rounds

_RECORD = ("run_id", "probe_id", "axis", "value", "map50", "seen")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")


def recorded(spark: SparkSession, to: str, until: int, records: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The ledger as it was after a batch, each probe of a run once; of the runs of records alone where they are given. Only their
    buckets are read: their numbers come to the driver, at most as many as there are buckets."""
    held = spark.read.option("basePath", f"{to}/ledger").parquet(f"{to}/ledger").where(F.col("batch") <= until)
    if records is not None:
        own = [r[0] for r in records.select(_bucket(buckets)).distinct().collect()]
        held = held.where(F.col("bucket").isin(own)).join(records.select("run_id").distinct().hint("merge"), "run_id", "left_semi")
    return held.groupBy("run_id", "probe_id").agg(F.min_by(F.struct("axis", "value", "map50"), "seen").alias("r")).select("run_id", "probe_id", "r.axis", "r.value", "r.map50")


def planner(runs: DataFrame, axes: DataFrame, to: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. runs and axes as plan_rounds takes them. A run's records lie in one bucket of each batch."""

    def plan(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = f"{to}/ledger/batch={number}"
        records = batch.select(*_RECORD).where("run_id IS NOT NULL AND probe_id IS NOT NULL").withColumn("bucket", _bucket(buckets))
        records.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(here)
        written = spark.read.schema(records.schema).parquet(here)
        if written.isEmpty():
            return
        touched = written.select("run_id").distinct().hint("merge")  # as many as the batch has runs: never a broadcast
        own = {"runs": runs.join(touched, "run_id", "left_semi"), "axes": axes.join(touched, "run_id", "left_semi"), "held": recorded(spark, to, number, written, buckets)}
        for name, df in own.items():  # read several times by a plan; each batch writes over the one before
            df.write.mode("overwrite").parquet(f"{to}/work/{name}")
        out = rounds.plan_rounds(*(spark.read.schema(df.schema).parquet(f"{to}/work/{name}") for name, df in own.items()))
        asked = out.probes.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("probe_id", "axis", "value", "command"))).alias("probes"))
        out.actions.join(asked.hint("merge"), "run_id", "left").write.mode("overwrite").parquet(f"{to}/plans/batch={number}")

    return plan


def _last(spark: SparkSession, to: str, names: list[str]) -> DataFrame:
    last = F.max_by(F.struct(*names, "batch"), "batch")
    return spark.read.parquet(f"{to}/plans").groupBy("run_id").agg(last.alias("p")).select("run_id", "p.*")


def actions(spark: SparkSession, to: str) -> DataFrame:
    """What each run does next: the last plan that a batch made of it."""
    return _last(spark, to, ["action", "requested", "paid", "spent", "remaining"])


def wanted(spark: SparkSession, to: str) -> DataFrame:
    """The probes of each run's last plan. None that is recorded is among them: a plan asks only for what its ledger lacks."""
    return _last(spark, to, ["probes"]).select("run_id", F.inline("probes"))


def dispatched(spark: SparkSession, to: str, until: int) -> DataFrame:
    """run_id, probe_id, command, attempt: what to start now, where `until` is the last batch whose probes may still be under way.

    A probe of the last plan that was sent in a batch after that is waited for; one sent before it, and still not recorded, is lost and
    asked for again. sent/ holds what was sent by which batch; note it with `sent` once it is under way."""
    want = wanted(spark, to).select("run_id", "probe_id", "command")
    if not _there(spark, f"{to}/sent"):
        return want.withColumn("attempt", F.lit(1).cast("long"))
    before = spark.read.parquet(f"{to}/sent").groupBy("run_id", "probe_id").agg(F.max("batch").alias("last"), F.countDistinct("batch").alias("times"))
    known = want.join(before, ["run_id", "probe_id"], "left")
    return known.where(F.col("last").isNull() | (F.col("last") < until)).select("run_id", "probe_id", "command", (F.coalesce("times", F.lit(0)) + 1).alias("attempt"))


def sent(started: DataFrame, to: str, number: int) -> None:
    """Notes what was started in a batch; noting it again changes nothing."""
    started.select("run_id", "probe_id").write.mode("overwrite").parquet(f"{to}/sent/batch={number}")
