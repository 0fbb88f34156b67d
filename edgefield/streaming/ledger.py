"""The probe ledger as a stream: retries dropped by key, verdicts kept per run and axis, windows over its time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, folder: str, name: str = "*", batch_files: int | None = None) -> DataFrame:
    """A stream over a folder of ledger files, with the schema of those that are there; name is a pattern of their names. A batch takes
    all files that are there, or no more than batch_files of them."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", name).parquet(folder).schema).option("pathGlobFilter", name)
    stream = (reader.option("maxFilesPerTrigger", batch_files) if batch_files else reader).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def records(stream: DataFrame) -> DataFrame:
    """run_id, probe_id, event_id, axis, failed: events as ledger records. A retry repeats a probe; the record with the least event_id counts."""
    return stream.select(F.col("user_id").alias("run_id"), F.pmod("event_id", F.lit(64)).alias("probe_id"), "event_id", F.col("event_type").alias("axis"), (F.col("value") < 50).alias("failed"))


_STATE = "probes array<long>, events array<long>, axes array<string>, failed array<boolean>"
_OUT = "run_id long, axis string, n_failed long, n_passed long"


def _observed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What holds of each probe of a run, which is as many entries as it has probes; and counts of all axes that were ever reported."""
    held = {p: (e, a, f) for p, e, a, f in zip(*state.get)} if state.exists else {}
    axes = {a for _, a, _ in held.values()}
    for pdf in batches:
        axes |= set(pdf["axis"])
        for p, e, a, f in zip(pdf["probe_id"].tolist(), pdf["event_id"].tolist(), pdf["axis"].tolist(), pdf["failed"].tolist()):
            if p not in held or e < held[p][0]:
                held[p] = (e, a, f)
    state.update((list(held), *map(list, zip(*held.values()))))
    count = lambda axis, failed: sum(a == axis and f == failed for _, a, f in held.values())
    yield pd.DataFrame([(key[0], a, count(a, True), count(a, False)) for a in sorted(axes)], columns=["run_id", "axis", "n_failed", "n_passed"])


def verdicts(stream: DataFrame) -> DataFrame:
    """Running verdict counts of each run and axis, as state that outlives a restart."""
    return records(stream).groupBy("run_id").applyInPandasWithState(_observed, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def sliding(stream: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by windows that overlap, one every step, written once the watermark has passed them."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "top")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bouts of each run: records no further apart than the gap, with begin, end (of the last record) and count."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.select("run_id", F.col("w.start").alias("start"), "last", "n")


def windows(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and axis, written once the watermark has passed a window."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "top")


def drained(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], Any]) -> None:
    """Runs a stream over all that is there now; sink gets each batch and its number, and writes it under that number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
