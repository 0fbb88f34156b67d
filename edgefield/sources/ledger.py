"""Append-only ledgers as Parquet: probe records by run, and decisions numbered from what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("run_id", "probe_id", "condition", "seed", "map50", "n_frames", "pipeline", "dataset")


def append_probes(records: DataFrame, path: str) -> None:
    """Adds a wave's records; a missing field is an error before anything is written. Readers take the last of a probe."""
    absent = [c for c in REQUIRED if c not in records.columns]
    if absent:
        raise ValueError(f"records lack {', '.join(absent)}")
    records.write.mode("append").partitionBy("run_id").parquet(path)


def run_records(spark: SparkSession, path: str, run_id: str, columns: list[str]) -> DataFrame:
    """One run's records: its folder alone is read, and of that the columns asked for."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id).select(*columns)


def numbered(decisions: DataFrame, before: int, order: list[str]) -> DataFrame:
    """Decisions of one run with seq counting on from what stood before, and an id that sorts by it."""
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) + before
    return decisions.withColumn("seq", seq).withColumn("decision_id", F.format_string("%04d-agent-%03d", F.lit(0), "seq"))
