"""Run reports: coverage first, findings after it, and the rules they keep."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_MEASURED = "not measured"


def figure(value: Column, unit: Column, source: Column) -> Column:
    """A measurement with its unit and source, or null: never 0 or an empty text for what was not measured."""
    return F.when(value.isNotNull() & (F.coalesce(unit, F.lit("")) != ""), F.struct(value.alias("value"), unit.alias("unit"), source.alias("source")))


def broken_rules(findings: DataFrame, coverage: DataFrame, limitations: list[str]) -> DataFrame:
    """Rows that break a rule: located findings have ordered bounds, coverage is a percentage, five limitations are told."""
    bounds = findings.where((F.col("status") == "located") & (F.col("lower").isNull() | F.col("upper").isNull() | (F.col("lower") > F.col("upper")))).select("axis", F.lit("bounds").alias("rule"))
    share = coverage.where(F.col("percent").isNull() | (F.col("percent") < 0) | (F.col("percent") > 100)).select("axis", F.lit("percent").alias("rule"))
    out = bounds.unionByName(share)
    if sum(bool(x.strip()) for x in limitations) < 5:
        out = out.unionByName(findings.sparkSession.createDataFrame([("", "limitations")], "axis string, rule string"))
    return out


def with_evidence(findings: DataFrame, frames: DataFrame) -> DataFrame:
    """Findings with the frame that shows them; what has none of its own gets the set's."""
    return findings.join(frames, "axis", "left").withColumn("image", F.coalesce("image", F.lit("set-level")))


def rendered(run: dict[str, Any], coverage: DataFrame, findings: DataFrame, measurements: dict[str, dict[str, Any] | None], limitations: list[str]) -> str:
    """The report as JSON, coverage before findings. A run has a handful of axes, so its rows fit the driver."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.orderBy("axis").collect()]
    return json.dumps({"run": run, "coverage": rows(coverage), "findings": rows(findings), "measurements": {k: v or NOT_MEASURED for k, v in measurements.items()}, "limitations": limitations}, indent=2)
