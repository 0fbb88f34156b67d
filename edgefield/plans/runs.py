"""Searches of many runs as one Spark job, and the comparison of their findings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgefield.functions.axes import AXES
from edgefield.plans.search import Outcome, grid_crossing, locate

_FOUND = "run_id long, axis string, status string, lower double, upper double, probes_used int"


def _verdict(edge: float, recovers: float | None):
    """Whether a severity fails: from the edge on, up to where the response recovers, if it does."""
    return lambda s: s >= edge and (recovers is None or pd.isna(recovers) or s < recovers)


def searched(responses: DataFrame, width: float, verify: int = 0) -> DataFrame:
    """responses: run_id, axis, edge, recovers (both severities; recovers may be null). What the search finds for each, to a bracket of width."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                axis, fails = AXES[r.axis], _verdict(r.edge, r.recovers)
                o = locate(axis, lambda values: [fails(axis.to_severity(v)) for v in values], width * (axis.hi - axis.lo), verify)  # noqa: B023
                rows.append((r.run_id, r.axis, o.status, o.lower, o.upper, o.probes_used))
            yield pd.DataFrame(rows, columns=["run_id", "axis", "status", "lower", "upper", "probes_used"])

    return responses.select("run_id", "axis", "edge", "recovers").mapInPandas(run, _FOUND)


def grid_probes(responses: DataFrame, steps: int = 33) -> DataFrame:
    """Every probe of a uniform grid over each response: idx from benign to severe, s, failed."""
    out = responses.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("s", F.col("idx") / (steps - 1.0))
    return out.withColumn("failed", (F.col("s") >= F.col("edge")) & F.coalesce(F.col("s") < F.col("recovers"), F.lit(True)))


def compared_to_grid(responses: DataFrame, levels: tuple[int, ...] = (33, 17, 9, 5), verify: int = 5) -> DataFrame:
    """run_id, steps, valid, saving: the verified search against a grid of so many steps, each run for itself.

    It is valid where both locate a bracket and the middles of the two lie no further apart than a step of the grid."""

    def middle(o: Outcome) -> float:
        return (o.lower + o.upper) / 2

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                axis, fails = AXES[r.axis], _verdict(r.edge, r.recovers)
                for steps in levels:
                    step = (axis.hi - axis.lo) / (steps - 1)
                    values = [axis.from_severity(i / (steps - 1)) for i in range(steps)]
                    grid = grid_crossing(axis, [(v, fails(axis.to_severity(v))) for v in values])
                    o = locate(axis, lambda vs: [fails(axis.to_severity(v)) for v in vs], step, verify)  # noqa: B023
                    both = grid.status == o.status == "located"
                    rows.append((r.run_id, steps, both and abs(middle(grid) - middle(o)) <= step * (1 + 1e-9), steps / o.probes_used))
            yield pd.DataFrame(rows, columns=["run_id", "steps", "valid", "saving"])

    return responses.select("run_id", "axis", "edge", "recovers").mapInPandas(run, "run_id long, steps int, valid boolean, saving double")


def _on_axis(pick) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for a in AXES.values() for x in (a.name, pick(a))]), F.col("axis"))


def mild_end(lower: Column, upper: Column) -> Column:
    """The severity at which a bracket begins, so that either end of an axis may be the severe one."""
    lo, hi, severe_hi = _on_axis(lambda a: a.lo), _on_axis(lambda a: a.hi), _on_axis(lambda a: a.severe_end == "hi")
    return F.when(severe_hi, (lower - lo) / (hi - lo)).otherwise((hi - upper) / (hi - lo))


def width_and_middle(lower: Column, upper: Column) -> tuple[Column, Column]:
    """Of a bracket; null where it is open."""
    return upper - lower, (lower + upper) / 2


def witness(probes: DataFrame) -> DataFrame:
    """probes: run_id, axis, value, failed. The failing probe of least axis value of each run and axis; those without one have none."""
    return probes.where("failed").groupBy("run_id", "axis").agg(F.min_by(F.struct(*[c for c in probes.columns if c not in ("run_id", "axis")]), "value").alias("w")).select("run_id", "axis", "w.*")


def regressions(new: DataFrame, old: DataFrame) -> DataFrame:
    """new, old: run_id, axis, status, lower, upper. Adds outcome to new: whether a boundary moved to a milder condition, or appeared."""
    was = old.select("run_id", "axis", F.col("status").alias("old_status"), mild_end(F.col("lower"), F.col("upper")).alias("old_mild"))
    both = new.join(was, ["run_id", "axis"], "left").withColumn("mild", mild_end(F.col("lower"), F.col("upper")))
    outcome = (
        F.when(F.col("old_status").isNull(), "new")
        .when(F.col("mild").isNull(), F.when(F.col("status") == "fails_throughout", "skipped: fails throughout").otherwise("skipped"))
        .when(F.col("old_mild").isNull(), F.when(F.col("old_status") == "passes_throughout", "regression: boundary appeared").otherwise("skipped"))
        .when(F.col("mild") < F.col("old_mild") - 1e-12, "regression: milder condition")
        .otherwise("ok")
    )
    return both.select("run_id", "axis", "status", "old_status", outcome.alias("outcome"))


def crossings(seen: DataFrame) -> DataFrame:
    """seen: run_id, axis, s, failed: conditions by severity, each once, in any order. Where each axis of a run first turns from pass to fail.

    Gives status, pass_s and fail_s (severities on both sides, null without a crossing) and n. Status: crossed; passes_throughout;
    fails_throughout; or recovers, for an axis that fails from its mildest condition on and passes later without failing again. A
    condition whose verdict or severity is null is not counted; an axis without any is not in the result."""
    by = Window.partitionBy("run_id", "axis").orderBy("s")
    rows = seen.where("s IS NOT NULL AND failed IS NOT NULL").select("run_id", "axis", "s", "failed", F.lag(F.struct("s", "failed")).over(by).alias("before"))
    turn = F.when(F.col("failed") & ~F.col("before.failed"), F.struct(F.col("s").alias("fail_s"), F.col("before.s").alias("pass_s")))
    found = rows.groupBy("run_id", "axis").agg(F.min(turn).alias("turn"), F.bool_or("failed").alias("any"), F.bool_and("failed").alias("every"), F.count("*").alias("n"))
    status = F.when(F.col("turn").isNotNull(), "crossed").when(F.col("every"), "fails_throughout").when(F.col("any"), "recovers").otherwise("passes_throughout")
    return found.select("run_id", "axis", status.alias("status"), "turn.pass_s", "turn.fail_s", "n")
