"""How far the arms of an experiment agree: the same probes run on several machines, several times each.

results: arm, run, probe_id, map50, one row for each probe of a run; a repeated row is the same result. Rows with a null arm, run
or probe are of no arm; a null map50 is a probe without a result. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def _known(results: DataFrame) -> DataFrame:
    return results.where("arm IS NOT NULL AND run IS NOT NULL AND probe_id IS NOT NULL")


def agreement(results: DataFrame) -> DataFrame:
    """base, cand (base < cand), compared, identical, max_abs_difference: for every two arms the probes that both have a result of.

    An arm's result of a probe is that of its first run that has one, the smaller of two in the same run. Results are combined
    before they are shuffled, so a probe brings one value for each arm, whatever its repeats; arms meet within a probe's row
    instead of in a join for each two of them. NaN is identical to NaN; its difference to a number is NaN, the largest of all."""
    first = _known(results).where("map50 IS NOT NULL").groupBy("probe_id", "arm").agg(F.min(F.struct("run", "map50")).alias("f"))
    arms = F.array_sort(F.collect_list(F.struct("arm", F.col("f.map50").alias("v"))))
    rows = first.groupBy("probe_id").agg(arms.alias("arms")).where(F.size("arms") > 1)
    after = lambda a, i: F.transform(F.slice("arms", i + 2, F.size("arms")), lambda b: F.struct(a["arm"].alias("base"), b["arm"].alias("cand"), a["v"].alias("x"), b["v"].alias("y")))
    pairs = rows.select(F.inline(F.flatten(F.transform("arms", after))))
    same = F.col("x") == F.col("y")
    return pairs.groupBy("base", "cand").agg(
        F.count("*").alias("compared"), F.count_if(same).alias("identical"), F.max(F.when(same, 0.0).otherwise(F.abs(F.col("x") - F.col("y")))).alias("max_abs_difference")
    )


def repeats(results: DataFrame) -> DataFrame:
    """arm, runs, probes, identical: whether every run of an arm has the same probes with the same results. A probe whose result is
    null in one run and not in another differs."""
    rows = _known(results)
    per_probe = rows.groupBy("arm", "probe_id", "run").agg(F.min("map50").alias("lo"), F.max("map50").alias("hi")).groupBy("arm", "probe_id").agg(
        F.count("*").alias("runs"), ((F.min("lo").eqNullSafe(F.max("hi"))) & ((F.count("lo") == 0) | (F.count("lo") == F.count("*")))).alias("same")
    )
    probes = per_probe.groupBy("arm").agg(F.count("*").alias("probes"), F.min("runs").alias("fewest"), F.bool_and("same").alias("same"))
    runs = rows.groupBy("arm").agg(F.countDistinct("run").alias("runs"))
    return runs.join(probes, "arm").select("arm", "runs", "probes", (F.col("same") & (F.col("fewest") == F.col("runs"))).alias("identical"))


def processors(runs: DataFrame) -> DataFrame:
    """runs: arm, run, cpu_model; of repeated runs one counts. arm, cpu_model (of its first run), cpu_models: how many runs had each model.

    A service that promises a kind of machine does not pin its generation. Null models are unknown ones."""
    one = runs.where("arm IS NOT NULL AND run IS NOT NULL").groupBy("arm", "run").agg(F.coalesce(F.min("cpu_model"), F.lit(UNKNOWN)).alias("cpu_model"))
    counted = one.groupBy("arm", "cpu_model").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    models = F.map_from_entries(F.array_sort(F.collect_list(F.struct("cpu_model", "n"))))
    return counted.groupBy("arm").agg(F.min_by("cpu_model", "first").alias("cpu_model"), models.alias("cpu_models"))
