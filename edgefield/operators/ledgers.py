"""Budget folds, ledgers and decisions as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgefield.operators.folds import folded


def budget_fold(charges: DataFrame, limit: int) -> DataFrame:
    """charges: run_id, order columns ts and event_id, cents. Adds approved and spent, the sum charged so far.

    A refused charge spends nothing, so a smaller one after it may pass: a fold, not a running sum. Its state is one number."""

    def step(state: list[int], row: dict) -> tuple[bool | None, int]:
        ok = None if row["cents"] is None else state[0] + row["cents"] <= limit
        if ok:
            state[0] += row["cents"]
        return ok, state[0]

    return folded(charges.select("run_id", "ts", "event_id", "cents"), "run_id", ["ts", "event_id", "cents"], lambda: [0], step, ["run_id", "event_id", "cents"], "approved boolean, spent long")


def latest(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One record for each key: the last one written, as a put by key leaves it."""
    newest = F.max_by(F.struct(*[c for c in records.columns if c not in key]), F.struct(*order))
    return records.groupBy(*key).agg(newest.alias("_r")).select(*key, "_r.*")


def first_affordable(wanted: DataFrame, remaining: Column, order: list[str]) -> DataFrame:
    """The first probes of a run's wave, as many as it can pay."""
    return wanted.withColumn("_k", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).where(F.col("_k") <= remaining).drop("_k")


def latest_before(rows: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """A backward as-of join with itself: the largest value among earlier rows of the group."""
    return rows.withColumn(out, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))


def billed(tasks: DataFrame, prices: DataFrame, least_seconds: float = 60.0) -> DataFrame:
    """Cost of tasks: at least a minute each, for processors and memory. prices: machine, vcpu_hour, gb_hour."""
    hours = F.greatest(F.col("seconds"), F.lit(least_seconds)) / 3600.0
    return tasks.join(F.broadcast(prices), "machine").withColumn("cost", hours * (F.col("vcpu") * F.col("vcpu_hour") + F.col("gb") * F.col("gb_hour")))  # a price list


#: Fixed values, in dollars: a GB-second and a request of a function, a transition between steps.
FUNCTION_GB_S, FUNCTION_REQUEST, TRANSITION = 0.0000133334, 0.0000002, 0.000025


def run_costs(tasks: DataFrame, prices: DataFrame, extras: DataFrame) -> DataFrame:
    """Whole cost of each run: its tasks, functions, transitions and model calls. extras: run_id, gb_seconds, requests, transitions, model_usd."""
    by_run = billed(tasks, prices).groupBy("run_id").agg(F.count("*").alias("tasks"), F.sum(F.greatest("seconds", F.lit(60.0))).alias("billed_s"), F.sum("cost").alias("task_usd"))
    out = by_run.join(extras, "run_id", "left").fillna(0, ["gb_seconds", "requests", "transitions", "model_usd"])
    out = out.withColumn("function_usd", F.col("gb_seconds") * FUNCTION_GB_S + F.col("requests") * FUNCTION_REQUEST).withColumn("transition_usd", F.col("transitions") * TRANSITION)
    total = F.col("task_usd") + F.col("function_usd") + F.col("transition_usd") + F.col("model_usd")
    return out.select("run_id", "tasks", "billed_s", "task_usd", "function_usd", "transition_usd", "model_usd", total.alias("total_usd"))


def reviewed(proposals: DataFrame, cap: int = 10) -> DataFrame:
    """proposals: calls, tool, order, axes, axis, probes, cost, remaining. Adds outcome and state, by the gate's order of checks."""
    whole = (F.array_sort("order") == F.array_sort("axes")) & (F.size(F.array_distinct("order")) == F.size("order"))
    outcome = (
        F.when(F.col("calls") >= cap, "call_cap")
        .when(~F.col("tool").isin("prioritize_axes", "reallocate_budget"), "unknown_tool")
        .when(F.col("tool") == "prioritize_axes", F.when(whole, "order_applied").otherwise("not_a_permutation"))
        .when(F.col("probes").isNull(), "no_allocation")
        .when(~F.array_contains("axes", F.col("axis")), "unknown_axis")
        .when(F.col("probes") < 0, "bad_count")
        .when(F.col("cost") > F.col("remaining"), "over_budget")
        .otherwise("allocation_applied")
    )
    return proposals.withColumn("outcome", outcome).withColumn("state", F.when(F.col("outcome") == "over_budget", "AWAITING_APPROVAL").otherwise("RUNNING"))


def shaped(proposals: DataFrame) -> DataFrame:
    """proposals: tool, order, axes, split (a map of axis to probes). Adds shape: what the gate says of a proposal by itself, before it asks
    how many there were and what is left to pay with. Axes are checked before counts."""
    keys, counts = F.map_keys("split"), F.map_values("split")
    rows = proposals.withColumn("axis", F.get(F.array_except(keys, "axes"), F.lit(0)))
    rows = rows.withColumn("axis", F.coalesce("axis", F.get("axes", F.lit(0)))).withColumn("probes", F.when(F.size(keys) > 0, F.when(F.exists(counts, lambda n: F.coalesce(n < 0, F.lit(True))), -1).otherwise(0)))
    free = rows.withColumns({"calls": F.lit(0), "cost": F.lit(0), "remaining": F.lit(0)})
    return reviewed(free).withColumnRenamed("outcome", "shape").drop("axis", "probes", "calls", "cost", "remaining", "state")


CALL_CAP = 10


def proposal_effects(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """What each of a run's decisions does, and what holds after it.

    decisions: run_id, seq, tool (`charge`, or a proposal's), cents (of a charge), order, split (a map of axis to probes). runs: run_id, axes,
    limit and price, in cents. For each decision: run_id, seq, outcome, accepted, state, calls, spent, order, split, pending.

    An accepted order or split replaces the one before it; a split that cannot be paid waits as pending until a later one is accepted; all
    proposals count, and from the eleventh on the gate hears none. A charge beyond the limit is refused and spends nothing. Decisions
    of runs that are not there are left out."""
    rows = shaped(decisions.join(runs, "run_id"))

    def start() -> dict:
        return {"calls": 0, "spent": 0, "order": None, "split": None, "pending": None}

    def step(now: dict, row: dict) -> tuple:
        left = row["limit"] - now["spent"]
        if row["tool"] == "charge":
            outcome = "charged" if row["cents"] is not None and row["cents"] <= left else "over_budget"
            if outcome == "charged":
                now["spent"] += row["cents"]
        else:
            outcome = "call_cap" if now["calls"] >= CALL_CAP else row["shape"]
            now["calls"] += 1
            if outcome == "allocation_applied" and sum(n for _, n in row["split"]) * row["price"] > left:
                outcome, now["pending"] = "over_budget", row["split"]
            elif outcome == "allocation_applied":
                now["split"], now["pending"] = row["split"], None
            elif outcome == "order_applied":
                now["order"] = row["order"]
        accepted = outcome in ("charged", "order_applied", "allocation_applied")
        return outcome, accepted, "AWAITING_APPROVAL" if outcome == "over_budget" else "RUNNING", now["calls"], now["spent"], now["order"], now["split"], now["pending"]

    rows = rows.select("run_id", "seq", "tool", "shape", "cents", "order", "split", "limit", "price")
    out = "outcome string, accepted boolean, state string, calls long, spent long, order array<string>, split map<string,int>, pending map<string,int>"
    return folded(rows, "run_id", ["seq"], start, step, ["run_id", "seq"], out)


#: What an event needs of a run, and what it makes of it.
TRANSITIONS = {
    "plan": (("PLANNING", "RUNNING"), "RUNNING"),
    "halt": (("RUNNING",), "AWAITING_APPROVAL"),
    "approve": (("AWAITING_APPROVAL",), "RUNNING"),
    "finalize": (("RUNNING",), "DONE"),
    "cancel": (("PLANNING", "AWAITING_APPROVAL"), "CANCELLED"),
}


def run_states(events: DataFrame) -> DataFrame:
    """events: run_id, seq, event, amount and by (of an approval). An append-only row for each: run_id, seq, event, accepted, status, round,
    version, budget (what approvals have added) and decision_id.

    A run begins as PLANNING in round 0. Each plan is a round with a decision of its own; an approval has a positive amount and a name and
    makes a new version. What a run's status does not allow is refused and changes nothing; so is an event that is not known."""

    def start() -> dict:
        return {"status": "PLANNING", "round": 0, "version": 1, "budget": 0.0}

    def step(run: dict, row: dict) -> tuple:
        event, (needs, after) = row["event"], TRANSITIONS.get(row["event"], ((), None))
        ok = run["status"] in needs
        if event == "approve":
            ok = ok and row["amount"] is not None and row["amount"] > 0 and bool((row["by"] or "").strip())
        decision = None
        if ok:
            run["status"] = after
            if event == "plan":
                run["round"] += 1
                decision = f"{run['round']:04d}-plan"
            elif event == "approve":
                run["version"] += 1
                run["budget"] += row["amount"]
                decision = f"{run['round']:04d}-approve-{run['version']}"
        return ok, run["status"], run["round"], run["version"], run["budget"], decision

    rows = events.select("run_id", "seq", "event", "amount", "by")
    return folded(rows, "run_id", ["seq"], start, step, ["run_id", "seq", "event"], "accepted boolean, status string, round long, version long, budget double, decision_id string")
