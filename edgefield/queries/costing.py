"""Stages and arms, costs, budgets, gate and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgefield.operators import ledgers as L
from edgefield.sources.tables import table


def _stages(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("run"), F.expr("stack(3, 'degrade', CAST(floor(l_discount * 100 + 0.5) AS BIGINT), 'measure', CAST(floor(l_tax * 100 + 0.5) AS BIGINT), 'infer', CAST(l_quantity AS BIGINT)) AS (stage, ms)"))


_STAGES = "s AS (SELECT l_returnflag AS arm, l_linenumber AS run, 'degrade' AS stage, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS ms FROM lineitem UNION ALL SELECT l_returnflag, l_linenumber, 'measure', CAST(floor(l_tax * 100 + 0.5) AS BIGINT) FROM lineitem UNION ALL SELECT l_returnflag, l_linenumber, 'infer', CAST(l_quantity AS BIGINT) FROM lineitem)"
_FRAME = "f AS (SELECT arm, run, sum(ms) / sum((stage = 'infer')::INT)::DOUBLE AS frame_ms FROM s GROUP BY ALL), a AS (SELECT arm, median(frame_ms) AS ms, count(*) AS repeats, (max(frame_ms) = min(frame_ms)) AS identical FROM f GROUP BY arm)"


def stage_summary(spark, d):
    s = _stages(spark, d)
    return s.groupBy("arm", "stage").agg(F.median("ms").alias("median_ms"), F.round(F.percentile("ms", 0.95), 6).alias("p95_ms"), F.sum("ms").alias("total_ms"), F.count("*").alias("n"))


def mean_ms_per_frame(spark, d):
    return _stages(spark, d).groupBy("arm").agg(F.round(F.sum("ms") / F.sum((F.col("stage") == "infer").cast("long")), 9).alias("ms_per_frame"))


def _arms(spark, d):
    run = _stages(spark, d).groupBy("arm", "run").agg((F.sum("ms") / F.sum((F.col("stage") == "infer").cast("long"))).alias("frame_ms"))
    return run.groupBy("arm").agg(F.median("frame_ms").alias("ms"), F.count("*").alias("repeats"), (F.max("frame_ms") == F.min("frame_ms")).alias("identical"))


_HOUR = "CASE arm WHEN 'A' THEN 0.0892 WHEN 'N' THEN 0.0798 ELSE 0.0898 END"


def compare_arms(spark, d):
    """Median over repeats, cost of 1000 frames, and speed against the first arm."""
    arms = _arms(spark, d).withColumn("usd_1000", F.col("ms") / 3600.0 * F.expr(_HOUR))
    base = arms.where("arm = 'A'").select(F.col("ms").alias("base_ms"))
    out = arms.crossJoin(F.broadcast(base))  # one row
    return out.select("arm", "repeats", "identical", F.round("ms", 9).alias("ms"), F.round("usd_1000", 9).alias("usd_1000"), F.round(F.col("base_ms") / F.col("ms"), 9).alias("speedup"))


def three_way(spark, d):
    """Effects of chip and build, each only where both of its arms are there."""
    arms = _arms(spark, d).select("arm", "ms")
    pairs = spark.createDataFrame([("chip", "A", "N"), ("build", "N", "R"), ("absent", "N", "X")], "effect string, base string, cand string")
    b, c = arms.select(F.col("arm").alias("base"), F.col("ms").alias("base_ms")), arms.select(F.col("arm").alias("cand"), F.col("ms").alias("cand_ms"))
    return pairs.join(b, "base").join(c, "cand").select("effect", F.round(F.col("base_ms") / F.col("cand_ms"), 9).alias("ratio"))


def run_cost(spark, d):
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("machine"), (F.col("l_quantity") * 4).alias("seconds"), F.lit(2).alias("vcpu"), F.lit(4).alias("gb"))
    prices = spark.createDataFrame([("A", 0.04048, 0.004445), ("N", 0.03238, 0.00356), ("R", 0.03, 0.003)], "machine string, vcpu_hour double, gb_hour double")
    return L.billed(tasks, prices).groupBy("machine").agg(F.count("*").alias("tasks"), F.round(F.sum(F.greatest("seconds", F.lit(60.0))), 6).alias("billed_s"), F.round(F.sum("cost"), 6).alias("usd"))


def _charges(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))


def budget_fold(spark, d):
    return L.budget_fold(_charges(spark, d), 40000)


def wave_truncate(spark, d):
    """Every run pays for as many of its probes, in order, as what it has left allows: a number that depends on the run."""
    wanted = _charges(spark, d)
    return L.first_affordable(wanted, F.pmod("run_id", F.lit(7)) + 1, ["ts", "event_id"]).select("run_id", "event_id")


_PROPOSALS = """SELECT event_id, event_id % 12 AS calls, CASE event_type WHEN 'view' THEN 'prioritize_axes' WHEN 'click' THEN 'reallocate_budget' WHEN 'purchase' THEN 'reallocate_budget' WHEN 'signup' THEN 'prioritize_axes' ELSE 'delete_run' END AS tool,
CASE event_id % 3 WHEN 0 THEN {arr}('b', 'a', 'c'{end}) WHEN 1 THEN {arr}('a', 'b', 'b'{end}) ELSE {arr}('a', 'b'{end}) END AS {q}order{q}, {arr}('a', 'b', 'c'{end}) AS axes, CASE event_id % 5 WHEN 0 THEN 'z' ELSE 'a' END AS axis,
CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 9 - 1 END AS probes, (event_id % 9 - 1) * 5 AS cost, 30 AS remaining FROM {events}"""


def _proposals(spark, d):
    text = _PROPOSALS.replace("{arr}", "array").replace("{end}", "").replace("{q}", "`")
    return spark.sql(text, events=table(spark, d, "events"))


def gate_review(spark, d):
    return L.reviewed(_proposals(spark, d)).select("event_id", "outcome", "state")


def heuristic_order(spark, d):
    """Axes by coverage, least first, missing as none, ties by name; here a run's event types by their share of large values."""
    e = table(spark, d, "events")
    cov = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("axis")).agg((F.sum((F.col("value") > 50).cast("long")) / F.count("*")).alias("share"))
    by = Window.partitionBy("run_id").orderBy(F.when(F.col("axis") == "error", 0.0).otherwise(F.col("share")), "axis")
    return cov.select("run_id", "axis", F.row_number().over(by).alias("place"))


def decision_totals(spark, d):
    """Accepted and refused proposals of every tool, by the gate."""
    r = L.reviewed(_proposals(spark, d))
    ok = F.col("outcome").isin("order_applied", "allocation_applied")
    return r.groupBy("tool").agg(F.sum(ok.cast("long")).alias("accepted"), F.sum((~ok).cast("long")).alias("refused"), F.sum(F.when(F.col("state") == "AWAITING_APPROVAL", 1).otherwise(0)).cast("long").alias("waiting"))


def ledger_dedup(spark, d):
    """Retries overwrite: the last record of each run and probe."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.pmod("event_id", F.lit(8)).alias("probe_id"), "ts", "event_id", "value")
    return L.latest(e, ["run_id", "probe_id"], ["ts", "event_id"]).select("run_id", "probe_id", "event_id", "value")


def round_metrics(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 100).cast("long").alias("round"), "event_type", "value")
    return e.groupBy("round").agg(F.count("*").alias("probes"), F.countDistinct("run_id").alias("runs"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("located"), F.max((F.col("event_type") == "error").cast("int")).alias("halted"))


def asof_pairing(spark, d):
    """Every success pairs with the latest schedule of a smaller id."""
    e = table(spark, d, "events")
    rows = L.latest_before(e, ["user_id"], ["event_id"], F.when(F.col("event_type") == "view", F.col("ts")), "scheduled")
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "scheduled")


def array_expand(spark, d):
    """Array jobs as their children, retries as attempts: one row for each attempt, and its time since the parent's start."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.explode(F.sequence(F.lit(0), F.pmod("o_orderkey", F.lit(4)))).alias("idx"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") - 1).cast("long").alias("idx"), "l_quantity")
    return o.join(li, ["job", "idx"], "left").groupBy("job", "idx").agg(F.count("l_quantity").alias("attempts"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("seconds"))


def model_call_pricing(spark, d):
    """Model calls priced by tokens and charged at once; micro-dollars are whole numbers."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ts"), F.col("turn").alias("event_id"), F.when(F.col("role") == "user", F.length("text") * 3).otherwise(F.length("text") * 15).cast("long").alias("cents"))
    return L.budget_fold(c, 60000).groupBy("run_id").agg(F.sum(F.when(F.col("approved"), F.col("cents")).otherwise(0)).alias("spent"), F.sum((~F.col("approved")).cast("long")).alias("refused"))


def envelope(spark, d):
    """Findings of a run with coverage, nulls where one is unknown."""
    e = table(spark, d, "events")
    found = e.where("event_type != 'error'").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("axis")).agg(F.min("value").alias("lower"), F.max("value").alias("upper"))
    cov = e.where("event_type IN ('view', 'error')").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("axis")).agg(F.count("*").alias("covered"))
    return found.join(cov, ["run_id", "axis"], "left").select("run_id", "axis", "lower", "upper", "covered")


_C = "c AS (SELECT user_id AS run_id, ts, event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events)"
_FOLD = "f AS (SELECT run_id, event_id, cents, rk, cents <= {limit} AS approved, CASE WHEN cents <= {limit} THEN cents ELSE 0 END AS spent FROM c WHERE rk = 1 UNION ALL SELECT c.run_id, c.event_id, c.cents, c.rk, f.spent + c.cents <= {limit}, CASE WHEN f.spent + c.cents <= {limit} THEN f.spent + c.cents ELSE f.spent END FROM f JOIN c ON c.run_id = f.run_id AND c.rk = f.rk + 1)"
_P = "p AS (" + _PROPOSALS.replace("{arr}(", "[").replace("{end})", "]").replace("{q}", '"').replace("{events}", "events") + ")"
_R = """r AS (SELECT *, CASE WHEN calls >= 10 THEN 'call_cap' WHEN tool = 'delete_run' THEN 'unknown_tool' WHEN tool = 'prioritize_axes' THEN CASE WHEN list_sort("order") = list_sort(axes) AND len(list_distinct("order")) = len("order") THEN 'order_applied' ELSE 'not_a_permutation' END
WHEN probes IS NULL THEN 'no_allocation' WHEN NOT list_contains(axes, axis) THEN 'unknown_axis' WHEN probes < 0 THEN 'bad_count' WHEN cost > remaining THEN 'over_budget' ELSE 'allocation_applied' END AS outcome FROM p)"""
QUERIES = {
    f.__name__: f
    for f in (stage_summary, mean_ms_per_frame, compare_arms, three_way, run_cost, budget_fold, wave_truncate, gate_review, heuristic_order, decision_totals, ledger_dedup, round_metrics, asof_pairing, array_expand, model_call_pricing, envelope)
}
SQL = {
    "stage_summary": f"WITH {_STAGES} SELECT arm, stage, median(ms) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, sum(ms)::BIGINT AS total_ms, count(*) AS n FROM s GROUP BY ALL",
    "mean_ms_per_frame": f"WITH {_STAGES} SELECT arm, round(sum(ms) / sum((stage = 'infer')::INT)::DOUBLE, 9) AS ms_per_frame FROM s GROUP BY 1",
    "compare_arms": f"WITH {_STAGES}, {_FRAME} SELECT arm, repeats, identical, round(ms, 9) AS ms, round(ms / 3600.0::DOUBLE * ({_HOUR})::DOUBLE, 9) AS usd_1000, round((SELECT ms FROM a WHERE arm = 'A') / ms, 9) AS speedup FROM a",
    "three_way": f"WITH {_STAGES}, {_FRAME} SELECT effect, round(b.ms / c.ms, 9) AS ratio FROM (VALUES ('chip', 'A', 'N'), ('build', 'N', 'R'), ('absent', 'N', 'X')) p(effect, base, cand) JOIN a b ON b.arm = base JOIN a c ON c.arm = cand",
    "run_cost": "SELECT machine, count(*) AS tasks, round(sum(greatest(l_quantity * 4, 60.0)), 6) AS billed_s, round(sum(greatest(l_quantity * 4, 60.0) / 3600.0::DOUBLE * (2 * v::DOUBLE + 4 * g::DOUBLE)), 6) AS usd FROM lineitem JOIN (VALUES ('A', 0.04048, 0.004445), ('N', 0.03238, 0.00356), ('R', 0.03, 0.003)) p(machine, v, g) ON machine = l_returnflag GROUP BY 1",
    "budget_fold": f"WITH RECURSIVE {_C}, {_FOLD.format(limit=40000)} SELECT run_id, event_id, cents, approved, spent FROM f",
    "wave_truncate": f"WITH {_C} SELECT run_id, event_id FROM c WHERE rk <= run_id % 7 + 1",
    "gate_review": f"WITH {_P}, {_R} SELECT event_id, outcome, CASE WHEN outcome = 'over_budget' THEN 'AWAITING_APPROVAL' ELSE 'RUNNING' END AS state FROM r",
    "heuristic_order": "WITH c AS (SELECT user_id AS run_id, event_type AS axis, sum((value > 50)::INT) / count(*)::DOUBLE AS share FROM events GROUP BY ALL) SELECT run_id, axis, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN axis = 'error' THEN 0.0 ELSE share END, axis)::INT AS place FROM c",
    "decision_totals": f"WITH {_P}, {_R} SELECT tool, sum((outcome IN ('order_applied', 'allocation_applied'))::INT)::BIGINT AS accepted, sum((outcome NOT IN ('order_applied', 'allocation_applied'))::INT)::BIGINT AS refused, sum((outcome = 'over_budget')::INT)::BIGINT AS waiting FROM r GROUP BY 1",
    "ledger_dedup": "WITH k AS (SELECT user_id AS run_id, event_id % 8 AS probe_id, event_id, value, row_number() OVER (PARTITION BY user_id, event_id % 8 ORDER BY ts DESC, event_id DESC) AS rk FROM events) SELECT run_id, probe_id, event_id, value FROM k WHERE rk = 1",
    "round_metrics": "SELECT floor(event_id / 100)::BIGINT AS round, count(*) AS probes, count(DISTINCT user_id) AS runs, sum((event_type = 'purchase')::INT)::BIGINT AS located, max((event_type = 'error')::INT) AS halted FROM events GROUP BY 1",
    "asof_pairing": "WITH k AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scheduled FROM events) SELECT event_id, user_id, scheduled FROM k WHERE event_type = 'purchase'",
    "array_expand": "SELECT job, idx, count(l_quantity) AS attempts, coalesce(sum(l_quantity), 0.0) AS seconds FROM (SELECT o_orderkey AS job, unnest(range(o_orderkey % 4 + 1)) AS idx FROM orders) o LEFT JOIN lineitem ON l_orderkey = job AND l_linenumber - 1 = idx GROUP BY ALL",
    "model_call_pricing": "WITH RECURSIVE c AS (SELECT conv_id AS run_id, turn AS event_id, CASE WHEN role = 'user' THEN length(text) * 3 ELSE length(text) * 15 END AS cents, row_number() OVER (PARTITION BY conv_id ORDER BY turn, turn, CASE WHEN role = 'user' THEN length(text) * 3 ELSE length(text) * 15 END) AS rk FROM conversations), " + _FOLD.format(limit=60000) + " SELECT run_id, sum(CASE WHEN approved THEN cents ELSE 0 END)::BIGINT AS spent, sum((NOT approved)::INT)::BIGINT AS refused FROM f GROUP BY 1",
    "envelope": "SELECT f.run_id, f.axis, lower, upper, covered FROM (SELECT user_id AS run_id, event_type AS axis, min(value) AS lower, max(value) AS upper FROM events WHERE event_type <> 'error' GROUP BY ALL) f LEFT JOIN (SELECT user_id AS run_id, event_type AS axis, count(*) AS covered FROM events WHERE event_type IN ('view', 'error') GROUP BY ALL) c USING (run_id, axis)",
}
