"""Figures at the paths that texts cite, the store of probes, measured coverage, states and proposals of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgefield.functions.axes import AXES
from edgefield.operators import figures
from edgefield.operators import ledgers as L
from edgefield.plans import covered
from edgefield.queries.recording import tiles
from edgefield.sources.shared import folder
from edgefield.sources.store import ProbeStore
from edgefield.sources.tables import table


def _recorded(spark, d):
    """A file of recorded results for each event: nested objects and arrays around the event's own JSON."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    body = F.concat(F.lit('{"run": {"id": '), (F.col("user_id") + 1000).cast("string"), F.lit(', "kind": "'), "event_type", F.lit('", "seen": ['), cents.cast("string"), F.lit(', {"props": '), "props", F.lit(', "a.b": 1}]}}'))
    return table(spark, d, "events").select(F.concat(F.lit("e/"), "event_id").alias("file"), body.alias("body"))


def _citing(spark, d):
    """Documents that cite what an event's file holds: rightly, wrongly, a path and a file that are not there, and a text for a number."""
    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = table(spark, d, "documents").select("doc_id", "text").join(e, F.col("doc_id") == F.col("event_id"))
    id_, kind = F.col("event_id").cast("string"), F.pmod("event_id", F.lit(5))
    mark = lambda figure, path: F.concat(figure.cast("string"), F.lit(" ms <!-- bench:e/"), *path, F.lit(" -->"))
    first = (
        F.when(kind == 0, mark(F.col("k"), (id_, F.lit(".run.seen[1].props.k"))))
        .when(kind == 1, mark(F.col("k") + 3, (id_, F.lit(".run.seen[1].props.k"))))
        .when(kind == 2, mark(F.col("k"), (id_, F.lit(".run.seen[2]"))))
        .when(kind == 3, mark(F.col("k"), (F.lit("x"), id_, F.lit(".run.id"))))
        .otherwise(mark(F.format_number(F.col("user_id") + 1000, 0), (id_, F.lit(".run.id"))))
    )
    second = F.concat(mark(F.col("cents") + F.floor(F.col("cents") / 250), (id_, F.lit(".run.seen[0]"))), F.lit(" and 7 <!--bench:e/"), id_, F.lit(".run.kind-->"))
    return rows.select("doc_id", F.concat("text", F.lit("\nIt took "), first, F.lit(" then\n"), second).alias("text"))


def cited_paths(spark, d):
    """Every figure that documents cite, with the value at its path and the verdict."""
    return figures.checked(_citing(spark, d), _recorded(spark, d))


def probe_store(spark, d):
    """Events as probes: a first put, a retry of some that replaces them, a compaction, and then a look-up of them all."""
    e = table(spark, d, "events")
    axis = F.create_map(F.lit("fog.beta_per_m"), F.col("value"), F.lit("jpeg.quality"), F.pmod("user_id", F.lit(3)).cast("double"))
    probes = e.select("event_id", F.col("event_type").alias("dataset"), F.lit(100).alias("frames"), F.lit("stand-in").alias("pipeline"), axis.alias("condition"), F.lit(7).alias("seed"), (F.col("event_id") / 8).alias("map50"))
    store = ProbeStore(spark, folder(spark, "store"))
    store.put(probes.where("event_id % 2 = 0"), ["event_id"])
    store.put(probes.where("event_id % 6 = 0").withColumn("map50", F.col("map50") + 0.5), ["event_id"])
    store.compact()
    # the same conditions in another order, off by rounding and with zero's other sign
    quality, beta = F.col("condition")["jpeg.quality"], F.col("condition")["fog.beta_per_m"]
    axis = F.create_map(F.lit("jpeg.quality"), F.when(quality == 0, F.lit(-0.0)).otherwise(quality), F.lit("fog.beta_per_m"), beta * (1 + 1e-15))
    return store.get(probes.drop("map50").withColumn("condition", axis), ["map50"]).select("event_id", "hit", "map50")


def measured_coverage(spark, d):
    """What frames made of all vectors cover of three axes, by a sweep of nine values each. Not as SQL: kernels run on pixels."""
    probed = {name: [AXES[name].from_severity(k / 8) for k in range(9)] for name in ("fog.beta_per_m", "jpeg.quality", "motion_blur.exposure_ms")}
    out = covered.covered(covered.measured(tiles(spark, d), probed, 7))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("axis", r("covered_lo"), r("covered_hi"), r("fraction"), F.size("uncovered").alias("n_uncovered"))


def run_states(spark, d):
    """Events of users as what happens to a run: plans, halts, approvals, ends; what a run's status does not allow is refused."""
    event = F.expr("CASE WHEN value < 5 THEN 'redo' WHEN event_type = 'error' THEN 'halt' WHEN event_type = 'purchase' THEN 'approve' WHEN event_type = 'signup' AND event_id % 8 = 0 THEN 'finalize' WHEN event_type = 'signup' AND event_id % 8 = 1 THEN 'cancel' ELSE 'plan' END")
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("value") - 20).alias("amount"), F.when(F.col("event_id") % 7 == 0, " ").otherwise("someone").alias("by"))
    return L.run_states(e).withColumn("budget", F.round("budget", 6))


_DECISIONS = """SELECT event_id // 24 AS run_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'charge' WHEN 'view' THEN 'prioritize_axes' WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'delete_run' ELSE 'charge' END ELSE 'reallocate_budget' END AS tool,
floor(value)::BIGINT AS cents, event_id % 6 AS n, event_id % 3 AS m, CASE event_id % 3 WHEN 0 THEN 'b,a' WHEN 1 THEN 'a,b' ELSE 'a,a' END AS o FROM events"""


def proposal_effects(spark, d):
    """Charges and proposals of runs in their order, and what holds of each run after every one."""
    text = _DECISIONS.replace("event_id // 24", "event_id DIV 24").replace("floor(value)::BIGINT", "CAST(floor(value) AS BIGINT)").replace("FROM events", "FROM {events}")
    e = spark.sql(text, events=table(spark, d, "events"))
    one = F.create_map(F.when(F.col("seq") % 11 == 0, "z").otherwise("a"), F.when(F.col("seq") % 17 == 0, -1).otherwise(F.col("n").cast("int")))
    split = F.when(F.col("seq") % 13 == 0, None).when(F.col("seq") % 4 == 0, F.map_concat(one, F.create_map(F.lit("b"), F.col("m").cast("int")))).otherwise(one)
    decisions = e.select("run_id", "seq", "tool", "cents", F.split("o", ",").alias("order"), split.alias("split"))
    runs = e.select("run_id").distinct().select("run_id", F.array(F.lit("a"), F.lit("b")).alias("axes"), F.lit(150).cast("long").alias("limit"), F.lit(30).cast("long").alias("price"))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias(c)
    return L.proposal_effects(decisions, runs).select("run_id", "seq", "outcome", "accepted", "state", "calls", "spent", F.array_join("order", ",").alias("order"), told("split"), told("pending"))


QUERIES = {f.__name__: f for f in (cited_paths, probe_store, measured_coverage, run_states, proposal_effects)}
SQL = {
    "cited_paths": """WITH e AS (SELECT event_id, user_id, floor(value * 100 + 0.5)::BIGINT AS cents, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
p AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS l, event_id AS i, cents, k, user_id AS u FROM documents JOIN e ON event_id = doc_id)
SELECT doc_id, (l + 2)::INT AS line, CASE i % 5 WHEN 3 THEN 'e/x' ELSE 'e/' END || i || CASE i % 5 WHEN 0 THEN '.run.seen[1].props.k' WHEN 1 THEN '.run.seen[1].props.k' WHEN 2 THEN '.run.seen[2]' ELSE '.run.id' END AS source,
       (CASE i % 5 WHEN 1 THEN k + 3 WHEN 4 THEN 1000 + u ELSE k END)::DOUBLE AS cited, (CASE i % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 4 THEN 1000 + u END)::DOUBLE AS actual,
       CASE i % 5 WHEN 1 THEN 'another value' WHEN 2 THEN 'no number there' WHEN 3 THEN 'no such file' ELSE 'fine' END AS verdict FROM p
UNION ALL SELECT doc_id, l + 3, 'e/' || i || '.run.seen[0]', (cents + cents // 250)::DOUBLE, cents::DOUBLE, 'fine' FROM p
UNION ALL SELECT doc_id, l + 3, 'e/' || i || '.run.kind', 7::DOUBLE, NULL, 'no number there' FROM p""",
    "probe_store": """WITH k AS (SELECT event_id, event_type || '|' || printf('%.11e', value) || '|' || user_id % 3 AS k FROM events),
a AS (SELECT k, max(event_id) AS i FROM k WHERE event_id % 2 = 0 GROUP BY k), b AS (SELECT k, max(event_id) AS i FROM k WHERE event_id % 6 = 0 GROUP BY k)
SELECT event_id, a.i IS NOT NULL AS hit, coalesce(b.i / 8 + 0.5, a.i / 8)::DOUBLE AS map50 FROM k LEFT JOIN a USING (k) LEFT JOIN b USING (k)""",
    "run_states": """WITH RECURSIVE e AS (SELECT user_id AS run_id, event_id AS seq, CASE WHEN value < 5 THEN 'redo' WHEN event_type = 'error' THEN 'halt' WHEN event_type = 'purchase' THEN 'approve' WHEN event_type = 'signup' AND event_id % 8 = 0 THEN 'finalize' WHEN event_type = 'signup' AND event_id % 8 = 1 THEN 'cancel' ELSE 'plan' END AS event,
  value > 20 AND event_id % 7 <> 0 AS named, value - 20 AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT run_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS event, NULL::BOOLEAN AS accepted, 'PLANNING' AS status, 0::BIGINT AS round, 1::BIGINT AS version, 0::DOUBLE AS budget FROM e
UNION ALL
SELECT run_id, k, seq, event, ok, CASE WHEN NOT ok THEN was ELSE CASE event WHEN 'halt' THEN 'AWAITING_APPROVAL' WHEN 'finalize' THEN 'DONE' WHEN 'cancel' THEN 'CANCELLED' ELSE 'RUNNING' END END,
  round + (ok AND event = 'plan')::INT, version + (ok AND event = 'approve')::INT, budget + CASE WHEN ok AND event = 'approve' THEN amount ELSE 0 END
FROM (SELECT e.*, f.status AS was, f.round, f.version, f.budget, CASE e.event WHEN 'plan' THEN f.status IN ('PLANNING', 'RUNNING') WHEN 'halt' THEN f.status = 'RUNNING' WHEN 'finalize' THEN f.status = 'RUNNING'
  WHEN 'approve' THEN f.status = 'AWAITING_APPROVAL' AND named WHEN 'cancel' THEN f.status IN ('PLANNING', 'AWAITING_APPROVAL') ELSE false END AS ok FROM f JOIN e ON e.run_id = f.run_id AND e.k = f.k + 1))
SELECT run_id, seq, event, accepted, status, round, version, round(budget, 6) AS budget, CASE WHEN accepted AND event = 'plan' THEN printf('%04d-plan', round) WHEN accepted AND event = 'approve' THEN printf('%04d-approve-%d', round, version) END AS decision_id FROM f WHERE k > 0""",
    "proposal_effects": f"""WITH RECURSIVE p AS ({_DECISIONS}),
e AS (SELECT *, CASE WHEN seq % 11 = 0 THEN 'z' ELSE 'a' END || '=' || CASE WHEN seq % 17 = 0 THEN -1 ELSE n END AS s1, CASE WHEN seq % 4 = 0 THEN 'b=' || m END AS s2, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM p),
g AS (SELECT *, CASE WHEN s2 IS NULL THEN s1 WHEN seq % 11 = 0 THEN s2 || ',' || s1 ELSE s1 || ',' || s2 END AS sp, 30 * (n + CASE WHEN s2 IS NULL THEN 0 ELSE m END) AS cost,
  CASE WHEN tool = 'delete_run' THEN 'unknown_tool' WHEN tool = 'prioritize_axes' THEN CASE o WHEN 'a,a' THEN 'not_a_permutation' ELSE 'order_applied' END
       WHEN seq % 13 = 0 THEN 'no_allocation' WHEN seq % 11 = 0 THEN 'unknown_axis' WHEN seq % 17 = 0 THEN 'bad_count' ELSE 'allocation_applied' END AS shape FROM e),
f AS (SELECT DISTINCT run_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 0::BIGINT AS calls, 0::BIGINT AS spent, NULL::VARCHAR AS "order", NULL::VARCHAR AS split, NULL::VARCHAR AS pending FROM g
UNION ALL
SELECT run_id, k, seq, was, calls + (tool <> 'charge')::INT, spent + CASE WHEN was = 'charged' THEN cents ELSE 0 END, CASE WHEN was = 'order_applied' THEN o ELSE "order" END,
  CASE WHEN was = 'allocation_applied' THEN sp ELSE split END, CASE WHEN was = 'allocation_applied' THEN NULL WHEN was = 'over_budget' AND tool <> 'charge' THEN sp ELSE pending END
FROM (SELECT g.*, f.calls, f.spent, f."order", f.split, f.pending, CASE WHEN tool = 'charge' THEN CASE WHEN f.spent + cents <= 150 THEN 'charged' ELSE 'over_budget' END WHEN f.calls >= 10 THEN 'call_cap'
  WHEN shape = 'allocation_applied' AND cost > 150 - f.spent THEN 'over_budget' ELSE shape END AS was FROM f JOIN g ON g.run_id = f.run_id AND g.k = f.k + 1))
SELECT run_id, seq, outcome, outcome IN ('charged', 'order_applied', 'allocation_applied') AS accepted, CASE WHEN outcome = 'over_budget' THEN 'AWAITING_APPROVAL' ELSE 'RUNNING' END AS state, calls, spent, "order", split, pending FROM f WHERE k > 0""",
}
