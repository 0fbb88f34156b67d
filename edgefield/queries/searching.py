"""Verdict series, grids, bisection, regression checks, savings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgefield.functions.axes import AXES
from edgefield.plans import runs as R
from edgefield.plans.rounds import to_value
from edgefield.sources.tables import table

_NAMES = ("fog.beta_per_m", "jpeg.quality", "low_light.illuminance_lux", "motion_blur.exposure_ms")


def _responses(spark, d, shift=0.0):
    """One response for each run: from a severity that its events make on it fails, and every seventh recovers further up."""
    m = F.pmod(F.sum("event_id"), F.lit(1100)).cast("double")
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(((m + 0.37) / 1000 - 0.05).alias("edge"))
    axis = F.element_at(F.array(*map(F.lit, _NAMES)), (F.pmod("run_id", F.lit(4)) + 1).cast("int"))
    recovers = F.when((F.pmod("run_id", F.lit(7)) == 0) & (F.col("edge") >= 0), F.col("edge") + 0.3)  # of the edge before the shift
    return runs.select("run_id", axis.alias("axis"), (F.col("edge") + shift).alias("edge"), recovers.alias("recovers"))


def _verdict_series(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "value", (F.col("value") < 50).alias("failed"))


def transitions(spark, d):
    """Places where a run's verdict changes."""
    by = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = _verdict_series(spark, d).withColumn("before", F.lag("failed").over(by)).withColumn("at", F.row_number().over(by))
    return rows.where("failed != before").select("run_id", "at", "event_id", "before", "failed")


def first_crossing(spark, d):
    """The first change from pass to fail of every run, with the values on both sides in ascending order."""
    by = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = _verdict_series(spark, d).withColumn("b", F.lag("failed").over(by)).withColumn("v", F.lag("value").over(by)).withColumn("at", F.row_number().over(by))
    found = rows.where("failed AND NOT b").groupBy("run_id").agg(F.min_by(F.struct("v", "value"), "at").alias("x"), F.min("at").alias("at"))
    return found.select("run_id", "at", F.least("x.v", "x.value").alias("lower"), F.greatest("x.v", "x.value").alias("upper"))


def nested_grid(spark, d):
    """Coarser grids as strides of the finest, which is probed once."""
    finest = R.grid_probes(_responses(spark, d)).withColumn("steps", F.explode(F.array(*map(F.lit, (33, 17, 9, 5)))))
    rows = finest.where(F.pmod("idx", (F.lit(32) / (F.col("steps") - 1)).cast("int")) == 0).groupBy("run_id", "axis", "steps")
    return rows.agg(F.count("*").alias("n_probes"), F.count_if("failed").alias("n_failed"), F.min(F.when(F.col("failed"), F.col("idx"))).alias("first_failed"))


def _rounded(found):
    return found.select("run_id", "axis", "status", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "probes_used")


def bisect_cheap(spark, d):
    """The search without a scan, over responses that change once."""
    return _rounded(R.searched(_responses(spark, d).where("recovers IS NULL"), 1 / 32))


def bisect_verified(spark, d):
    """The search after a scan of five points, which finds the responses that recover."""
    return _rounded(R.searched(_responses(spark, d), 1 / 32, 5))


def locate_inverted_axis(spark, d):
    """The same on axes whose low end is the severe one: brackets in ascending order all the same."""
    inverted = [a for a in _NAMES if AXES[a].severe_end == "lo"]
    return _rounded(R.searched(_responses(spark, d).where(F.col("axis").isin(inverted)), 1 / 32, 5))


def boundary_width(spark, d):
    """Width and middle of every bracket, null where it is open."""
    found = R.searched(_responses(spark, d), 1 / 32, 5)
    width, middle = R.width_and_middle(F.col("lower"), F.col("upper"))
    return found.select("run_id", "axis", F.round(width, 9).alias("width"), F.round(middle, 9).alias("middle"))


def boundary_witness(spark, d):
    """The failing probe of least axis value of each run's grid."""
    probes = R.grid_probes(_responses(spark, d)).withColumn("value", to_value(F.col("s"))).select("run_id", "axis", "value", "failed", "idx")
    return R.witness(probes).select("run_id", "axis", F.round("value", 9).alias("value"), "idx")


def missing_scan_points(spark, d):
    """Scan points of every run that its observed values do not hold, to a relative and absolute 1e-12."""
    seen = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.floor(F.col("value") / 25) / 4.0).alias("v")).distinct()
    wanted = seen.select("run_id").distinct().crossJoin(F.broadcast(spark.range(9).select((F.col("id") / 8.0).alias("w"))))  # nine rows
    close = (F.col("e.run_id") == F.col("o.run_id")) & (F.abs(F.col("w") - F.col("v")) <= F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs("w"), F.abs("v"))))
    return wanted.alias("e").join(seen.alias("o"), close, "left_anti")


def regression_check(spark, d):
    """New findings against old ones in severity, so that either end of an axis may be the severe one; old edges lie 1/64 higher, and every
    eleventh run is new."""
    old = R.searched(_responses(spark, d, 1 / 64).where("run_id % 11 != 0"), 1 / 32, 5)
    return R.regressions(R.searched(_responses(spark, d), 1 / 32, 5), old)


def savings_by_level(spark, d):
    """Grid steps by probes of the verified search (five of the scan, then halvings), over the runs it is valid on."""
    saved = F.when(F.col("valid"), F.col("saving"))
    out = R.compared_to_grid(_responses(spark, d)).groupBy("steps").agg(F.count("*").alias("n_runs"), F.count_if("valid").alias("n_valid"), F.round(F.avg(saved), 9).alias("mean_saving"), F.round(F.min(saved), 9).alias("min_saving"))
    return out.withColumn("gate", F.coalesce(F.col("min_saving") >= 3.0, F.lit(False)))


def matrix_summary(spark, d):
    """Search runs over sets and detectors: combinations, located ones, largest error (none counts 0), least saving."""
    rows = table(spark, d, "orders").select(
        F.pmod("o_custkey", F.lit(3)).alias("dataset"), F.pmod("o_orderkey", F.lit(2)).alias("detector"),
        (F.col("o_orderstatus") != "P").alias("located"), F.when(F.pmod("o_orderkey", F.lit(7)) > 0, F.pmod("o_orderkey", F.lit(5)) / 4.0).alias("error"), (33.0 / (6 + F.pmod("o_custkey", F.lit(5)))).alias("saving"),
    )
    return rows.groupBy("dataset").agg(
        F.countDistinct(F.struct("dataset", "detector", "located")).alias("combinations"), F.sum(F.col("located").cast("long")).alias("n_located"), F.max(F.coalesce("error", F.lit(0.0))).alias("max_error"), F.round(F.min("saving"), 9).alias("min_saving")
    )


_EVENTS = "e AS (SELECT user_id AS run_id, ts, event_id, value, value < 50 AS failed, lag(value < 50) OVER w AS b, lag(value) OVER w AS v, row_number() OVER w AS \"at\" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
# The oracles say in closed form what the search comes to: the first grid point at or above the edge is its ceiling.
_E = """
WITH m AS (SELECT user_id AS run_id, ((sum(event_id) % 1100)::DOUBLE + 0.37::DOUBLE) / 1000 - 0.05::DOUBLE AS edge FROM events GROUP BY 1),
e AS (SELECT m.*, axis, benign, severe, CASE WHEN run_id % 7 = 0 AND edge >= 0 THEN edge + 0.3::DOUBLE END AS recovers
  FROM m JOIN (VALUES (0, 'fog.beta_per_m', 0.0::DOUBLE, 0.12::DOUBLE), (1, 'jpeg.quality', 100.0, 5.0), (2, 'low_light.illuminance_lux', 400.0, 0.5), (3, 'motion_blur.exposure_ms', 0.0, 40.0)) v(place, axis, benign, severe) ON run_id % 4 = place)"""
_ASK = """
k AS (SELECT *, greatest(0, ceil(edge * 32)) AS k, coalesce(recovers <= 1, false) AS back FROM e),
z AS (SELECT *, CASE WHEN back AND floor(recovers * 4) < recovers * 4 THEN 'not_monotone' WHEN k = 0 THEN 'fails_throughout' WHEN k > 32 THEN 'passes_throughout' ELSE 'located' END AS status FROM k),
f AS (SELECT run_id, axis, status, k, CASE WHEN status = 'located' THEN least(benign + (k - 1) / 32 * (severe - benign), benign + k / 32 * (severe - benign)) END AS lower,
  CASE WHEN status = 'located' THEN greatest(benign + (k - 1) / 32 * (severe - benign), benign + k / 32 * (severe - benign)) END AS upper, CASE WHEN status = 'located' THEN 8 ELSE 5 END AS probes_used, benign, severe FROM z)"""
_FOUND = "SELECT run_id, axis, status, round(lower, 9) AS lower, round(upper, 9) AS upper, {}::INT AS probes_used FROM f {}"
_CHEAP = _E + "," + _ASK.replace("FROM e)", "FROM e WHERE recovers IS NULL)") + _FOUND.format("CASE status WHEN 'fails_throughout' THEN 1 WHEN 'passes_throughout' THEN 2 ELSE 7 END", "")
_MILD = """, o AS (SELECT run_id, CASE WHEN back THEN 'not_monotone' WHEN j = 0 THEN 'fails_throughout' WHEN j > 32 THEN 'passes_throughout' ELSE 'located' END AS old_status, j
  FROM (SELECT run_id, greatest(0, ceil((edge + 1 / 64.0::DOUBLE) * 32)) AS j, coalesce(recovers_ <= 1, false) AS back FROM (SELECT *, CASE WHEN run_id % 7 = 0 AND edge >= 0 THEN edge + 0.3::DOUBLE END AS recovers_ FROM m)) WHERE run_id % 11 <> 0)
SELECT f.run_id, axis, status, old_status, CASE WHEN old_status IS NULL THEN 'new' WHEN status = 'fails_throughout' THEN 'skipped: fails throughout' WHEN status <> 'located' THEN 'skipped'
  WHEN old_status = 'passes_throughout' THEN 'regression: boundary appeared' WHEN old_status <> 'located' THEN 'skipped' WHEN k < j THEN 'regression: milder condition' ELSE 'ok' END AS outcome FROM f LEFT JOIN o USING (run_id)"""
_EVENTS = "e AS (SELECT user_id AS run_id, ts, event_id, value, value < 50 AS failed, lag(value < 50) OVER w AS b, lag(value) OVER w AS v, row_number() OVER w AS \"at\" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
QUERIES = {f.__name__: f for f in (transitions, first_crossing, nested_grid, bisect_cheap, bisect_verified, locate_inverted_axis, boundary_width, boundary_witness, missing_scan_points, regression_check, savings_by_level, matrix_summary)}
SQL = {
    "nested_grid": _E + " SELECT run_id, axis, steps::INT AS steps, count(*) AS n_probes, sum((i / (steps - 1.0::DOUBLE) >= edge AND coalesce(i / (steps - 1.0::DOUBLE) < recovers, true))::INT)::BIGINT AS n_failed, CASE WHEN edge <= 1 THEN greatest(0, ceil(edge * (steps - 1)))::INT * (32 // (steps - 1))::INT END AS first_failed FROM e, (VALUES (33), (17), (9), (5)) g(steps), range(33) n(i) WHERE i < steps GROUP BY run_id, axis, steps, edge",
    "bisect_cheap": _CHEAP,
    "bisect_verified": _E + "," + _ASK + _FOUND.format("probes_used", ""),
    "locate_inverted_axis": _E + "," + _ASK + _FOUND.format("probes_used", "WHERE severe < benign"),
    "boundary_width": _E + "," + _ASK + " SELECT run_id, axis, CASE WHEN status = 'located' THEN round(abs(severe - benign) / 32, 9) END AS width, CASE WHEN status = 'located' THEN round(benign + (2 * k - 1) / 64 * (severe - benign), 9) END AS middle FROM f",
    "boundary_witness": _E + " SELECT run_id, axis, round(benign + i / 32.0::DOUBLE * (severe - benign), 9) AS value, i::INT AS idx FROM (SELECT *, CASE WHEN severe > benign THEN greatest(0, ceil(edge * 32)) ELSE least(32, coalesce(ceil(recovers * 32) - 1, 32)) END AS i FROM e) WHERE edge <= 1",
    "regression_check": _E + "," + _ASK + _MILD,
    "savings_by_level": _E + "," + _ASK + ", v AS (SELECT steps, (SELECT count(*) FROM f) AS n_runs, (SELECT count(*) FROM f WHERE status = 'located') AS n_valid, round(steps / (5 + log2((steps - 1) / 4)), 9) AS s FROM (VALUES (33), (17), (9), (5)) g(steps)) SELECT steps::INT AS steps, n_runs, n_valid, s AS mean_saving, s AS min_saving, s >= 3 AS gate FROM v",
    "transitions": f"WITH {_EVENTS} SELECT run_id, \"at\", event_id, b AS before, failed FROM e WHERE failed <> b",
    "first_crossing": f"WITH {_EVENTS} SELECT run_id, min(\"at\") AS \"at\", least(min_by(v, \"at\"), min_by(value, \"at\")) AS lower, greatest(min_by(v, \"at\"), min_by(value, \"at\")) AS upper FROM e WHERE failed AND NOT b GROUP BY run_id",
    "missing_scan_points": "WITH o AS (SELECT DISTINCT user_id AS run_id, floor(value / 25) / 4.0::DOUBLE AS v FROM events) SELECT run_id, w FROM (SELECT DISTINCT run_id FROM o) r, (SELECT unnest(range(9)) / 8.0::DOUBLE AS w) g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.run_id = r.run_id AND abs(w - v) <= greatest(1e-12, 1e-12 * greatest(abs(w), abs(v))))",
    "matrix_summary": "SELECT dataset, count(DISTINCT (dataset, detector, located)) AS combinations, sum(located::INT)::BIGINT AS n_located, max(coalesce(error, 0)) AS max_error, round(min(saving), 9) AS min_saving FROM (SELECT o_custkey % 3 AS dataset, o_orderkey % 2 AS detector, o_orderstatus <> 'P' AS located, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 5) / 4.0::DOUBLE END AS error, 33.0::DOUBLE / (6 + o_custkey % 5) AS saving FROM orders) GROUP BY 1",
}
