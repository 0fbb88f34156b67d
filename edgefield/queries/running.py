"""Kernels over frames, level sets, round planning and streams. Some have no SQL: they are tested against figures and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgefield.functions.axes import AXES
from edgefield.operators import kernels as K
from edgefield.operators import maps, measures
from edgefield.plans import levelset, rounds, runs
from edgefield.queries.recording import TILE, tiles
from edgefield.sources.shared import folder, written
from edgefield.sources.tables import table
from edgefield.streaming import ledger, planning

_SEED = 20260906
_AXES = ("fog.beta_per_m", "jpeg.quality", "low_light.illuminance_lux", "motion_blur.exposure_ms")


def kernel_sweep(spark, d):
    """The frame of every embedding at the benign end, the middle and the severe end of every axis, with measures and a digest of the pixels."""
    conditions = [(name, axis.from_severity(s)) for name, axis in AXES.items() for s in (0.0, 0.5, 1.0)]
    return K.sweep(tiles(spark, d), conditions, _SEED, measures.measured_stack, measures.NAMES)


def _levels(stack):
    told = measures.measured_stack(stack)
    return {"mean_level": told["mean_level"].round(6), "rms_contrast": told["rms_contrast"].round(6)}


def fog_sweep(spark, d):
    """Mean level and contrast of the frame of every embedding at nine densities of fog."""
    conditions = [("fog.beta_per_m", AXES["fog.beta_per_m"].from_severity(i / 8)) for i in range(9)]
    return K.sweep(tiles(spark, d), conditions, _SEED, _levels, ("mean_level", "rms_contrast")).select("image_id", F.round("value", 6).alias("beta_per_m"), "mean_level", "rms_contrast")


def mtf50(spark, d):
    """Where the spectrum of each vector's frame falls to half."""
    return measures.measure(tiles(spark, d), ["image_id"]).select("image_id", "mtf50_cy_px")


def _line_maps(spark, d):
    """Maps of 17 x 17 cells, one for each flag, status and place of a line: the share of its lines that reach a quantity and a price."""
    li = table(spark, d, "lineitem")
    cell = lambda c, top: F.floor(F.col(c) * 17 / top).cast("int")
    return maps.survival(li.select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("map"), cell("l_quantity", 51.0).alias("i"), cell("l_extendedprice", 110000.0).alias("j")), 17)


def line_surface(spark, d):
    """The whole surface of every map of lines."""
    return _line_maps(spark, d).select("map", "i", "j", F.round("value", 9).alias("value"))


def level_set(spark, d):
    """Every map of lines classified at a share of a quarter, from the few of its cells that its process asks for."""
    surface = written(_line_maps(spark, d), "surface")
    return levelset.classified_maps(surface, lambda ask: surface.join(ask, ["map", "i", "j"], "left_semi"), 0.25, wave=8)


def _recorded(spark, e):
    """Events as records: probes at 33 severities of the axis that an event's kind stands for, judged by an edge of the run; for most runs a baseline."""
    place, g = F.pmod("event_id", F.lit(4)).cast("int"), F.floor(F.col("value") * 32 / 100)
    edge = (F.pmod(F.col("user_id") * 7 + place * 5, F.lit(41)) - 3.5) / 32
    axis = F.element_at(F.array(*map(F.lit, _AXES)), place + 1)
    null = F.lit(None)
    probe = F.struct(F.concat(axis, F.lit("#"), g).alias("probe_id"), axis.alias("axis"), (g / 32.0).alias("s"), F.when(g / 32.0 >= edge, 0.1).otherwise(0.6).alias("map50"))
    base = F.struct(F.lit(rounds.BASELINE).alias("probe_id"), null.cast("string").alias("axis"), null.cast("double").alias("s"), F.lit(0.6).alias("map50"))
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seen"), F.explode(F.when(F.col("user_id") % 10 != 0, F.array(probe, base)).otherwise(F.array(probe))).alias("r"))
    return rows.select("run_id", "r.probe_id", "r.axis", rounds.to_value(F.col("r.s"), F.col("r.axis")).alias("value"), "r.map50", "seen")


def _defined(spark, e):
    """Runs of users and their axes."""
    ids = e.select(F.col("user_id").alias("run_id")).distinct()
    runs = ids.select("run_id", (0.2 + F.pmod("run_id", F.lit(9)) / 10.0).alias("budget"), F.lit(0.01).alias("price"), F.lit(0.0).alias("prepaid"), F.lit(0.6).alias("share"), F.lit(5).alias("verify"))
    axes = ids.crossJoin(F.broadcast(spark.createDataFrame(list(enumerate(_AXES)), "place int, axis string"))).select("run_id", "axis", "place", F.lit(1 / 32).alias("width"), F.when(F.pmod("run_id", F.lit(13)) == 0, 6).alias("cap"))  # four axes
    return runs, axes


def _plan(spark, d) -> rounds.Plan:
    e = table(spark, d, "events")
    ledger = _recorded(spark, e).select("run_id", "probe_id", "axis", "value", "map50").distinct()
    return rounds.plan_rounds(*_defined(spark, e), written(ledger, "probes"))


def round_plan(spark, d):
    """What the next round of every run does, and how many of its probes can be paid."""
    return _plan(spark, d).actions.select("run_id", "action", "requested", "paid", F.round("spent", 6).alias("spent"), F.round("remaining", 6).alias("remaining"))


def round_findings(spark, d):
    """What is known of every run's axes."""
    return _plan(spark, d).findings.select("run_id", "axis", "status", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "width", "middle")], "probes_used")


def round_probes(spark, d):
    """The probes that the next round of every run asks for and can pay."""
    return _plan(spark, d).probes.select("run_id", "axis", F.round("value", 6).alias("value"))


def grid_crossing(spark, d):
    """Where each axis of a run first turns from pass to fail, from its mildest condition to its most severe, in the axis's units."""
    e = table(spark, d, "events")
    runs_, axes = _defined(spark, e)
    found = runs.crossings(rounds.observed(runs_, axes, _recorded(spark, e).drop("seen")))
    ends = found.select("run_id", "axis", "status", *[rounds.to_value(F.col(f"{x}_s"), F.col("axis")).alias(f"{x}_value") for x in ("pass", "fail")], "n")
    both = [f(F.col("pass_value"), F.col("fail_value")).alias(c) for f, c in ((F.least, "lower"), (F.greatest, "upper"))]
    return ends.select("*", *both).select("run_id", "axis", "status", *[F.round(c, 6).alias(c) for c in ("pass_value", "fail_value", "lower", "upper")], "n")


def _planned_from_stream(spark, d) -> str:
    """The ledger arrives as three files, one a batch, by a hash of the event; every batch plans the runs that it reports on."""
    to, e = folder(spark, "planned"), table(spark, d, "events")
    parts = e.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    parts.repartition("part").write.partitionBy("part").parquet(f"{to}/in")
    rows = _recorded(spark, ledger.events(spark, f"{to}/in", batch_files=1))
    ledger.drained(rows, "append", f"{to}/check", planning.planner(*_defined(spark, e), f"{to}/out"))
    return f"{to}/out"


def streamed_plan(spark, d):
    """What the next round of every run does, planned batch by batch from the stream of its ledger."""
    return planning.actions(spark, _planned_from_stream(spark, d)).select("run_id", "action", "requested", "paid", F.round("spent", 6).alias("spent"), F.round("remaining", 6).alias("remaining"))


def streamed_probes(spark, d):
    """The probes that the stream's last plan of every run asks for."""
    return planning.wanted(spark, _planned_from_stream(spark, d)).select("run_id", "axis", F.round("value", 6).alias("value"))


def _streamed(spark, d, rows, mode, sink) -> str:
    to = folder(spark, "stream")
    ledger.drained(rows(ledger.events(spark, d, "events.parquet")), mode, f"{to}/check", lambda df, n: sink(df, n).write.mode("overwrite").parquet(f"{to}/out/batch={n}"))
    return f"{to}/out"


def streaming_ledger(spark, d):
    """Verdicts by run and axis from a stream of records in which retries repeat a probe: the last state of each key."""
    out = _streamed(spark, d, ledger.verdicts, "update", lambda df, n: df.withColumn("batch", F.lit(n)))
    last = spark.read.parquet(out).groupBy("run_id", "axis").agg(F.max_by(F.struct("n_failed", "n_passed"), "batch").alias("s"))
    return last.select("run_id", "axis", "s.n_failed", "s.n_passed").where("n_failed + n_passed > 0")


def streaming_windows(spark, d):
    """Counts by hour and kind, of windows that the watermark closed."""
    out = _streamed(spark, d, ledger.windows, "append", lambda df, n: df)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "top")


def streaming_sliding(spark, d):
    """Counts by overlapping windows of an hour, one every quarter, of those that the watermark closed."""
    out = _streamed(spark, d, ledger.sliding, "append", lambda df, n: df)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "top")


def streaming_sessions(spark, d):
    """Bouts of each run that the watermark closed."""
    out = _streamed(spark, d, ledger.sessions, "append", lambda df, n: df)
    return spark.read.parquet(out).select("run_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


_K = f"""
WITH e AS (SELECT user_id AS run_id, event_id % 4 AS place, floor(value * 32 / 100)::BIGINT AS g FROM events),
o AS (SELECT DISTINCT run_id, place, g, g / 32.0::DOUBLE >= ((run_id * 7 + place * 5) % 41 - 3.5) / 32 AS f FROM e),
r AS (SELECT DISTINCT run_id, 0.2::DOUBLE + (run_id % 9) / 10.0::DOUBLE AS budget, run_id % 10 <> 0 AS based, CASE WHEN run_id % 13 = 0 THEN 6 END AS cap FROM e),
m AS (SELECT r.*, (SELECT count(*) FROM o WHERE o.run_id = r.run_id) + based::INT AS charged FROM r),
x AS (SELECT m.*, place, axis, benign, severe FROM m, (VALUES (0, 'fog.beta_per_m', 0.0::DOUBLE, 0.12::DOUBLE), (1, 'jpeg.quality', 100.0, 5.0), (2, 'low_light.illuminance_lux', 400.0, 0.5), (3, 'motion_blur.exposure_ms', 0.0, 40.0)) v(place, axis, benign, severe) WHERE based),
l AS (SELECT x.*, coalesce((SELECT list(g ORDER BY g) FROM o WHERE o.run_id = x.run_id AND o.place = x.place AND NOT f), []::BIGINT[]) AS ok, coalesce((SELECT list(g ORDER BY g) FROM o WHERE o.run_id = x.run_id AND o.place = x.place AND f), []::BIGINT[]) AS bad FROM x),
s AS (SELECT *, len(ok) + len(bad) AS used, [p FOR p IN [0, 8, 16, 24, 32] IF NOT list_contains(ok, p) AND NOT list_contains(bad, p)] AS absent FROM l),
t AS (SELECT *, CASE WHEN len(absent) > 0 THEN NULL WHEN list_contains(bad, 0) THEN 'fails_throughout' WHEN list_contains(ok, 32) THEN 'passes_throughout' WHEN list_min(bad) - list_max(ok) <= 1 THEN 'located' END AS early FROM s),
u AS (SELECT *, CASE WHEN early IS NULL AND cap <= used THEN 'capped' ELSE early END AS status,
  CASE WHEN early IS NOT NULL THEN []::DOUBLE[] WHEN len(absent) > 0 THEN [p::DOUBLE FOR p IN absent] ELSE [(list_min(bad) + list_max(ok)) / 2.0::DOUBLE] END AS ask FROM t),
w AS (SELECT run_id, place, axis, benign, severe, unnest(ask[1:greatest(0, coalesce(cap - used, 99))]) AS g FROM u WHERE status IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place, g) AS k FROM w),
y AS (SELECT m.*, CASE WHEN based THEN (SELECT count(*) FROM w WHERE w.run_id = m.run_id) ELSE 1 END AS requested, greatest(0, floor((budget - charged * 0.01::DOUBLE) / 0.01::DOUBLE + 1e-9))::BIGINT AS affordable FROM m)
"""
_VERDICTS = "WITH k AS (SELECT user_id AS run_id, event_id % 64 AS p, arg_min(event_type, event_id) AS axis, arg_min(value < 50, event_id) AS failed FROM events GROUP BY ALL) SELECT run_id, axis, sum(failed::INT)::BIGINT AS n_failed, sum((NOT failed)::INT)::BIGINT AS n_passed FROM k GROUP BY ALL"
_SLIDING = "SELECT * FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, max(value) AS top FROM events, range(4) r(i) GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
_SESSIONS = """WITH a AS (SELECT user_id AS run_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT run_id, ts, sum(new) OVER (PARTITION BY run_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM a)
SELECT * FROM (SELECT run_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM b GROUP BY run_id, k) WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""

# single precision where the kernel has it; kernel and text agree on every level, row and density of these frames
_FOG = f"""WITH {TILE}, p AS (SELECT image_id, k, i, g[i + 1] AS v, exp((-(0.015::DOUBLE * k)::FLOAT * (80.0::DOUBLE - 75.0::DOUBLE * (i // 8) / 7)::FLOAT)::DOUBLE)::FLOAT AS t FROM t, range(9) b(k), range(64) r(i)),
f AS (SELECT image_id, k, CASE WHEN k = 0 THEN v ELSE floor((v::FLOAT / 255::FLOAT * t + 0.9::FLOAT * (1::FLOAT - t)) * 255::FLOAT)::DOUBLE END AS v FROM p)
SELECT image_id, round(0.015::DOUBLE * k, 6) AS beta_per_m, round(sum(v) / 64, 6) AS mean_level, round(sqrt((64 * sum(v * v) - sum(v) * sum(v)) / 4096.0::DOUBLE), 6) AS rms_contrast FROM f GROUP BY 1, 2, k"""

QUERIES = {f.__name__: f for f in (kernel_sweep, fog_sweep, mtf50, line_surface, level_set, grid_crossing, round_plan, round_findings, round_probes, streamed_plan, streamed_probes, streaming_ledger, streaming_windows, streaming_sliding, streaming_sessions)}
SQL = {
    "fog_sweep": _FOG,
    "grid_crossing": """WITH o AS (SELECT DISTINCT user_id AS run_id, event_id % 4 AS place, floor(value * 32 / 100) / 32.0::DOUBLE AS s FROM events WHERE user_id % 10 <> 0),
v AS (SELECT *, s >= ((run_id * 7 + place * 5) % 41 - 3.5) / 32 AS f FROM o),
a AS (SELECT run_id, place, count(*) AS n, bool_or(f) AS any_failed, min(s) FILTER (f) AS q, max(s) FILTER (NOT f) AS p FROM v GROUP BY ALL),
x AS (SELECT *, p < q AS crossed FROM a JOIN (VALUES (0, 'fog.beta_per_m', 0.0::DOUBLE, 0.12::DOUBLE), (1, 'jpeg.quality', 100.0, 5.0), (2, 'low_light.illuminance_lux', 400.0, 0.5), (3, 'motion_blur.exposure_ms', 0.0, 40.0)) v(place, axis, benign, severe) USING (place))
SELECT run_id, axis, CASE WHEN crossed THEN 'crossed' WHEN any_failed THEN 'fails_throughout' ELSE 'passes_throughout' END AS status, round(w, 6) AS pass_value, round(z, 6) AS fail_value, round(least(w, z), 6) AS lower, round(greatest(w, z), 6) AS upper, n
FROM (SELECT *, CASE WHEN crossed THEN benign + p * (severe - benign) END AS w, CASE WHEN crossed THEN benign + q * (severe - benign) END AS z FROM x)""",
    "line_surface": """WITH l AS (SELECT l_returnflag || l_linestatus || l_linenumber AS map, floor(l_quantity * 17 / 51)::INT AS i, floor(l_extendedprice * 17 / 110000)::INT AS j FROM lineitem),
c AS (SELECT map, i, j, count(*) AS n FROM l WHERE i BETWEEN 0 AND 16 AND j BETWEEN 0 AND 16 GROUP BY ALL), t AS (SELECT map, sum(n) AS n FROM c GROUP BY 1)
SELECT map, a.i::INT AS i, b.j::INT AS j, round(coalesce((SELECT sum(c.n) FROM c WHERE c.map = t.map AND c.i >= a.i AND c.j >= b.j), 0)::DOUBLE / t.n::DOUBLE, 9) AS value FROM t, range(17) a(i), range(17) b(j)""",
    "round_plan": _K + "SELECT run_id, CASE WHEN requested = 0 THEN 'done' WHEN affordable = 0 THEN 'halted' ELSE 'probe' END AS action, requested, least(requested, affordable) AS paid, round(charged * 0.01::DOUBLE, 6) AS spent, round(budget - charged * 0.01::DOUBLE, 6) AS remaining FROM y",
    "round_findings": _K + "SELECT run_id, axis, status, round(least(p, q), 6) AS lower, round(greatest(p, q), 6) AS upper, round(abs(p - q), 6) AS width, round((p + q) / 2, 6) AS middle, used AS probes_used FROM (SELECT *, CASE WHEN status = 'located' THEN benign + list_max(ok) / 32.0::DOUBLE * (severe - benign) END AS p, CASE WHEN status = 'located' THEN benign + list_min(bad) / 32.0::DOUBLE * (severe - benign) END AS q FROM u WHERE status IS NOT NULL)",
    "round_probes": _K + "SELECT run_id, axis, round(benign + g / 32 * (severe - benign), 6) AS value FROM n JOIN y USING (run_id) WHERE k <= affordable UNION ALL SELECT run_id, NULL, NULL FROM y WHERE NOT based AND affordable > 0",
    "streaming_ledger": _VERDICTS,
    "streaming_windows": "SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "streaming_sliding": _SLIDING,
    "streaming_sessions": _SESSIONS,
}
SQL |= {"streamed_plan": SQL["round_plan"], "streamed_probes": SQL["round_probes"]}
