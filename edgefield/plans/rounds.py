"""Round planning: the next wave of every run, from the runs' definitions and what their ledgers hold, as one plan over tables.

runs: run_id, budget, price, prepaid, share, verify. axes: run_id, axis, place (order within the run), width (of the bracket
wanted, as a severity), cap (most probes on the axis, or null). ledger: run_id, probe_id, axis (null for the baseline), value,
map50. Nothing else is known of a run, so a wave that was lost is simply asked for again.

An axis is scanned at verify even severities; a scan with one change between pass and fail is halved in between. All that the
ledger holds between the two counts, whoever asked for it: the bracket runs from the last pass below the first failure to that.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgefield.functions.axes import AXES
from edgefield.sources.shared import written

BASELINE = "baseline"
RUN_AXIS = ["run_id", "axis"]


class Plan(NamedTuple):
    findings: DataFrame  # run_id, axis, status, lower, upper, width, middle, probes_used
    probes: DataFrame  # run_id, probe_id, axis, value, command: those that can be paid
    actions: DataFrame  # run_id, action, requested, paid, spent, remaining


def _end(severity: float, axis: Column | None) -> Column:
    ends = F.create_map(*[F.lit(x) for a in AXES.values() for x in (a.name, float(a.from_severity(severity)))])
    return F.element_at(ends, F.col("axis") if axis is None else axis)


def to_value(s: Column, axis: Column | None = None) -> Column:
    """A severity in the units of its axis, which the column axis names unless another does."""
    return _end(0.0, axis) + s * (_end(1.0, axis) - _end(0.0, axis))


def to_severity(value: Column, axis: Column | None = None) -> Column:
    return (value - _end(0.0, axis)) / (_end(1.0, axis) - _end(0.0, axis))


def _key(s: Column) -> Column:
    """Severities that are the same to a thousand-millionth have one key."""
    return F.floor(s * 1e9 + 0.5).cast("long")


def _conditions(ledger: DataFrame) -> DataFrame:
    """run_id, axis, k, s, map50: each condition that a ledger holds of one axis, once, with the least result it gave."""
    seen = ledger.where("axis IS NOT NULL").withColumn("s", to_severity(F.col("value")))
    return seen.groupBy(*RUN_AXIS, _key(F.col("s")).alias("k")).agg(F.min("s").alias("s"), F.min("map50").alias("map50"))


def _judged(axes: DataFrame, ledger: DataFrame, how: str) -> DataFrame:
    """axes with bar, one row for each condition that the ledger holds of them: adds k, s and failed, drops bar."""
    met = axes.join(_conditions(ledger).hint("merge"), RUN_AXIS, how)
    return met.withColumn("failed", F.col("map50") < F.col("bar")).drop("map50", "bar")


def observed(runs: DataFrame, axes: DataFrame, ledger: DataFrame) -> DataFrame:
    """run_id, axis, k, s, failed: each condition of a run's axes that its ledger holds, once, judged by the run's baseline."""
    base = ledger.where(F.col("probe_id") == BASELINE).groupBy("run_id").agg(F.max("map50").alias("base"))
    bar = runs.join(base.hint("merge"), "run_id").select("run_id", (F.col("share") * F.col("base")).alias("bar"))
    return _judged(axes.select(*RUN_AXIS).join(bar.hint("merge"), "run_id"), ledger, "inner")


def _brackets(judged: DataFrame) -> DataFrame:
    """The axes of judged, a row each, with used, absent (places of the scan without a result, in order), changes, first, and a and b: for a
    whole scan with one change, its bracket, halved so far. An axis's conditions stay rows, which windows spill; those beyond its ends are only counted."""
    own = [c for c in judged.columns if c not in (*RUN_AXIS, "k", "s", "failed")]
    each = Window.partitionBy(*RUN_AXIS, "place")
    last = F.col("verify") - 1
    at = F.round(F.col("s") * last).cast("int")
    met = F.col("failed").isNotNull() & at.between(F.lit(0), last) & (_key(at / last.cast("double")) == F.col("k"))
    placed = judged.withColumn("i", F.when(met, at))
    before = F.lag(F.when(F.col("i").isNotNull(), F.struct("s", "failed"))).over(each.orderBy("i"))
    turn = F.when(F.col("i").isNotNull() & (F.col("failed") != F.col("before.failed")), F.struct("i", F.col("before.s").alias("lo"), F.col("s").alias("hi")))
    turned = placed.withColumn("before", before).withColumn("turn", turn).withColumn("one", F.min("turn").over(each))
    inside = (F.col("s") >= F.col("one.lo") - 1e-9) & (F.col("s") <= F.col("one.hi") + 1e-9)
    ends = turned.withColumn("inside", inside).withColumn("b", F.min(F.when(F.col("inside") & F.col("failed"), F.col("s"))).over(each))
    out = ends.groupBy(*RUN_AXIS, *own).agg(
        F.count("k").alias("used"), F.collect_set("i").alias("places"), F.count("turn").alias("changes"),
        F.min(F.when(F.col("i").isNotNull(), F.struct("i", "failed")))["failed"].alias("first"),
        F.max(F.when(F.col("inside") & ~F.col("failed") & (F.col("s") < F.col("b")), F.col("s"))).alias("a"), F.max("b").alias("b"),
    )
    out = out.withColumn("absent", F.array_except(F.sequence(F.lit(0), last), F.col("places"))).drop("places")
    whole = (F.size("absent") == 0) & (F.col("changes") == 1)
    return out.withColumns({c: F.when(whole, F.col(c)) for c in ("a", "b")})


def plan_rounds(runs: DataFrame, axes: DataFrame, ledger: DataFrame, seed: int = 20260906) -> Plan:
    """The next wave of every run. A run without a baseline asks for that alone; the baseline is charged like any probe. A probe of the
    scan whose result is null is asked for again.

    The ledger is read for sums of each run and for the conditions of its axes; from then on an axis is one row. Sums and axes are
    written to the shared folder, since all that is planned reads them: a plan that spells them out each time outgrows the driver.
    Tables of a row for each run or axis are joined by sort and merge at any size: even while a shuffle of them is small enough to
    become a broadcast at run time, the driver would have to hold them, some of them several times."""
    based = F.col("probe_id") == BASELINE
    each = ledger.groupBy("run_id").agg(F.count("*").alias("charged"), F.count_if(based).alias("based"), F.max(F.when(based, F.col("map50"))).alias("base"))
    money = runs.join(each.hint("merge"), "run_id", "left").withColumns({"charged": F.coalesce("charged", F.lit(0)), "ready": F.coalesce(F.col("based") > 0, F.lit(False)), "bar": F.col("share") * F.col("base")})
    money = money.withColumn("spent", F.col("prepaid") + F.col("charged") * F.col("price"))
    money = money.withColumn("affordable", F.greatest(F.lit(0), F.floor((F.col("budget") - F.col("spent")) / F.col("price") + 1e-9))).select("run_id", "budget", "spent", "affordable", "verify", "ready", "bar")
    money = written(money, "money")

    ready = axes.join(money.where("ready").select("run_id", "verify", "affordable", "bar").hint("merge"), "run_id").select(*RUN_AXIS, "place", "width", "cap", "verify", "affordable", "bar")
    state = _brackets(_judged(ready, ledger, "left"))
    one_sided = F.col("a").isNull() | F.col("b").isNull()  # the scan turns from fail to pass
    left = F.coalesce(F.col("cap") - F.col("used"), F.lit(1 << 30))
    status = (
        F.when(F.size("absent") > 0, None)
        .when(F.col("changes") > 1, "not_monotone")
        .when(F.col("changes") == 0, F.when(F.col("first"), "fails_throughout").otherwise("passes_throughout"))
        .when(one_sided, "not_monotone")
        .when(F.col("b") - F.col("a") <= F.col("width") + 1e-12, "located")
    )
    state = written(state.withColumn("status", F.coalesce(status, F.when(left <= 0, "capped"))), "state")
    ends = [F.when(F.col("status") == "located", to_value(F.col(x))) for x in ("a", "b")]
    found = state.where("status IS NOT NULL").select("run_id", "axis", "status", F.least(*ends).alias("lower"), F.greatest(*ends).alias("upper"), F.col("used").alias("probes_used"))
    findings = found.withColumns({"width": F.col("upper") - F.col("lower"), "middle": (F.col("lower") + F.col("upper")) / 2})

    points = F.transform("absent", lambda i: i / (F.col("verify") - 1.0))
    ask = F.when(F.size("absent") > 0, points).otherwise(F.array((F.col("a") + F.col("b")) / 2))
    open_ = state.where("status IS NULL").select("run_id", "axis", "place", "affordable", F.slice(ask, F.lit(1), F.greatest(left, F.lit(0)).cast("int")).alias("ask"))
    asked = open_.select("run_id", "axis", "place", "affordable", F.explode("ask").alias("s"))
    first = money.where("NOT ready").select("run_id", F.lit(None).cast("string").alias("axis"), F.lit(-1).alias("place"), "affordable", F.lit(0.0).alias("s"))
    wanted = first.unionByName(asked).withColumn("value", to_value(F.col("s")))
    turn = Window.partitionBy("run_id").orderBy("place", "s")  # a wave: as many rows as its axes have places
    paid = wanted.withColumn("n", F.row_number().over(turn)).where("n <= affordable")
    name = F.coalesce(F.concat(F.col("axis"), F.lit("@"), F.round("value", 12).cast("string")), F.lit(BASELINE))
    at = F.when(F.col("axis").isNotNull(), F.concat(F.lit(" --set "), F.col("axis"), F.lit("="), F.round("value", 12).cast("string"))).otherwise("")
    probes = paid.select("run_id", name.alias("probe_id"), "axis", "value", F.concat(F.lit("edgefield probe"), at, F.lit(f" --seed {seed}")).alias("command"))
    requested = open_.groupBy("run_id").agg(F.sum(F.size("ask")).alias("requested"))
    actions = money.join(requested.hint("merge"), "run_id", "left").withColumn("requested", F.when(~F.col("ready"), F.lit(1).cast("long")).otherwise(F.coalesce("requested", F.lit(0))))
    actions = actions.withColumn("paid", F.least("requested", "affordable").cast("long"))
    action = F.when(F.col("requested") == 0, "done").when(F.col("paid") == 0, "halted").otherwise("probe")
    return Plan(findings, probes, actions.select("run_id", action.alias("action"), "requested", "paid", "spent", (F.col("budget") - F.col("spent")).alias("remaining")))


def tables(spark, run_id: str, definition: dict, ledger: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run's definition and ledger records as the tables of plan_rounds. Records that set several axes count for none, but are charged."""
    d = definition
    runs = spark.createDataFrame([(run_id, float(d["budget_usd"]), float(d["cost_per_probe_usd"]), float(d.get("prepaid_usd") or 0), float(d.get("share", 0.6)), int(d.get("verify_samples", 5)))], "run_id string, budget double, price double, prepaid double, share double, verify int")
    caps = d.get("probes_per_axis") or {}
    axes = [(run_id, a["axis"], i, abs(a["target_width"] / (AXES[a["axis"]].hi - AXES[a["axis"]].lo)), caps.get(a["axis"])) for i, a in enumerate(d["axes"])]
    alone = lambda r: next(iter(r["set"].items())) if len(r["set"]) == 1 else (None, None)
    rows = [(run_id, r["probe_id"], *alone(r), float(r["map50"])) for r in ledger]
    rows = [(*r[:3], None if r[3] is None else float(r[3]), r[4]) for r in rows]
    return runs, spark.createDataFrame(axes, "run_id string, axis string, place int, width double, cap int"), spark.createDataFrame(rows, "run_id string, probe_id string, axis string, value double, map50 double")
