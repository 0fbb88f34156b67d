import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgefield import cli
from edgefield.functions.axes import AXES, unit_of
from edgefield.operators import ledgers
from edgefield.plans import budget, levelset, rounds
from edgefield.plans.search import boundary, grid_crossing, locate, next_step, transitions

CASES = [("motion_blur.exposure_ms", 13.1, 12.5, 13.75), ("low_light.illuminance_lux", 19.0, 12.984375, 25.46875), ("fog.beta_per_m", 0.061, 0.06, 0.06375), ("jpeg.quality", 9.4, 7.96875, 10.9375)]


def response(axis, edge):
    return lambda v: v >= edge if axis.severe_end == "hi" else v <= edge


@pytest.mark.parametrize("name,edge,lower,upper", CASES)
@pytest.mark.parametrize("verify,used", [(0, 7), (5, 8)])
def test_published_brackets_and_probe_counts(name, edge, lower, upper, verify, used):
    axis = AXES[name]
    fails = response(axis, edge)
    found = locate(axis, lambda vs: [fails(v) for v in vs], (axis.hi - axis.lo) / 32, verify)
    assert (found.status, found.probes_used) == ("located", used)
    assert (found.lower, found.upper) == pytest.approx((lower, upper))
    grid = grid_crossing(axis, [(v, fails(v)) for v in (axis.from_severity(i / 32) for i in range(33))])
    assert (grid.lower, grid.upper) == pytest.approx((found.lower, found.upper)) and 33 / found.probes_used >= 4.125


def drive(fails, width, **more):
    waves = boundary(width, **more)
    try:
        wave = next(waves)
        while True:
            wave = waves.send({s: fails(s) for s in wave})
    except StopIteration as stop:
        return stop.value


@settings(max_examples=200, deadline=None)
@given(st.floats(0.001, 0.999), st.integers(1, 9), st.sampled_from([0, 3, 5]))
def test_bracket_holds_the_edge(edge, k, verify):
    found = drive(lambda s: s >= edge, 2.0**-k, verify=verify)
    assert found.status == "located" and found.lower < edge <= found.upper and found.upper - found.lower <= 2.0**-k
    assert found.probes_used <= 2 + max(verify, 0) + k


def test_other_outcomes():
    assert drive(lambda s: True, 0.1).status == "fails_throughout"
    assert drive(lambda s: False, 0.1).status == "passes_throughout"
    assert drive(lambda s: True, 0.1, verify=5).status == "fails_throughout"
    band = lambda s: 0.4 < s < 0.6
    assert drive(band, 0.1).status == "passes_throughout"
    found = drive(band, 0.1, verify=5)
    assert found.status == "not_monotone" and len(found.transitions) == 2
    short = drive(lambda s: s > 0.3, 1e-6, most=5)
    assert short.status == "budget_exhausted" and short.lower <= 0.3 < short.upper and short.probes_used == 5
    assert transitions([(1.0, True), (0.0, False)]) == ((0.0, 1.0),)
    assert grid_crossing(AXES["fog.beta_per_m"], [(0.0, False), (0.1, False)]).status == "no_transition"


@pytest.mark.parametrize("name,edge,lower,upper", CASES)
@pytest.mark.parametrize("verify", [0, 5])
def test_planner_asks_for_what_the_search_probes(name, edge, lower, upper, verify):
    axis = AXES[name]
    fails = response(axis, edge)
    width = (axis.hi - axis.lo) / 32
    observed = {}
    while not (step := next_step(axis, observed, width, verify)).outcome:
        observed.update({v: fails(v) for v in step.wanted})
    local = locate(axis, lambda vs: [fails(v) for v in vs], width, verify)
    assert sorted(observed) == sorted(v for v, _ in local.probes) and step.outcome == local


def test_contract_logs_refusals_and_keeps_its_limit():
    c = budget.Contract(0.05, 0.01)
    c.charge(3)
    with pytest.raises(budget.Refused):
        c.charge(3)
    c.charge(2)
    assert [e["charged"] for e in c.ledger] == [True, False, True] and c.probes_remaining == 0
    assert not c.request(1).approved and c.request(0).approved


DECISION = "run_id string, seq long, tool string, cents long, order array<string>, split map<string,int>"


def effects(spark, decisions, axes, limit=5, price=1):
    runs = spark.createDataFrame([("r", axes, limit, price)], "run_id string, axes array<string>, limit long, price long")
    rows = [("r", i, tool, kw.get("cents"), kw.get("order"), kw.get("split")) for i, (tool, kw) in enumerate(decisions)]
    return ledgers.proposal_effects(spark.createDataFrame(rows, DECISION), runs).orderBy("seq").collect()


def test_gate_checks_in_order(spark):
    order, split = lambda *o: ("prioritize_axes", {"order": list(o)}), lambda **k: ("reallocate_budget", {"split": k})
    said = lambda *d: [(r.outcome, r.state) for r in effects(spark, d, ["a", "b"])]
    run, wait = "RUNNING", "AWAITING_APPROVAL"
    assert said(("delete", {}), order("b", "a"), order("a"), order("a", "a"), order("a", "b", "b"), order("a", "c"), ("prioritize_axes", {})) == [("unknown_tool", run), ("order_applied", run), *[("not_a_permutation", run)] * 5]
    assert said(split(), split(z=1), split(a=-1), split(a=None), split(a=-1, z=1), ("reallocate_budget", {}), split(a=3, b=2), split(a=3, b=3), ("charge", {"cents": 1}), split(a=3, b=2), split(a=1)) == [
        ("no_allocation", run), ("unknown_axis", run), ("bad_count", run), ("bad_count", run), ("unknown_axis", run), ("no_allocation", run), ("allocation_applied", run), ("over_budget", wait), ("charged", run), ("over_budget", wait), ("allocation_applied", run),
    ]
    rows = effects(spark, [order("b", "a"), split(a=9), ("charge", {"cents": 9}), ("charge", {"cents": 4}), split(b=1), *[order("a", "b")] * 9], ["a", "b"])
    assert rows[1].pending == {"a": 9} and rows[1].split is None and (rows[2].outcome, rows[2].spent, rows[3].spent) == ("over_budget", 0, 4)
    assert rows[4].pending is None and rows[4].split == {"b": 1} and rows[4].order == ["b", "a"] and rows[5].order == ["a", "b"]
    assert [r.outcome for r in rows[5:]] == ["order_applied"] * 7 + ["call_cap"] * 2 and rows[-1].calls == 12


def test_run_states(spark):
    events = [("plan", None, None), ("plan", None, None), ("cancel", None, None), ("approve", 1.0, "me"), ("halt", None, None), ("plan", None, None), ("approve", 0.0, "me"), ("approve", 2.0, " "), ("approve", None, "me"), ("approve", 2.5, "me"), ("plan", None, None), ("redo", None, None), (None, None, None), ("finalize", None, None), ("plan", None, None), ("cancel", None, None)]
    rows = [("r", i, *e) for i, e in enumerate(events)] + [("s", 0, "cancel", None, None), ("s", 1, "plan", None, None), (None, 0, "plan", None, None)]
    got = ledgers.run_states(spark.createDataFrame(rows, "run_id string, seq long, event string, amount double, by string")).collect()
    r = sorted((x for x in got if x.run_id == "r"), key=lambda x: x.seq)
    assert [x.accepted for x in r] == [True, True, False, False, True, False, False, False, False, True, True, False, False, True, False, False]
    assert [x.decision_id for x in r if x.decision_id] == ["0001-plan", "0002-plan", "0002-approve-2", "0003-plan"]
    assert (r[-1].status, r[-1].round, r[-1].version, r[-1].budget) == ("DONE", 3, 2, 2.5) and r[5].status == "AWAITING_APPROVAL"
    assert [(x.status, x.accepted) for x in sorted((x for x in got if x.run_id == "s"), key=lambda x: x.seq)] == [("CANCELLED", True), ("CANCELLED", False)]
    assert [(x.status, x.round) for x in got if x.run_id is None] == [("RUNNING", 1)]


def test_folds_carry_their_state_over_batches(spark):
    n = 30_000  # several batches of one key
    rows = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS run_id", "id AS ts", "id AS event_id", "CASE WHEN id % 1001 = 0 THEN NULL ELSE id % 7 END AS cents").repartition(5)
    got = {r.event_id: (r.approved, r.spent) for r in ledgers.budget_fold(rows, 12_000).collect()}
    spent = {}
    for i in range(n):
        key, cents = ("hot" if i % 3 == 0 else i % 50), (None if i % 1001 == 0 else i % 7)
        ok = None if cents is None else spent.get(key, 0) + cents <= 12_000
        spent[key] = spent.get(key, 0) + (cents if ok else 0)
        assert got[i] == (ok, spent[key])


def definition(limit, **more):
    return {"axes": [{"axis": n, "target_width": (AXES[n].hi - AXES[n].lo) / 32} for n, *_ in CASES], "budget_usd": limit, "cost_per_probe_usd": 0.01, **more}


def play(d, rows):
    edges = {n: e for n, e, *_ in CASES}
    while (step := cli.planned(d, rows))["action"] == "probe":
        for p in step["probes"]:
            bad = any(response(AXES[a], edges[a])(v) for a, v in p["set"].items())
            rows.append({"probe_id": p["probe_id"], "set": p["set"], "map50": 0.1 if bad else 0.6})
    return step


def test_rounds_until_done_and_halted(spark):
    """Round by round from the ledger alone: the published brackets with the published number of probes."""
    rows = []
    done = play(definition(0.4), rows)
    assert done["action"] == "done" and len(rows) == 33
    found = {f["axis"]: f for f in done["findings"]}
    for name, _, lower, upper in CASES:
        assert (found[name]["status"], found[name]["probes_used"]) == ("located", 8)
        assert (found[name]["lower"], found[name]["upper"]) == (pytest.approx(lower, abs=2e-3), pytest.approx(upper, abs=2e-3))
        assert found[name]["width"] == pytest.approx((AXES[name].hi - AXES[name].lo) / 32)
    rows = []
    halted = play(definition(0.08, probes_per_axis={"jpeg.quality": 3}), rows)
    assert halted["action"] == "halted" and len(rows) == 8 and halted["remaining"] == pytest.approx(0)


def test_all_runs_of_a_ledger_are_planned_at_once(spark):
    runs = spark.createDataFrame([(r, 1.0, 0.01, 0.0, 0.6, 5) for r in "abcdefg"], "run_id string, budget double, price double, prepaid double, share double, verify int")
    axes = spark.createDataFrame([(r, "jpeg.quality", 0, 1 / 32, 6 if r == "f" else None) for r in "abcdefg"], "run_id string, axis string, place int, width double, cap int")
    value = AXES["jpeg.quality"].from_severity
    fails = {"b": lambda s: True, "c": lambda s: False, "d": lambda s: 0.3 < s < 0.6, "e": lambda s: s > 0.4, "f": lambda s: s > 0.4, "g": lambda s: s < 0.1}
    rows = [(r, "baseline", None, None, 0.6) for r in "bcdefg"] + [(r, f"p{k}", "jpeg.quality", value(k / 4), 0.1 if f(k / 4) else 0.6) for r, f in fails.items() for k in range(5)]
    rows += [("f", "again", "jpeg.quality", value(0.375), 0.6), ("e", "twice", "jpeg.quality", value(0.375), 0.6), ("e", "twice", "jpeg.quality", value(0.375), 0.6)]
    plan = rounds.plan_rounds(runs, axes, spark.createDataFrame(rows, "run_id string, probe_id string, axis string, value double, map50 double"))
    found = {r.run_id: r.status for r in plan.findings.collect()}
    assert found == {"b": "fails_throughout", "c": "passes_throughout", "d": "not_monotone", "f": "capped", "g": "not_monotone"}
    asked = {r.run_id: (r.probe_id, r.command) for r in plan.probes.collect()}
    assert set(asked) == {"a", "e"} and asked["a"][0] == "baseline" and f"jpeg.quality={value(0.4375)}" in asked["e"][1]
    acts = {r.run_id: (r.action, r.requested) for r in plan.actions.collect()}
    assert acts["a"] == ("probe", 1) and acts["b"] == ("done", 0)


def test_approvals_proposals_and_guarded_probes(spark):
    waiting = budget.Run(0.08, 0.01, status="AWAITING_APPROVAL", pending={"fog.beta_per_m": 3})
    more = budget.approve(waiting, 0.4, "someone")
    assert (more.version, more.status, more.caps) == (2, "RUNNING", {"fog.beta_per_m": 3})
    with pytest.raises(budget.Refused):
        budget.approve(budget.Run(1, 0.01), 1, "someone")
    with pytest.raises(budget.Refused):
        budget.approve(waiting, 1, " ")
    assert budget.cancel(waiting).status == "CANCELLED"
    c = budget.Contract(0.03, 0.01)
    scored = []
    assert budget.guarded(c, 2, lambda i: scored.append(i) or i) == [0, 1]
    with pytest.raises(budget.Refused):
        budget.guarded(c, 2, scored.append)
    assert scored == [0, 1] and c.probes_remaining == 1
    axes = [n for n, *_ in CASES]
    told = effects(spark, [("prioritize_axes", {"order": axes[::-1]}), ("reallocate_budget", {"split": {axes[0]: 2}}), ("reallocate_budget", {"split": {axes[1]: 99}}), ("delete", {})], axes)
    after = budget.merged(definition(0.05), told[-1].asDict(), 0.002)
    assert [a["axis"] for a in after["axes"]] == axes[::-1] and after["probes_per_axis"] == {axes[0]: 2} and after["prepaid_usd"] == 0.002
    assert after["status"] == "AWAITING_APPROVAL" and after["pending_allocation"] == {axes[1]: 99}


def window(i, j):
    return 0.9 * math.exp(-0.7 * (((i / 16 - 0.3) / 0.25) ** 2 + ((j / 16 - 0.35) / 0.3) ** 2))


def diagonal(i, j):
    return 0.2 + 0.6 * (1 - (i / 16 + j / 16) / 2) ** 1.5


@pytest.mark.parametrize("surface,most", [(window, 30), (diagonal, 30), (lambda i, j: 0.9, 9), (lambda i, j: 0.1, 9)])
def test_level_sets(spark, surface, most):
    grid = spark.createDataFrame([(i, j) for j in range(17) for i in range(17)], "i int, j int")
    waves = []

    def respond(cells):
        rows = [(c.i, c.j, float(surface(c.i, c.j))) for c in cells.collect()]
        waves.append(len(rows))
        return spark.createDataFrame(rows, "i int, j int, value double")

    got = levelset.classified(grid, respond, 0.5).toPandas()
    want = np.array([[surface(i, j) < 0.5 for i in range(17)] for j in range(17)])
    for i, j, failed in got[["i", "j", "failed"]].itertuples(index=False):
        if failed != want[j, i]:  # a miss lies within a cell of the edge
            around = want[max(0, j - 1) : j + 2, max(0, i - 1) : i + 2]
            assert around.any() and not around.all()
    assert got.measured.sum() == sum(waves) <= most and got.sure.all() and max(waves[1:], default=0) <= 3
    assert levelset.classified(grid, respond, 0.5, most=4).where("measured").count() == 4
    with pytest.raises(ValueError):
        levelset.classified(grid, lambda cells: cells.selectExpr("i", "j", "CAST(NULL AS DOUBLE) AS value"), 0.5)


def test_units_and_ranges():
    assert [unit_of(x) for x in ("a_deg_s", "a_per_m", "a_deg", "a_m", "k1")] == ["deg/s", "1/m", "deg", "m", "1"]
    for axis in AXES.values():
        assert axis.from_severity(axis.to_severity(axis.midpoint)) == pytest.approx(axis.midpoint)
        assert axis.clamp(axis.hi + 1) == axis.hi and axis.clamp(axis.lo - 1) == axis.lo


def test_planner_needs_no_spark():
    code = "import sys; import edgefield.plans.search, edgefield.plans.budget; print(any(m.split('.')[0] in ('pyspark', 'numpy') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"


def test_command_line(spark, tmp_path, capsys):
    old = {"findings": [{"axis": "fog.beta_per_m", "status": "located", "lower": 0.06, "upper": 0.064}, {"axis": "jpeg.quality", "status": "located", "lower": 8.0, "upper": 11.0}]}
    worse = {"findings": [{"axis": "fog.beta_per_m", "status": "located", "lower": 0.03, "upper": 0.034}, {"axis": "jpeg.quality", "status": "fails_throughout", "lower": None, "upper": None}]}
    for name, d in (("old", old), ("new", worse)):
        (tmp_path / name).write_text(json.dumps(d))
    call = lambda *a: cli.main(["check", "--against", str(tmp_path / a[0]), "--current", str(tmp_path / a[1]), *a[2:]])
    assert call("old", "old") == 0 and call("old", "new") == 1
    assert len(cli.regressions(old, worse)) == 1 and len(cli.regressions(old, worse, strict=True)) == 2
    run = {"axes": [{"axis": "fog.beta_per_m", "target_width": 0.00375}], "budget_usd": 0.1, "cost_per_probe_usd": 0.01, "status": "AWAITING_APPROVAL"}
    (tmp_path / "run").write_text(json.dumps(run))
    (tmp_path / "ledger").write_text("")
    capsys.readouterr()
    assert cli.main(["plan", "--run", str(tmp_path / "run"), "--ledger", str(tmp_path / "ledger")]) == 0
    assert json.loads(capsys.readouterr().out)["probes"] == [{"probe_id": "baseline", "set": {}, "command": "edgefield probe --seed 20260906"}]
    told = json.loads(cli.run_report("road", 7, 10, {"jpeg.quality": (0.6, locate(AXES["jpeg.quality"], lambda vs: [v <= 9.4 for v in vs], 95 / 32, 5))}, {}))
    assert list(told) == ["run", "coverage", "findings"] and told["coverage"][0]["percent"] == "not measured"
    assert told["findings"][0]["witness"] == 5.0 and told["findings"][0]["reproduce"].startswith("edgefield probe --dataset road --set jpeg.quality=7.96")
    assert cli.main(["approve", "--run", str(tmp_path / "run"), "--amount", "1", "--by", "me"]) == 0
    assert json.loads(capsys.readouterr().out)["version"] == 2


def test_many_maps_are_classified_as_each_would_be_alone(spark):
    surfaces = {"w": window, "d": diagonal, "flat": lambda i, j: 0.9}
    rows = [(m, i, j, float(f(i, j))) for m, f in surfaces.items() for j in range(17) for i in range(17)]
    truth = spark.createDataFrame([*rows, ("one", 3, 4, 0.1), ("two", 0, 0, 0.9), ("two", 9, 0, 0.1)], "map string, i int, j int, value double")
    odd = truth.unionByName(truth.where("i = 3")).unionByName(spark.createDataFrame([(None, 1, 1, 0.0), ("w", None, 1, 0.0)], truth.schema))
    got = levelset.classified_maps(odd, lambda ask: truth.join(ask, ["map", "i", "j"], "left_semi"), 0.5).toPandas()
    assert got.groupby("map").size().to_dict() == {"w": 289, "d": 289, "flat": 289, "one": 1, "two": 2}
    for m in surfaces:
        grid = truth.where(truth["map"] == m)
        alone = levelset.classified(grid, lambda ask: grid.select("i", "j", "value").join(ask, ["i", "j"], "left_semi"), 0.5).toPandas()
        mine = got[got["map"] == m].drop(columns="map")
        assert sorted(mine.astype(str).itertuples(index=False, name=None)) == sorted(alone.astype(str).itertuples(index=False, name=None))
    small = {(r.map, r.i): r.failed for r in got[got["map"].isin(["one", "two"])].itertuples()}
    assert small == {("one", 3): True, ("two", 0): False, ("two", 9): True}
    assert levelset.classified_maps(truth.limit(0), lambda ask: truth, 0.5).count() == 0


def test_the_level_set_of_line_maps_lies_within_a_cell_of_the_whole_surface(spark):
    from edgefield.queries import running

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("the generated tables are not here")
    found = {(r.map, r.i, r.j): r for r in running.level_set(spark, sf).collect()}
    truth = {(r.map, r.i, r.j): r.value < 0.25 for r in running.line_surface(spark, sf).collect()}
    assert set(found) == set(truth) and sum(r.measured for r in found.values()) < 0.25 * len(found)
    wrong = [k for k, r in found.items() if r.failed != truth[k]]
    assert all(not found[k].measured for k in wrong) and len(wrong) < 0.02 * len(found)
    for m, i, j in wrong:
        assert len({truth.get((m, a, b)) for a in range(i - 2, i + 3) for b in range(j - 2, j + 3)} - {None}) == 2


def test_crossings_go_from_mild_to_severe(spark):
    from edgefield.plans import runs

    series = {"up": "PPFPF", "down": "FFPP", "pass": "PP", "fail": "FFF", "dip": "FPF", "one": "P"}
    rows = [(n, "fog", i / 8, v == "F", "clash") for n, word in series.items() for i, v in reversed(list(enumerate(word)))]
    odd = [("up", "fog", None, True, "x"), ("up", "fog", 0.05, None, "x"), ("none", "fog", None, None, "x"), (None, None, 0.0, False, "x"), (None, None, 1.0, True, "x")]
    got = {r.run_id: tuple(r)[2:] for r in runs.crossings(spark.createDataFrame(rows + odd, "run_id string, axis string, s double, failed boolean, status string")).collect()}
    assert got == {
        "up": ("crossed", 1 / 8, 2 / 8, 5), "down": ("recovers", None, None, 4), "pass": ("passes_throughout", None, None, 2), "fail": ("fails_throughout", None, None, 3),
        "dip": ("crossed", 1 / 8, 2 / 8, 3), "one": ("passes_throughout", None, None, 1), None: ("crossed", 0.0, 1.0, 2),
    }
