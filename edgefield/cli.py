"""Command line: search an axis, score a condition, plan a round, check a report against an older one, approve, cancel."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from edgefield.functions.axes import AXES
from edgefield.plans import budget
from edgefield.plans.report import NOT_MEASURED


def pairs(items: list[str]) -> dict[str, float]:
    out = {}
    for item in items:
        name, sep, value = item.partition("=")
        if not sep:
            raise SystemExit(f"expected NAME=VALUE, not {item!r}")
        out[name] = float(value)
    return out


def regressions(old: dict, new: dict, strict: bool = False) -> list[str]:
    """Axes whose boundary moved to a milder condition. strict also names those that now fail everywhere."""
    before = {f["axis"]: f for f in old["findings"]}

    def severity(f: dict) -> float:
        axis = AXES[f["axis"]]
        return axis.to_severity(f["lower"] if axis.severe_end == "hi" else f["upper"])

    out = []
    for f in new["findings"]:
        was = before.get(f["axis"])
        if was is None:
            continue
        if f.get("lower") is None:
            if strict and f["status"] == "fails_throughout" and was["status"] != "fails_throughout":
                out.append(f"{f['axis']}: fails throughout")
        elif was.get("lower") is None:
            if was["status"] == "passes_throughout":
                out.append(f"{f['axis']}: a boundary appeared")
        elif severity(f) < severity(was) - 1e-12:
            out.append(f"{f['axis']}: fails from a milder condition")
    return out


def planned(definition: dict, ledger: list[dict]) -> dict:
    """The next round of one run: what to do, with which probes (at most a wave) and what is known of its axes."""
    from edgefield.plans import rounds

    plan = rounds.plan_rounds(*rounds.tables(_session(), "run", definition, ledger))
    rows = lambda df, *order: [{k: v for k, v in r.asDict().items() if k != "run_id"} for r in df.orderBy(*order).collect()]
    probes = [{"probe_id": p["probe_id"], "set": {p["axis"]: p["value"]} if p["axis"] else {}, "command": p["command"]} for p in rows(plan.probes, "axis", "value")]
    return {**rows(plan.actions, "run_id")[0], "probes": probes, "findings": rows(plan.findings, "axis")}


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("edgefield").getOrCreate()


def run_report(dataset: str, seed: int, n_frames: int, found: dict, covered: dict[str, dict]) -> str:
    """found: axis to (clean map50, outcome); covered: axis to what the set itself covers of it, by plans.covered. That comes before what
    was found, with the regions that no frame reaches; an axis that no measure shows says "not measured". Each finding has a witness (the
    failing probe of least axis value), its bracket's width and middle, and the command that repeats its milder end."""
    coverage, findings = [], []
    for name, (clean, o) in found.items():
        axis, values = AXES[name], [v for v, _ in o.probes]
        coverage.append({"axis": name, "unit": axis.unit, "probed": sorted(values), **covered.get(name, {"percent": NOT_MEASURED})})
        failing = [v for v, bad in o.probes if bad]
        located = o.lower is not None
        at = o.upper if axis.severe_end == "hi" else o.lower
        findings.append({
            "axis": name, "unit": axis.unit, "baseline_map50": clean, "status": o.status, "lower": o.lower, "upper": o.upper, "width": o.upper - o.lower if located else None, "middle": (o.lower + o.upper) / 2 if located else None,
            "probes_used": o.probes_used, "witness": min(failing) if failing else None, "reproduce": f"edgefield probe --dataset {dataset} --set {name}={at!r} --seed {seed}" if located else None,
        })
    return json.dumps({"run": {"dataset": dataset, "seed": seed, "n_frames": n_frames}, "coverage": coverage, "findings": findings}, indent=2)


def _set(spark, folder: str, labels: list[str], limit: int):
    """Frames with pixels and truths of a folder with manifest.json and raw frames (.bgr, square)."""
    from pyspark.sql import functions as F

    from edgefield.sources.selection import manifest, with_pixels

    frames, truths = manifest(spark, f"{folder}/manifest.json", labels, limit)
    found = with_pixels(frames, f"{folder}/*.bgr")
    side = F.sqrt(F.octet_length("content") / 3).cast("int")
    return found.select("image_id", side.alias("height"), side.alias("width"), F.col("content").alias("pixels")), truths


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="edgefield")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("run", "probe"):
        p = verbs.add_parser(verb)
        p.add_argument("--dataset", required=True)
        p.add_argument("--labels", nargs="+", default=["object"])
        p.add_argument("--limit", type=int, default=0)
        p.add_argument("--seed", type=int, default=20260906)
        p.add_argument("--axis" if verb == "run" else "--set", nargs="+", required=True, choices=sorted(AXES) if verb == "run" else None)
    p = verbs.add_parser("plan")
    p.add_argument("--run", required=True)
    p.add_argument("--ledger", required=True)
    p = verbs.add_parser("check")
    p.add_argument("--against", required=True)
    p.add_argument("--current", required=True)
    p.add_argument("--strict", action="store_true")
    p = verbs.add_parser("approve")
    p.add_argument("--run", required=True)
    p.add_argument("--amount", type=float, required=True)
    p.add_argument("--by", required=True)
    p = verbs.add_parser("cancel")
    p.add_argument("--run", required=True)
    args = top.parse_args(argv)
    read = lambda path: json.loads(Path(path).read_text())

    if args.verb == "check":
        found = regressions(read(args.against), read(args.current), args.strict)
        print("\n".join(found) or "no boundary moved to a milder condition")
        return int(bool(found))
    if args.verb in ("plan", "approve", "cancel"):
        d = read(args.run)
        run = budget.Run(d["budget_usd"], d["cost_per_probe_usd"], d.get("probes_per_axis"), d.get("status", "RUNNING"), d.get("version", 1), d.get("pending_allocation"))
        if args.verb == "plan":
            ledger = [json.loads(x) for x in Path(args.ledger).read_text().splitlines() if x.strip()]
            print(json.dumps(planned(d, ledger), sort_keys=True))
            return 0
        after = budget.approve(run, args.amount, args.by) if args.verb == "approve" else budget.cancel(run)
        d |= {"budget_usd": after.budget, "version": after.version, "status": after.status, "probes_per_axis": after.caps, "pending_allocation": after.pending}
        print(json.dumps(d, sort_keys=True))
        return 0

    from edgefield.plans import probe
    from edgefield.plans.covered import described

    spark = _session()
    frames, truths = _set(spark, args.dataset, args.labels, args.limit)
    if args.verb == "probe":
        condition = pairs(args.set)
        probes = spark.createDataFrame([("probe",)], "probe_id string")
        for row in probe.scored(probe.wave(frames, {"probe": condition}, probe.BrightBoxes, args.seed), truths, probes).collect():
            print(json.dumps(row.asDict()))
        return 0
    found = {axis: probe.search_axis(frames, truths, axis, probe.BrightBoxes, args.seed) for axis in args.axis}
    probed = {axis: [v for v, _ in o.probes] for axis, (_, o) in found.items()}
    print(run_report(args.dataset, args.seed, frames.count(), found, described(frames, probed, args.seed)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
