"""Boundary search as a generator of waves: it yields the severities it wants to know and is sent whether each fails.

One definition serves the local search, where a wave is one Spark job over probes and frames, and the stateless planner, which
feeds it what a ledger already holds until it asks for something new. Nothing here needs Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence
from typing import NamedTuple

from edgefield.functions.axes import Axis

Waves = Generator[list[float], dict[float, bool], "Outcome"]


class Outcome(NamedTuple):
    status: str  # located, passes_throughout, fails_throughout, not_monotone, budget_exhausted
    lower: float | None
    upper: float | None
    probes: tuple[tuple[float, bool], ...]
    transitions: tuple[tuple[float, float], ...]

    @property
    def probes_used(self) -> int:
        return len(self.probes)


def same(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def transitions(probes: Sequence[tuple[float, bool]]) -> tuple[tuple[float, float], ...]:
    """Neighbouring values with different verdicts."""
    ordered = sorted(probes)
    return tuple((a, b) for (a, x), (b, y) in zip(ordered, ordered[1:]) if x != y)


def boundary(width: float, verify: int = 0, most: int = 64) -> Waves:
    """Search severity 0 to 1 for the change from pass to fail, to a bracket of at most width.

    verify > 1: first a uniform scan of that many points in one wave, whatever most says; several changes are reported, not
    refined. Otherwise the ends come first, the benign one by itself."""
    seen: dict[float, bool] = {}

    def ask(points: list[float]):
        new = [p for p in points if not any(same(p, q) for q in seen)]
        if new:
            seen.update((yield new))
        return [next(v for q, v in seen.items() if same(p, q)) for p in points]

    def end(status: str, lower=None, upper=None, changes=()) -> Outcome:
        return Outcome(status, lower, upper, tuple(seen.items()), tuple(changes))

    if verify > 1:
        step = 1.0 / (verify - 1)
        yield from ask([i * step for i in range(verify)])
        changes = transitions(list(seen.items()))
        if len(changes) > 1:
            return end("not_monotone", changes=changes)
        if not changes:
            return end("fails_throughout" if seen[0.0] else "passes_throughout")
        low, high = changes[0]
    else:
        if (yield from ask([0.0]))[0]:
            return end("fails_throughout")
        if not (yield from ask([1.0]))[0]:
            return end("passes_throughout")
        low, high = 0.0, 1.0
    while high - low > width:
        if len(seen) >= most:
            return end("budget_exhausted", low, high)
        middle = (low + high) / 2
        low, high = (low, middle) if (yield from ask([middle]))[0] else (middle, high)
    return end("located", low, high, transitions(list(seen.items())))


def _on_axis(axis: Axis, found: Outcome) -> Outcome:
    """Severities as axis values, brackets in ascending order."""
    value = axis.from_severity
    ends = sorted(value(s) for s in (found.lower, found.upper) if s is not None) or [None, None]
    return Outcome(found.status, ends[0], ends[1], tuple((value(s), f) for s, f in found.probes), tuple(tuple(sorted((value(a), value(b)))) for a, b in found.transitions))


def locate(axis: Axis, evaluate: Callable[[list[float]], Sequence[bool]], width: float, verify: int = 0, most: int = 64) -> Outcome:
    """Runs a search on an axis; evaluate gets a wave of axis values and tells which fail."""
    waves = boundary(abs(width / (axis.hi - axis.lo)), verify, most)
    try:
        wave = next(waves)
        while True:
            wave = waves.send(dict(zip(wave, map(bool, evaluate([axis.from_severity(s) for s in wave])))))
    except StopIteration as stop:
        return _on_axis(axis, stop.value)


class Step(NamedTuple):
    wanted: tuple[float, ...]  # axis values that are not known yet
    outcome: Outcome | None


def next_step(axis: Axis, observed: dict[float, bool], width: float, verify: int = 0, most: int = 64) -> Step:
    """What a search that knows observed (axis value: failed) asks next, or its outcome. Late or lost probes are asked again."""

    def known(value: float) -> bool | None:
        return next((f for v, f in observed.items() if same(v, value)), None)

    waves = boundary(abs(width / (axis.hi - axis.lo)), verify, most)
    try:
        wave = next(waves)
        while True:
            values = {s: axis.from_severity(s) for s in wave}
            missing = tuple(v for v in values.values() if known(v) is None)
            if missing:
                return Step(missing, None)
            wave = waves.send({s: known(v) for s, v in values.items()})
    except StopIteration as stop:
        return Step((), _on_axis(axis, stop.value))


def grid_crossing(axis: Axis, probes: Sequence[tuple[float, bool]]) -> Outcome:
    """The grid strategy: verdicts of a whole sweep, benign to severe; one change locates, several do not, none is no_transition."""
    ordered = sorted((axis.to_severity(v), f) for v, f in probes)
    changes = transitions(ordered)
    status = "no_transition" if not changes else "located" if len(changes) == 1 else "not_monotone"
    low, high = changes[0] if len(changes) == 1 else (None, None)
    return _on_axis(axis, Outcome(status, low, high, tuple(ordered), changes))
