"""Probes: conditions scored on a set of frames, a whole wave as one Spark job."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgefield.functions.axes import AXES
from edgefield.operators import kernels as K
from edgefield.operators import matching as M
from edgefield.operators import measures as M2
from edgefield.plans.search import Outcome, locate
from edgefield.sources.store import ProbeStore

_DETECTED = "probe_id string, image_id long, label int, score double, x0 double, y0 double, x1 double, y1 double"


def wave(frames: DataFrame, conditions: dict[str, dict[str, float]], make: Callable[[], Any], seed: int, fixed: dict[str, float] | None = None) -> DataFrame:
    """Detections of every condition on every frame. conditions: probe_id to {"kernel.parameter": value}; {} is the clean set.
    fixed pins parameters of the kernels that a condition has, unless the condition says otherwise.

    All conditions are checked before anything runs. The frames' bytes are not multiplied: a task degrades its frame once
    for each condition, and only detections leave it."""
    pins = {probe: pinned(condition, fixed) for probe, condition in conditions.items()}
    for probe, condition in conditions.items():
        K.steps(condition, pins[probe])

    def run(batches):
        pipeline = make()
        for pdf in batches:
            rows = []
            for i, p, h, w in zip(pdf["image_id"], pdf["pixels"], pdf["height"], pdf["width"]):
                image = np.frombuffer(p, np.uint8).reshape(h, w, 3)
                for probe, condition in conditions.items():
                    seen = K.degraded(image, condition, seed, pins[probe]) if condition else image
                    rows += [(probe, i, *r) for r in pipeline.predict(seen, i)]
            yield pd.DataFrame(rows, columns=["probe_id", "image_id", "label", "score", "x0", "y0", "x1", "y1"])

    return frames.mapInPandas(run, _DETECTED)


def pinned(condition: dict[str, float], fixed: dict[str, float] | None) -> dict[str, float]:
    """The pins of the kernels that a condition has."""
    kernels = {name.partition(".")[0] for name in condition}
    return {k: v for k, v in (fixed or {}).items() if k.partition(".")[0] in kernels}


def record(frames: DataFrame, probe_id: str, condition: dict[str, float], seed: int, fixed: dict[str, float] | None = None) -> dict[str, Any]:
    """What a composite probe did: its steps with all parameters, and the measures of the first frame before and after."""
    first = frames.orderBy("image_id").limit(1)
    row = lambda df: next(iter(r.asDict() for r in M2.measure(df, ["image_id"]).collect()), None)
    pins = pinned(condition, fixed)
    return {"probe_id": probe_id, "steps": [{"kernel": k, "parameters": v} for k, v in K.steps(condition, pins)], "clean": row(first), "degraded": row(K.apply(first, condition, seed, pins) if condition else first)}


def coupled_map(frames: DataFrame, truths: DataFrame, x: tuple[str, list[float]], y: tuple[str, list[float]], make: Callable[[], Any], seed: int, couple: Callable[[float, float], dict[str, float]] = lambda a, b: {}) -> DataFrame:
    """map50 of every pair of values of two axes as one wave: i, j, x, y, map50. couple(x, y) pins further parameters, as where one
    exposure stands for the blur and for the light of a cell."""
    cells = [(i, j, a, b) for i, a in enumerate(x[1]) for j, b in enumerate(y[1])]
    conditions = {f"{i},{j}": {**couple(a, b), x[0]: a, y[0]: b} for i, j, a, b in cells}
    probes = frames.sparkSession.createDataFrame([(f"{i},{j}", i, j, a, b) for i, j, a, b in cells], "probe_id string, i int, j int, x double, y double")
    out = scored(wave(frames, conditions, make, seed), truths, probes.select("probe_id"))
    return probes.join(out.select("probe_id", "map50"), "probe_id").select("i", "j", "x", "y", "map50")


def scored(detections: DataFrame, truths: DataFrame, probes: DataFrame) -> DataFrame:
    """map50 and counts of each probe; labels that the set does not annotate are left out."""
    counts = M.truth_counts(truths)
    matches = M.greedy_match(M.scored_labels(detections, truths), truths)
    return M.map50(matches, counts, probes).join(M.counts_by_probe(matches, counts), "probe_id", "left")


class Memory(NamedTuple):
    """A store, and what of a probe's identity its condition and seed do not say: the set's name and size, and the pipeline's."""

    store: ProbeStore
    dataset: str
    frames: int
    pipeline: str


def recalled(memory: Memory, spark: SparkSession, conditions: dict[str, dict[str, float]], seed: int, fresh: Callable[[dict[str, dict[str, float]]], dict[str, float]]) -> dict[str, float]:
    """map50 of a wave's probes: what the store holds is not run again, and what is run is put there. A wave is a handful of probes."""
    kind = "probe_id string, dataset string, frames long, pipeline string, condition map<string,double>, seed long"
    row = lambda probe: (probe, memory.dataset, memory.frames, memory.pipeline, {k: float(v) for k, v in conditions[probe].items()}, seed)
    wanted = spark.createDataFrame([row(p) for p in conditions], kind)
    known = {r["probe_id"]: r["map50"] for r in memory.store.get(wanted, ["map50"]).where("hit").collect()}
    absent = {p: c for p, c in conditions.items() if p not in known}
    if absent:
        found = fresh(absent)
        memory.store.put(spark.createDataFrame([(*row(p)[1:], found[p]) for p in absent], kind.removeprefix("probe_id string, ") + ", map50 double"))
        known |= found
    return known


def search_axis(frames: DataFrame, truths: DataFrame, axis_name: str, make: Callable[[], Any], seed: int, steps: int = 33, verify: int = 5, share: float = 0.6, memory: Memory | None = None) -> tuple[float, Outcome]:
    """The clean set's map50, and where on an axis the pipeline falls below its share of that. A wave is one job, of the probes that
    no store holds."""
    spark, axis = frames.sparkSession, AXES[axis_name]

    def run(conditions: dict[str, dict[str, float]]) -> dict[str, float]:
        probes = spark.createDataFrame([(k,) for k in conditions], "probe_id string")
        return {r["probe_id"]: r["map50"] for r in scored(wave(frames, conditions, make, seed), truths, probes).collect()}

    def map50(conditions: dict[str, dict[str, float]]) -> dict[str, float]:
        return recalled(memory, spark, conditions, seed, run) if memory else run(conditions)

    clean = map50({"baseline": {}})["baseline"]

    def evaluate(values: list[float]) -> list[bool]:
        found = map50({f"{axis_name}@{v!r}": {axis_name: v} for v in values})
        return [found[f"{axis_name}@{v!r}"] < share * clean for v in values]

    return clean, locate(axis, evaluate, (axis.hi - axis.lo) / (steps - 1), verify)


class BrightBoxes:
    """A stand-in detector: regions much brighter than their frame. Its numbers say nothing of a neural one."""

    def __init__(self, cell: int = 16, over: float = 40.0):
        self.cell, self.over = cell, over

    def predict(self, image: np.ndarray, image_id: int) -> list[tuple]:
        g = image.astype(float).mean(axis=2)
        h, w = (n // self.cell * self.cell for n in g.shape)
        cells = g[:h, :w].reshape(h // self.cell, self.cell, w // self.cell, self.cell).mean(axis=(1, 3))
        above = cells - g.mean()
        return [
            (0, float(min(1.0, above[y, x] / 128)), float(x * self.cell), float(y * self.cell), float((x + 1) * self.cell), float((y + 1) * self.cell))
            for y, x in zip(*np.nonzero(above > self.over))
        ]


def missing(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Probes that a memory of earlier ones does not hold."""
    return wanted.join(store.select("store_key"), "store_key", "left_anti")


def remembered(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store, "store_key", "left").withColumn("hit", F.col("map50").isNotNull())
