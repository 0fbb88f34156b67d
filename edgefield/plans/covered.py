"""What of each searched axis the validation set itself covers: a measured sweep of all its frames, read back as axis values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from edgefield.functions.axes import AXES
from edgefield.operators import coverage
from edgefield.operators import kernels as K
from edgefield.operators import measures
from edgefield.sources.shared import written

#: The measure by which a frame shows where on an axis it lies. Axes of geometry have none, and no coverage.
SHOWN_BY = {
    "fog.beta_per_m": "rms_contrast",
    "motion_blur.exposure_ms": "laplacian_var",
    "motion_blur.angular_velocity_deg_s": "laplacian_var",
    "defocus.subject_distance_m": "laplacian_var",
    "defocus.aperture_f_number": "laplacian_var",
    "low_light.illuminance_lux": "snr_db",
    "jpeg.quality": "blockiness",
}


def measured(frames: DataFrame, probed: dict[str, list[float]], seed: int) -> DataFrame:
    """frames: image_id, height, width, pixels. A row for each frame: for each axis that a measure shows, a column of its name with the measure of the
    frame as it is, and a column axis|value with that at every probed value.

    One pass: a task degrades its frames, those of one size together, once for each condition, and only numbers leave it; frames without
    colour go as one plane. Nothing is inferred. Values are checked before anything runs; frames without pixels are left out. Frames are
    dealt evenly first: degrading one takes far longer than sending it."""
    wanted = list(dict.fromkeys((axis, float(v) + 0.0) for axis, values in probed.items() if axis in SHOWN_BY for v in values))
    for axis, value in wanted:
        K.steps({axis: value})
    asked = [(axis, None) for axis in sorted({axis for axis, _ in wanted})] + wanted
    if not asked:
        return frames.select(F.lit(None).cast("double").alias("none")).limit(0)

    def seen(stack, planes, axis, v):
        grey = planes if planes is None or v is None else K.degraded_levels(planes, {axis: v}, seed)
        if grey is None:
            grey = measures.greys(stack if v is None else K.degraded_stack(stack, {axis: v}, seed))
        return measures.MEASURES[SHOWN_BY[axis]](grey.astype(np.float64))

    names = [axis if v is None else f"{axis}|{v!r}" for axis, v in asked]

    def run(batches):
        for pdf in batches:
            for _, stack in K.stacks(pdf):
                planes = K.levels(stack)
                yield pd.DataFrame({name: seen(stack, planes, axis, v) for name, (axis, v) in zip(names, asked)})

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.where("pixels IS NOT NULL").repartition(n, "image_id").select("height", "width", "pixels")
    return dealt.mapInPandas(run, StructType([StructField(name, DoubleType()) for name in names]))


def _told(spark, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A handful of rows that the driver holds, without a Python worker to make them."""
    kinds = {"string": pa.string(), "double": pa.float64()}
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], kinds[k]) for i, (c, k) in enumerate(columns.items())}), ", ".join(f"{c} {k}" for c, k in columns.items()))


def covered(measurements: DataFrame) -> DataFrame:
    """axis, lo, hi, covered_lo, covered_hi, fraction and uncovered of every axis measured.

    An axis whose frames all measure beyond what the sweep reached is covered nowhere. Measurements are written once: their extremes,
    their medians and what bounds these would each degrade all frames anew."""
    spark = measurements.sparkSession
    names = [c for c in measurements.columns if c.partition("|")[0] in SHOWN_BY]
    of = coverage.column_figures(written(measurements, "measurements"), names) if names else {}
    axes = _told(spark, {"axis": "string", "lo": "double", "hi": "double"}, [(a.name, a.lo, a.hi) for a in AXES.values()])
    sweep = [(*name.split("|"), median) for name, (_, _, median) in of.items() if "|" in name]
    native = [(name, end) for name, (least, most, _) in of.items() if "|" not in name for end in (least, most)]
    sweep = _told(spark, {"axis": "string", "value": "double", "metric": "double"}, [(axis, float(v), m) for axis, v, m in sweep])
    return coverage.axis_coverage(axes, sweep, _told(spark, {"axis": "string", "metric": "double"}, native))


def described(frames: DataFrame, probed: dict[str, list[float]], seed: int) -> dict[str, dict]:
    """The coverage of a run's axes for its report, by axis. A run has a handful of axes; the measurements are summed up where they are."""
    out = {}
    for r in covered(measured(frames, probed, seed)).collect():
        unit = AXES[r["axis"]].unit
        regions = [{"from": u["from"], "to": u["to"], "width": u["to"] - u["from"], "unit": unit} for u in r["uncovered"]]
        out[r["axis"]] = {"measure": SHOWN_BY[r["axis"]], "covered_lower": r["covered_lo"], "covered_upper": r["covered_hi"], "percent": round(100 * r["fraction"], 2), "uncovered": regions}
    return out
