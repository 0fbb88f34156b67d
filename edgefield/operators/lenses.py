"""How far undistorting and distorting again moves a grid of pixels, for many lenses at a time in numpy.

A lens is one row, and its grid never leaves the task: rows do not grow by the grid. They are dealt evenly first, since a small file
holds many lenses and a lens takes far longer to follow than to send."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from edgefield.functions.geometry import lens_terms

LENS = ("w", "h", "k1", "k2", "p1", "p2")


def round_trips(w: np.ndarray, h: np.ndarray, lens: tuple[np.ndarray, ...], steps: int = 9, rounds: int = 20, focal: float = 0.9) -> np.ndarray:
    """As `geometry.round_trip_px`, the largest over steps x steps pixels from corner to corner, for each lens; none of a lens with a null."""
    w, h, *lens = (np.asarray(c, np.float64)[:, None] for c in (w, h, *lens))
    i = np.arange(steps * steps)
    px, py = i % steps / (steps - 1.0) * (w - 1), i // steps / (steps - 1.0) * (h - 1)
    f, cx, cy = focal * np.maximum(w, h), (w - 1) / 2.0, (h - 1) / 2.0
    x, y = (px - cx) / f, (py - cy) / f
    ux, uy = x, y
    for _ in range(rounds):
        radial, dx, dy = lens_terms(ux, uy, lens)
        ux, uy = (x - dx) / radial, (y - dy) / radial
    radial, dx, dy = lens_terms(ux, uy, lens)
    return np.maximum(np.abs((ux * radial + dx) * f + cx - px), np.abs((uy * radial + dy) * f + cy - py)).max(1)


def worst_round_trip(lenses: DataFrame, key: str, steps: int = 9, at_once: int = 512) -> DataFrame:
    """lenses: key, w, h, k1, k2, p1 and p2. For each row key and error_px; so many lenses are held as grids at a time."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), at_once):
                part = pdf.iloc[lo : lo + at_once]
                with np.errstate(all="ignore"):  # a lens may fold its corners over without end
                    yield pd.DataFrame({key: part[key], "error_px": round_trips(part["w"], part["h"], tuple(part[c] for c in LENS[2:]), steps)})

    n = int(lenses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lenses.select(key, *LENS).repartition(n, key)
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, error_px double")
