"""Detector heads decoded to boxes with array functions: grid offsets with log sizes, and expected distances over bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_box(raw: Column, cell_x: Column, cell_y: Column, stride: Column, scale: Column) -> Column:
    """raw: centre offsets and log sizes, in strides. A corner box in the original image, undoing the letterbox's scale."""
    cx, cy = (F.get(raw, F.lit(i)) + c for i, c in ((0, cell_x), (1, cell_y)))
    w, h = (F.exp(F.get(raw, F.lit(i))) for i in (2, 3))
    at = lambda c, size, sign: (c + sign * size / 2) * stride / scale
    return F.struct(at(cx, w, -1).alias("x0"), at(cy, h, -1).alias("y0"), at(cx, w, 1).alias("x1"), at(cy, h, 1).alias("y1"))


def expected(logits: Column) -> Column:
    """The mean bin under a softmax, shifted by the largest logit so that nothing overflows."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(weights, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v) / total


def distance_box(sides: list[Column], cell_x: Column, cell_y: Column, stride: Column, size: float, scale: Column) -> Column:
    """Logits of the left, top, right and bottom distances from a cell's centre; corners are clipped to the network's input."""
    cx, cy = (c * stride + 0.5 * (stride - 1) for c in (cell_x, cell_y))
    left, top, right, bottom = (expected(s) * stride for s in sides)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(size), c)) / scale
    return F.struct(clip(cx - left).alias("x0"), clip(cy - top).alias("y0"), clip(cx + right).alias("x1"), clip(cy + bottom).alias("y1"))


def best_class(scores: Column, objectness: Column | None = None) -> Column:
    """The first class with the largest score, and the confidence."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("label"), (top if objectness is None else top * objectness).alias("score"))
