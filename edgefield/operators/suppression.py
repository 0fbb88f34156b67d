"""Class-aware non-maximum suppression over the boxes of a probe, image and label in score order, many groups at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.functions.geometry import BOX
from edgefield.operators.buckets import chunks, group_starts, overlap, spans, whole
from edgefield.operators.folds import dealt

KEY = ["probe_id", "image_id", "label"]
_LARGE = 256  # boxes of a group that are not all compared with each other, but with those kept


def _kept_of_one(box: np.ndarray, threshold: float) -> np.ndarray:
    """One large group: each box in turn against those kept so far."""
    kept = np.zeros(len(box), bool)
    held, n = np.empty((64, 4)), 0
    for i in range(len(box)):
        if not n or not (overlap(held[:n], np.broadcast_to(box[i], (n, 4))) > threshold).any():
            kept[i] = True
            if n == len(held):
                held = np.concatenate([held, np.empty_like(held)])
            held[n], n = box[i], n + 1
    return kept


def _kept(table: pa.Table, threshold: float) -> np.ndarray:
    """Of whole groups in score order, the boxes that stay."""
    box = np.stack([table.column(c).to_numpy() for c in BOX], axis=1)
    start = group_starts(table, KEY)
    sizes = np.diff(np.r_[start, table.num_rows])
    group, rank = spans(sizes)
    kept = np.ones(table.num_rows, bool)
    for g in np.flatnonzero(sizes > _LARGE):
        kept[start[g] : start[g] + sizes[g]] = _kept_of_one(box[start[g] : start[g] + sizes[g]], threshold)
    earlier = np.where(sizes[group] > _LARGE, 0, rank)  # boxes that come before it
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for part in chunks(earlier):
        of, k = spans(earlier[part])
        b = of + part.start
        a = start[group[b]] + k
        over = overlap(box[a], box[b]) > threshold
        pairs.append((a[over], b[over]))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(rank[b], kind="stable")
        a, b = a[order], b[order]
        ends = np.flatnonzero(np.diff(rank[b])) + 1
        for mine in np.split(np.arange(len(b)), ends):  # those of rank 1 in every group, then of rank 2
            gone = b[mine][kept[a[mine]]]
            kept[gone] = False
    return kept


def suppress(detections: DataFrame, threshold: float = 0.45) -> DataFrame:
    """detections: probe_id, image_id, label, score, box. Adds kept; a box goes if one of its probe already kept overlaps it by more than threshold.

    A group's rows are in one task, by columns; of a large one each box is compared with those kept only."""
    rows = detections.select(*KEY, F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in BOX])
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)

    def run(batches):
        for table in whole(batches, KEY):
            yield from table.append_column("kept", pa.array(_kept(table, threshold))).to_batches()

    return dealt(rows, KEY).sortWithinPartitions(*KEY, F.desc("score"), *BOX).mapInArrow(run, f"{kinds}, kept boolean")
