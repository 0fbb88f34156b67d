"""Boxes of many small groups at once, in numpy: groups that come sorted are taken a batch at a time and compared pair by pair within.

A batch's pairs are written one after the other, however groups differ in size, and never more than a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PAIRS = 1 << 20  # compared at a time


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of about so many rows, of which each holds all rows of its keys. A larger group is a table by itself."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = group_starts(table, keys)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last)
            table = table.slice(last).combine_chunks()
        held, count = table.to_batches(), table.num_rows
        rows = max(rows, 2 * count) if not last else 50_000  # a group that has no end yet is not looked through again for each batch
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        values = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts its number so many times, and a count from 0 for each: rows of a ragged table."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def chunks(counts: np.ndarray, most: int = PAIRS) -> Iterator[slice]:
    """Stretches of counts whose sums are bounded, or a single one."""
    total = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes by rows (x0, y0, x1, y1); 0 where they only touch."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    area = lambda t: np.maximum(t[:, 2] - t[:, 0], 0) * np.maximum(t[:, 3] - t[:, 1], 0)
    both = np.where((w > 0) & (h > 0), w * h, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, both / (area(a) + area(b) - both), 0.0)
