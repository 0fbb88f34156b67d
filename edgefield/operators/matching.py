"""Claims of truths by detections, average precision, and mean average precision per probe.

Claims only compete within one image and label, so that is the unit of work: truths and detections of a bucket, of all probes, come
to one task, and many buckets at a time are matched in numpy: overlaps pair by pair, then the first detection of
every bucket claims, then the second of every bucket. Average precision looks at detections in the order of their images, a stretch
at a time, and keeps one row for each probe, label and score of a stretch: how many there are, and a bit for each that tells hits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgefield.functions.geometry import BOX, iou
from edgefield.operators.buckets import chunks, group_starts, overlap, spans, whole
from edgefield.sources.shared import written

IOU = 0.5
KEY = ["image_id", "label"]


def _box(of: Column | None = None) -> tuple[Column, ...]:
    return tuple(F.col(c) if of is None else of[c] for c in BOX)


_MATCHED = "probe_id {probe}, image_id {image}, label {label}, score double, x0 double, y0 double, x1 double, y1 double, matched boolean, gt_idx int, best_iou double"


def _boxes(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in BOX], axis=1)


def _codes(table: pa.Table, column: str) -> np.ndarray:
    """Equal values, equal numbers from 0."""
    values = table.column(column).combine_chunks()
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(buckets: pa.Table) -> pa.Table:
    """Rows of whole buckets: truths first, then detections by probe, falling score and box. Boxes are only compared where scores tie."""
    buckets = buckets.combine_chunks()
    is_truth = buckets.column("is_truth").to_numpy(zero_copy_only=False)
    probe = np.where(is_truth, 0, _codes(buckets, "probe_id") + 1)
    start = group_starts(buckets, KEY)
    bucket = np.repeat(np.arange(len(start)), np.diff(np.r_[start, buckets.num_rows]))
    score = buckets.column("score")
    lacks, score = score.is_null().to_numpy(zero_copy_only=False), score.to_numpy()
    tier = np.where(lacks, 2, np.where(np.isnan(score), 0, 1))  # NaN before all scores, null after them
    key = (bucket * (int(probe.max(initial=0)) + 1) + probe) * 3 + tier
    falling = np.where(tier == 1, -score, 0.0)
    order = np.lexsort((falling, key))
    tie = (np.diff(key[order]) == 0) & (np.diff(falling[order]) == 0) & ~is_truth[order[1:]]
    tied = np.flatnonzero(np.r_[tie, False] | np.r_[False, tie])
    if len(tied):
        few = order[tied]
        box = _boxes(buckets)[few]
        order[tied] = few[np.lexsort((*box.T[::-1], falling[few], key[few]))]
    return buckets.take(pa.array(order))


def _claimed(buckets: pa.Table, threshold: float) -> pa.Table:
    """Rows of whole buckets: the detections with what each claims, by bucket, probe and rank."""
    buckets = _ranked(buckets)
    start = group_starts(buckets, KEY)
    bucket = np.cumsum(np.bincount(start, minlength=buckets.num_rows)) - 1
    is_truth = buckets.column("is_truth").to_numpy(zero_copy_only=False)
    truths, found = buckets.filter(pa.array(is_truth)), buckets.filter(pa.array(~is_truth))
    box, truth_box, n = _boxes(found), _boxes(truths), found.num_rows
    number = truths.column("gt_idx").to_numpy()
    per_bucket = np.bincount(bucket[is_truth], minlength=len(start))
    first_truth = np.cumsum(per_bucket) - per_bucket
    here = bucket[~is_truth]
    best = np.zeros(n)
    got = np.full(n, -1)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in chunks(per_bucket[here]):
        counts = per_bucket[here[part]]
        of, k = spans(counts)
        d, t = of + part.start, first_truth[here[part]][of] + k
        o = overlap(box[d], truth_box[t])
        some = np.flatnonzero(counts)
        if len(some):
            best[part.start + some] = np.maximum(np.maximum.reduceat(o, (np.cumsum(counts) - counts)[some]), 0.0)
        near = o >= threshold
        pairs.append((d[near], t[near], o[near]))
    if pairs and sum(len(d) for d, _, _ in pairs):
        d, t, o = (np.concatenate(x) for x in zip(*pairs))
        order = np.lexsort((number[t], -o, d))
        d, t = d[order], t[order]
        group = np.cumsum(np.bincount(group_starts(found, [*KEY, "probe_id"]), minlength=n)) - 1  # detections that compete: of one probe and bucket
        # a truth is claimed once by each probe
        truth_of = np.unique(group[d] * np.int64(truths.num_rows + 1) + t, return_inverse=True)[1]
        taken = np.zeros(truth_of.max() + 1, bool)
        claims = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])  # the first pair of each detection that has any
        member = group[d[claims]]
        turn = spans(np.bincount(member)[np.unique(member)])[1]  # its turn among those of its group: they come by rank
        by_turn = np.argsort(turn, kind="stable")
        sizes = np.diff(np.r_[claims, len(d)])
        for mine in np.split(by_turn, np.cumsum(np.bincount(turn))[:-1]):
            of, k = spans(sizes[mine])
            pair = claims[mine][of] + k
            free = pair[~taken[truth_of[pair]]]
            if len(free):
                first = free[np.r_[True, d[free][1:] != d[free][:-1]]]
                taken[truth_of[first]] = True
                got[d[first]] = t[first]
    hit = got >= 0
    gt = pa.array(np.where(hit, number[np.maximum(got, 0)] if len(number) else 0, 0).astype(np.int32), mask=~hit)
    keep = found.select(["probe_id", *KEY, "score", *BOX])
    return keep.append_column("matched", pa.array(hit)).append_column("gt_idx", gt).append_column("best_iou", pa.array(best))


def greedy_match(detections: DataFrame, truths: DataFrame, threshold: float = IOU) -> DataFrame:
    """detections: probe_id, image_id, label, score, box. Adds matched, gt_idx (null if unmatched) and best_iou.

    In order of falling score, then box, a detection claims the truth it overlaps most of those still free; the first truth
    wins ties. best_iou also counts truths that others claimed. Null keys match no truth. A bucket's rows are in one task, by
    columns, and are put in order there; its pairs are compared a bounded number at a time, and only those at or above the threshold are kept."""
    kinds = dict(detections.dtypes)
    probe, image, label = (kinds[c] for c in ("probe_id", *KEY))
    none = lambda kind: F.lit(None).cast(kind)
    box = [F.col(c).cast("double").alias(c) for c in BOX]
    keys = [F.col("image_id").cast(image).alias("image_id"), F.col("label").cast(label).alias("label")]
    t = truths.where("image_id IS NOT NULL AND label IS NOT NULL").select(*keys, F.lit(True).alias("is_truth"), none(probe).alias("probe_id"), F.col("gt_idx").cast("int").alias("gt_idx"), none("double").alias("score"), *box)
    d = detections.select(*keys, F.lit(False).alias("is_truth"), "probe_id", none("int").alias("gt_idx"), F.col("score").cast("double").alias("score"), *box)
    return claims(t.unionByName(d).repartition(*KEY).sortWithinPartitions(*KEY), threshold)


def _told(rows: DataFrame, threshold: float, tell, columns: str) -> DataFrame:
    """rows: image_id, label, is_truth, probe_id, gt_idx, score and box, those of an image and label together. What tell makes of the
    tables of claims, which hold whole images and labels in the order of the rows."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for table in tell(_claimed(table, threshold) for table in whole(batches, KEY)):
            yield from table.to_batches()

    return rows.mapInArrow(run, columns.format(probe=kinds["probe_id"], image=kinds["image_id"], label=kinds["label"]))


def claims(rows: DataFrame, threshold: float = IOU) -> DataFrame:
    """greedy_match of rows that are dealt already: truths and detections in one table, those of an image and label together in a task."""
    return _told(rows, threshold, lambda tables: tables, _MATCHED)


def truth_counts(truths: DataFrame) -> DataFrame:
    return truths.groupBy("label").agg(F.count("*").alias("n_gt"))


_PIECES = "probe_id {probe}, label {label}, falling double, place long, n long, h long, bits binary"
_STRETCH = 500_000  # rows at a time


def _pieces(tables):
    """Tables of probe_id, label, score and matched whose rows come in the order that breaks ties of scores, over all tasks: a row for each
    probe, label and score of a stretch of them, with its place, its rows, its hits, and a bit for each row."""
    part = TaskContext.get().partitionId()

    def stretches():
        held, count = [], 0
        for table in tables:
            held.append(table.select(["probe_id", "label", "score", "matched"]))
            count += table.num_rows
            if count >= _STRETCH:
                yield pa.concat_tables(held).combine_chunks()
                held, count = [], 0
        if count:
            yield pa.concat_tables(held).combine_chunks()

    for k, rows in enumerate(stretches()):
        rows = rows.set_column(2, "score", pc.add(rows.column("score"), 0.0))  # one zero
        key = np.zeros(rows.num_rows, np.int64)
        for column in ("probe_id", "label", "score"):
            codes = _codes(rows, column)
            key = key * (int(codes.max()) + 1) + codes
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        n = np.diff(np.r_[start, len(order)])
        matched = rows.column("matched").to_numpy()[order]
        size = (n + 7) // 8
        ends = np.r_[0, np.cumsum(size)]
        bits = np.zeros(8 * ends[-1], np.uint8)
        of, at = spans(n)
        bits[8 * ends[of] + at] = matched
        bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.packbits(bits))])
        first = rows.take(pa.array(order[start]))
        told = {c: first.column(c) for c in ("probe_id", "label")}
        falling = pc.negate(first.column("score"))
        place = pa.array(np.full(len(n), (part << 32) + k, np.int64))
        yield pa.table({**told, "falling": falling, "place": place, "n": pa.array(n), "h": pa.array(np.add.reduceat(matched.astype(np.int64), start)), "bits": bits})


def scored(rows: DataFrame, threshold: float = IOU) -> DataFrame:
    """Claims of rows as claims() takes them, in ranges of image_id besides, as the pieces that average precision and counts are made of:
    no detection leaves its task."""
    return written(_told(rows, threshold, _pieces, _PIECES), "pieces")


def _precisions(bits: pd.Series, n0: pd.Series, h0: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The piece of every hit, and the precision there; n0 and h0 are the rows and hits before a piece. Every piece has a hit."""
    size = bits.map(len).to_numpy()
    hit = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)))
    ends = 8 * np.cumsum(size)
    piece = np.searchsorted(ends, hit, side="right")
    hits = np.bincount(piece, minlength=len(size))
    row, nth = hit - (ends - 8 * size)[piece] + 1, spans(hits)[1] + 1
    return piece, (h0.to_numpy()[piece] + nth) / (n0.to_numpy()[piece] + row)


def _top(bits: pd.Series, n0: pd.Series, h0: pd.Series) -> pd.Series:
    """The largest precision of a piece."""
    piece, precision = _precisions(bits, n0, h0)
    return pd.Series(np.maximum.reduceat(precision, np.flatnonzero(np.r_[True, np.diff(piece) != 0])))


def _area(bits: pd.Series, n0: pd.Series, h0: pd.Series, later: pd.Series) -> pd.Series:
    """The sum over the hits of a piece of the largest precision from there on; later is the largest after the piece."""
    piece, precision = _precisions(bits, n0, h0)
    levels, level = np.unique(precision, return_inverse=True)
    run = np.maximum.accumulate(((piece[-1] - piece) * np.int64(len(levels)) + level)[::-1])[::-1] % len(levels)  # within each piece, from the right
    best = np.maximum(levels[run], later.to_numpy()[piece])
    return pd.Series(np.add.reduceat(best, np.flatnonzero(np.r_[True, np.diff(piece) != 0])))


def average_precision(matches: DataFrame, counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """ap by probe and label, for labels that have truths and detections. counts: label, n_gt. Ties of scores go by image_id, then box."""
    by = ["image_id", *BOX, F.desc("matched"), "tie"]
    rows = matches.select("probe_id", "label", "score", "image_id", *BOX, "matched", F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange(_wide(matches, ranges), *by).sortWithinPartitions(*by).select("probe_id", "label", F.col("score").cast("double").alias("score"), "matched")
    kinds = dict(rows.dtypes)

    def run(batches):
        for table in _pieces(pa.Table.from_batches([b]) for b in batches if b.num_rows):
            yield from table.to_batches()

    return piecewise_precision(written(rows.mapInArrow(run, _PIECES.format(probe=kinds["probe_id"], label=kinds["label"])), "pieces"), counts, ranges)


def _wide(df: DataFrame, ranges: int | None) -> int:
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wide if ranges is None else max(1, min(ranges, 16 * wide))


def piecewise_precision(pieces: DataFrame, counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """average_precision of pieces that are written.

    Precision is made monotone from the right; only hits add recall, so AP is the sum over hits of that precision by n_gt, and precision
    is largest at hits. Pieces are sorted in ranges of (probe, label, score, place) that any probe, label or score may fill many of.
    What stands before a range (hits, rows) and after it (the largest precision) comes from one row for each range and group."""
    group = ["probe_id", "label"]
    by = [*group, "falling", "place"]
    pieces = written(pieces.repartitionByRange(_wide(pieces, ranges), *by).withColumn("part", F.spark_partition_id()), "ranges")
    none = F.lit(0)
    top, sum_of = F.pandas_udf(_top, "double"), F.pandas_udf(_area, "double")
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy(*group, "part").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))  # a row for each range and group that meet
    before = sums.select(*group, "part", F.coalesce(F.sum("n").over(ahead), none).alias("n0"), F.coalesce(F.sum("h").over(ahead), none).alias("h0"))
    within = Window.partitionBy(*group, "part").orderBy("falling", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(F.broadcast(before), [*group, "part"])
    placed = placed.withColumns({c: F.col(c) + F.coalesce(F.sum(of).over(within), none) for c, of in (("n0", "n"), ("h0", "h"))}).where("h > 0")
    placed = written(placed.withColumn("top", top("bits", "n0", "h0")), "tops")
    after = Window.partitionBy(*group).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    most = placed.groupBy(*group, "part").agg(F.max("top").alias("most")).select(*group, "part", F.max("most").over(after).alias("most"))
    after = Window.partitionBy(*group, "part").orderBy(F.desc("falling"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.greatest(F.coalesce(F.max("top").over(after), F.lit(0.0)), F.coalesce("most", F.lit(0.0)))
    area = placed.join(F.broadcast(most), [*group, "part"]).withColumn("later", later).withColumn("area", sum_of("bits", "n0", "h0", "later"))
    total = sums.select(*group).distinct().join(area.groupBy(*group).agg(F.sum("area").alias("area")), group, "left")
    return total.join(F.broadcast(counts), "label").select(*group, (F.coalesce("area", F.lit(0.0)) / F.col("n_gt")).alias("ap"), "n_gt")  # one row for each label


def map50(matches: DataFrame, counts: DataFrame, probes: DataFrame) -> DataFrame:
    """map50 of every probe: the mean over labels with truths; a label without detections counts 0, no truths at all give 0."""
    return _map50(average_precision(matches, counts), counts, probes)


def piecewise_map50(pieces: DataFrame, counts: DataFrame, probes: DataFrame) -> DataFrame:
    return _map50(piecewise_precision(pieces, counts), counts, probes)


def _map50(ap: DataFrame, counts: DataFrame, probes: DataFrame) -> DataFrame:
    every = probes.select("probe_id").crossJoin(F.broadcast(counts))
    out = every.join(ap.select("probe_id", "label", "ap"), ["probe_id", "label"], "left").groupBy("probe_id").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("map50"))
    return probes.select("probe_id").join(out, "probe_id", "left").select("probe_id", F.coalesce("map50", F.lit(0.0)).alias("map50"))


def counts_by_probe(matches: DataFrame, counts: DataFrame) -> DataFrame:
    return piecewise_counts(matches.select("probe_id", F.lit(1).alias("n"), F.col("matched").cast("int").alias("h")), counts)


def piecewise_counts(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    total = counts.agg(F.coalesce(F.sum("n_gt"), F.lit(0)).alias("n_gt"), F.count("*").alias("n_classes"))
    n, tp = F.sum("n"), F.sum("h")
    out = pieces.groupBy("probe_id").agg(n.alias("n_pred"), tp.alias("tp"), (n - tp).alias("fp"))
    return out.crossJoin(F.broadcast(total)).withColumn("fn", F.col("n_gt") - F.col("tp"))  # one row


def verdicts(scores: DataFrame, baseline_probe: int = 0, share: float = 0.6) -> DataFrame:
    """failed: map50 is strictly below the share of the baseline's."""
    base = F.max(F.when(F.col("probe_id") == baseline_probe, F.col("map50"))).over(Window.partitionBy())  # one row for each probe
    return scores.withColumn("threshold", base * share).where("threshold IS NOT NULL").withColumn("failed", F.col("map50") < F.col("threshold"))


def scored_labels(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """Detections whose label is annotated at all in this set."""
    return detections.join(truths.select("label").distinct(), "label", "left_semi")


def induced_false_positives(matches: DataFrame, clean_probe: int = 0, threshold: float = IOU) -> DataFrame:
    """Unmatched detections that no clean detection of the same image and label overlaps enough."""
    clean = matches.where(F.col("probe_id") == clean_probe).select(*KEY, *[F.col(c).alias(f"c_{c}") for c in BOX])
    near = iou(_box(), tuple(F.col(f"c_{c}") for c in BOX)) >= threshold
    bad = matches.where(~F.col("matched") & (F.col("probe_id") != clean_probe)).alias("d")
    same = (F.col("d.image_id") == F.col("c.image_id")) & (F.col("d.label") == F.col("c.label"))
    return bad.join(clean.alias("c"), same & near, "left_anti")


def _induced(clean_probe, threshold: float):
    """From tables of claims of whole buckets: the unmatched detections of other probes that no clean one of their bucket overlaps enough."""

    def run(tables):
        for table in tables:
            table = table.combine_chunks()
            start = group_starts(table, KEY)
            bucket = np.repeat(np.arange(len(start)), np.diff(np.r_[start, table.num_rows]))
            is_clean = pc.equal(table.column("probe_id"), clean_probe)
            other = pc.fill_null(pc.invert(is_clean), False).to_numpy() & ~table.column("matched").to_numpy()
            known = pc.and_(table.column("image_id").is_valid(), table.column("label").is_valid()).to_numpy()
            clean, bad = np.flatnonzero(pc.fill_null(is_clean, False).to_numpy() & known), np.flatnonzero(other)
            box = _boxes(table)
            per_bucket = np.bincount(bucket[clean], minlength=len(start))
            first = np.cumsum(per_bucket) - per_bucket
            seen = np.zeros(len(bad), bool)
            for part in chunks(per_bucket[bucket[bad]]):
                here = bucket[bad[part]]
                of, k = spans(per_bucket[here])
                near = overlap(box[bad[part]][of], box[clean[first[here][of] + k]]) >= threshold
                seen[part.start + of[near]] = True
            yield table.take(pa.array(bad[~seen]))

    return run


def induced(rows: DataFrame, clean_probe: int = 0, threshold: float = IOU) -> DataFrame:
    """induced_false_positives of the claims of rows as claims() takes them, told where a bucket is matched."""
    return _told(rows, threshold, _induced(clean_probe, threshold), _MATCHED)
