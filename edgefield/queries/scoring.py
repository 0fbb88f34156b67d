"""Matching, average precision, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgefield.functions.geometry import BOX, iou
from edgefield.operators import matching as M
from edgefield.operators.suppression import suppress
from edgefield.queries import fixtures as X
from edgefield.sources.tables import annotated, detections, probes, truths


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Claims in pieces, written once: scores, verdicts and counts read no detection."""
    return M.scored(annotated(spark, d))


def _map50(spark: SparkSession, d: str) -> DataFrame:
    return M.piecewise_map50(_scored(spark, d), M.truth_counts(truths(spark, d)), probes(spark))


def truth_counts(spark, d):
    return M.truth_counts(truths(spark, d))


def _overlaps(dets: DataFrame, truths: DataFrame, *by: str) -> DataFrame:
    t = truths.select("image_id", "label", "gt_idx", *[F.col(c).alias(f"t_{c}") for c in BOX])
    both = dets.join(t, M.KEY)
    o = iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"t_{c}") for c in BOX))
    return both.withColumn("o", o).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.sum((F.col("o") >= 0.5).cast("long")).alias("n_match"), F.round(F.avg("o"), 9).alias("mean_iou"))


def iou_pairs(spark, d):
    return _overlaps(detections(spark, d), truths(spark, d), "label")


def iou_pairs_by_probe(spark, d):
    return _overlaps(detections(spark, d), truths(spark, d), "probe_id", "label")


def greedy_match(spark, d):
    return M.claims(annotated(spark, d)).select("probe_id", "image_id", "label", "score", *BOX, "matched", F.round("best_iou", 9).alias("best_iou"))


def ap_by_class(spark, d):
    return M.piecewise_precision(_scored(spark, d), M.truth_counts(truths(spark, d))).select("probe_id", "label", "n_gt", F.round("ap", 9).alias("ap"))


def map50_by_probe(spark, d):
    return _map50(spark, d).select("probe_id", F.round("map50", 9).alias("map50"))


def probe_counts(spark, d):
    return M.piecewise_counts(_scored(spark, d), M.truth_counts(truths(spark, d)))


def scored_label_semi(spark, d):
    known = truths(spark, d).where("label != 5")
    return M.scored_labels(detections(spark, d), known).groupBy("probe_id", "label").agg(F.count("*").alias("n"))


def verdicts(spark, d):
    out = M.verdicts(_map50(spark, d))
    return out.select("probe_id", F.round("map50", 9).alias("map50"), F.round("threshold", 9).alias("threshold"), "failed")


def confidence_filter(spark, d):
    return detections(spark, d).where("score >= 0.5").groupBy("probe_id").agg(F.count("*").alias("n_shown"))


def induced_fp_anti(spark, d):
    return M.induced(annotated(spark, d)).groupBy("probe_id", "label").agg(F.count("*").alias("n_induced"), F.round(F.max("score"), 9).alias("top_score"))


def _suppressed(dets: DataFrame, *by: str) -> DataFrame:
    return suppress(dets).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept"))


def nms_fold(spark, d):
    """Greedy suppression within a probe, image and label, by label."""
    return _suppressed(detections(spark, d), "label")


def nms_by_probe(spark, d):
    """Greedy suppression within a probe, image and label: a box goes if a kept one with a higher score overlaps it by more than 0.45."""
    return _suppressed(detections(spark, d), "probe_id", "label")


_NMS = f"""WITH RECURSIVE {X.TRUTHS}, {X.DETECTIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, label ORDER BY score DESC, x0, y0, x1, y1) AS rk FROM dets),
o AS (SELECT a.probe_id, a.image_id, a.label, a.rk, list(b.rk) AS over_ FROM n a JOIN n b ON a.probe_id = b.probe_id AND a.image_id = b.image_id AND a.label = b.label AND b.rk < a.rk WHERE {X.iou('a', 'b')} > 0.45 GROUP BY ALL),
r AS (SELECT n.probe_id, n.image_id, n.label, n.rk, coalesce(over_, []) AS over_ FROM n LEFT JOIN o USING (probe_id, image_id, label, rk)),
f AS (SELECT probe_id, image_id, label, rk, true AS kept, [rk] AS ks FROM r WHERE rk = 1
  UNION ALL SELECT r.probe_id, r.image_id, r.label, r.rk, NOT list_has_any(r.over_, f.ks), CASE WHEN list_has_any(r.over_, f.ks) THEN f.ks ELSE list_append(f.ks, r.rk) END FROM f JOIN r ON r.probe_id = f.probe_id AND r.image_id = f.image_id AND r.label = f.label AND r.rk = f.rk + 1)
"""
QUERIES = {f.__name__: f for f in (truth_counts, iou_pairs, greedy_match, ap_by_class, map50_by_probe, probe_counts, scored_label_semi, verdicts, confidence_filter, induced_fp_anti, nms_fold, iou_pairs_by_probe, nms_by_probe)}
SQL = {
    "truth_counts": f"WITH {X.TRUTHS} SELECT label, count(*) AS n_gt FROM truths GROUP BY label",
    "iou_pairs": f"WITH {X.TRUTHS}, {X.DETECTIONS} SELECT label, count(*) AS n_pairs, sum(CASE WHEN o >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_match, round(avg(o), 9) AS mean_iou FROM (SELECT d.label, {X.iou('d', 't')} AS o FROM dets d JOIN truths t ON d.image_id = t.image_id AND d.label = t.label) GROUP BY label",
    "greedy_match": X.ALL + "SELECT probe_id, image_id, label, score, x0, y0, x1, y1, matched, round(best_iou, 9) AS best_iou FROM matches",
    "ap_by_class": X.ALL + "SELECT probe_id, label, n_gt, round(ap, 9) AS ap FROM ap",
    "map50_by_probe": X.ALL + "SELECT probe_id, round(map50, 9) AS map50 FROM map50",
    "probe_counts": X.ALL + "SELECT probe_id, count(*) AS n_pred, sum(matched::INT)::BIGINT AS tp, count(*) - sum(matched::INT)::BIGINT AS fp, (SELECT sum(n_gt) FROM counts)::BIGINT AS n_gt, (SELECT count(*) FROM counts) AS n_classes, (SELECT sum(n_gt) FROM counts)::BIGINT - sum(matched::INT)::BIGINT AS fn FROM matches GROUP BY probe_id",
    "scored_label_semi": f"WITH {X.TRUTHS}, {X.DETECTIONS} SELECT probe_id, label, count(*) AS n FROM dets WHERE label IN (SELECT label FROM truths WHERE label <> 5) GROUP BY ALL",
    "verdicts": X.ALL + "SELECT probe_id, round(map50, 9) AS map50, round((SELECT map50 * 0.6::DOUBLE FROM map50 WHERE probe_id = 0), 9) AS threshold, map50 < (SELECT map50 * 0.6::DOUBLE FROM map50 WHERE probe_id = 0) AS failed FROM map50",
    "confidence_filter": f"WITH {X.TRUTHS}, {X.DETECTIONS} SELECT probe_id, count(*) AS n_shown FROM dets WHERE score >= 0.5 GROUP BY 1",
    "induced_fp_anti": X.ALL + f"SELECT probe_id, label, count(*) AS n_induced, round(max(score), 9) AS top_score FROM matches d WHERE NOT matched AND probe_id <> 0 AND NOT EXISTS (SELECT 1 FROM matches c WHERE c.probe_id = 0 AND c.image_id = d.image_id AND c.label = d.label AND {X.iou('d', 'c')} >= 0.5) GROUP BY ALL",
    "iou_pairs_by_probe": f"WITH {X.TRUTHS}, {X.DETECTIONS} SELECT probe_id, label, count(*) AS n_pairs, sum(CASE WHEN o >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_match, round(avg(o), 9) AS mean_iou FROM (SELECT d.probe_id, d.label, {X.iou('d', 't')} AS o FROM dets d JOIN truths t ON d.image_id = t.image_id AND d.label = t.label) GROUP BY ALL",
    "nms_fold": _NMS + "SELECT label, count(*) AS n, sum(kept::INT)::BIGINT AS n_kept FROM f GROUP BY label",
    "nms_by_probe": _NMS + "SELECT probe_id, label, count(*) AS n, sum(kept::INT)::BIGINT AS n_kept FROM f GROUP BY ALL",
}
