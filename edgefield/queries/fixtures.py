"""DuckDB text of the derived views, and the parts that several oracles share."""

from __future__ import annotations

TRUTHS = """
boxed AS (SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS image_id, CAST(l_partkey % 6 AS INT) AS label, CAST(l_partkey * 37 % 600 AS DOUBLE) AS x0, CAST(l_suppkey * 53 % 400 AS DOUBLE) AS y0,
  CAST(l_partkey * 37 % 600 AS DOUBLE) + 20 + 2 * l_quantity AS x1, CAST(l_suppkey * 53 % 400 AS DOUBLE) + 16 + l_quantity AS y1, * FROM lineitem),
truths AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id, label ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS gt_idx, x0, y0, x1, y1 FROM boxed)
"""
DETECTIONS = """
probes AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)) t(probe_id, val)),
cents AS (SELECT *, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c FROM boxed),
dets AS (SELECT probe_id, image_id, label, 0.25 + 0.75 * ((c * 7919) % 1000) / 1000.0::DOUBLE AS score, x0 + val * l_discount * 8 AS x0, y0 + val * l_tax * 4 AS y0, x1 + val * l_discount * 8 AS x1, y1 + val * l_tax * 4 AS y1
  FROM cents, probes WHERE (c * 104729) % 100 >= val / 2)
"""


def iou(a: str, b: str) -> str:
    w, h = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    area = lambda t: f"greatest({t}.x1 - {t}.x0, 0) * greatest({t}.y1 - {t}.y0, 0)"
    return f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / ({area(a)} + {area(b)} - {w} * {h}) ELSE 0 END"


MATCH = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, label ORDER BY score DESC, x0, y0, x1, y1) AS rk FROM dets),
pairs AS (SELECT d.probe_id, d.image_id, d.label, d.rk, t.gt_idx, {iou('d', 't')} AS o FROM numbered d JOIN truths t ON d.image_id = t.image_id AND d.label = t.label),
best AS (SELECT probe_id, image_id, label, rk, max(o) AS best_iou, coalesce(list(gt_idx ORDER BY o DESC, gt_idx) FILTER (o >= 0.5), []) AS cand FROM pairs GROUP BY ALL),
ready AS (SELECT n.*, coalesce(best_iou, 0) AS best_iou, coalesce(cand, []) AS cand FROM numbered n LEFT JOIN best USING (probe_id, image_id, label, rk)),
fold AS (
  SELECT probe_id, image_id, label, rk, cand[1] AS got, CASE WHEN len(cand) > 0 THEN [cand[1]] ELSE CAST([] AS INT[]) END AS claimed FROM ready WHERE rk = 1
  UNION ALL
  SELECT r.probe_id, r.image_id, r.label, r.rk, list_filter(r.cand, lambda g: NOT list_contains(f.claimed, g))[1],
    CASE WHEN len(list_filter(r.cand, lambda g: NOT list_contains(f.claimed, g))) > 0 THEN list_append(f.claimed, list_filter(r.cand, lambda g: NOT list_contains(f.claimed, g))[1]) ELSE f.claimed END
  FROM fold f JOIN ready r ON r.probe_id = f.probe_id AND r.image_id = f.image_id AND r.label = f.label AND r.rk = f.rk + 1),
matches AS (SELECT r.probe_id, r.image_id, r.label, r.score, r.x0, r.y0, r.x1, r.y1, f.got IS NOT NULL AS matched, f.got AS gt_idx, r.best_iou FROM ready r JOIN fold f USING (probe_id, image_id, label, rk))
"""
AP = """
counts AS (SELECT label, count(*) AS n_gt FROM truths GROUP BY label),
ranked AS (SELECT m.*, n_gt, sum(CAST(matched AS INT)) OVER w / row_number() OVER w AS pr, row_number() OVER w AS rn
  FROM matches m JOIN counts USING (label) WINDOW w AS (PARTITION BY probe_id, label ORDER BY score DESC, image_id, x0, y0, x1, y1 ROWS UNBOUNDED PRECEDING)),
env AS (SELECT *, max(pr) OVER (PARTITION BY probe_id, label ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM ranked),
ap AS (SELECT probe_id, label, sum(CASE WHEN matched THEN e / n_gt ELSE 0 END) AS ap, any_value(n_gt) AS n_gt FROM env GROUP BY ALL),
map50 AS (SELECT p.probe_id, avg(coalesce(ap, 0)) AS map50 FROM probes p CROSS JOIN counts c LEFT JOIN ap ON ap.probe_id = p.probe_id AND ap.label = c.label GROUP BY 1)
"""
ALL = f"WITH RECURSIVE {TRUTHS}, {DETECTIONS}, {MATCH}, {AP} "
