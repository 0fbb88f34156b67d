import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgefield.functions.geometry import BOX, iou
from edgefield.operators import matching as M
from edgefield.operators.ranges import first_ranks, ordered_ranges
from edgefield.operators.suppression import suppress


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda t: max(t[2] - t[0], 0) * max(t[3] - t[1], 0)
    return w * h / (area(a) + area(b) - w * h)


@pytest.mark.parametrize("a,b,want", [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou_by_hand(spark, a, b, want):
    lit = lambda t: tuple(F.lit(float(x)) for x in t)
    assert spark.range(1).select(iou(lit(a), lit(b)).alias("o")).first().o == pytest.approx(want)


def frames(spark, truths, detections):
    t = spark.createDataFrame(truths, "image_id long, label int, gt_idx int, x0 double, y0 double, x1 double, y1 double")
    d = spark.createDataFrame(detections, "probe_id int, image_id long, label int, score double, x0 double, y0 double, x1 double, y1 double")
    return t, d


def plain_match(truths, detections):
    out = {}
    claimed = set()
    for d in sorted(detections, key=lambda d: (d[0], -d[3], d[1], d[4:])):
        pool = [(plain_iou(d[4:], t[3:]), -t[2], t) for t in truths if t[0] == d[1] and t[1] == d[2]]
        free = [x for x in pool if (d[0], *x[2][:3]) not in claimed]
        best = max(free, key=lambda x: x[:2], default=None)
        hit = best is not None and best[0] >= 0.5
        if hit:
            claimed.add((d[0], *best[2][:3]))
        out[d] = (hit, best[2][2] if hit else None, max((x[0] for x in pool), default=0.0))
    return out


def test_matching_is_the_plain_one(spark):
    rng = random.Random(1)
    box = lambda: (x := rng.randrange(0, 30), y := rng.randrange(0, 30), x + rng.randrange(5, 25), y + rng.randrange(5, 25))
    truths, seen = [], {}
    for _ in range(120):
        k = (rng.randrange(6), rng.randrange(3))
        seen[k] = seen.get(k, 0) + 1
        truths.append((*k, seen[k], *map(float, box())))
    detections = list({(rng.randrange(3), rng.randrange(7), rng.randrange(4), rng.randrange(1, 9) / 8, *map(float, box())) for _ in range(600)})
    t, d = frames(spark, truths, detections)
    want = plain_match(truths, detections)
    for r in M.greedy_match(d, t).collect():
        key = (r.probe_id, r.image_id, r.label, r.score, r.x0, r.y0, r.x1, r.y1)
        hit, gt, best = want[key]
        assert (r.matched, r.gt_idx) == (hit, gt) and r.best_iou == pytest.approx(best)


def ap_of(spark, hits, n_gt, buckets=1024):
    rows = [(0, i, 0, 1.0 - i / 100, 0.0, 0.0, 1.0, 1.0, bool(h)) for i, h in enumerate(hits)]
    m = spark.createDataFrame(rows, "probe_id int, image_id long, label int, score double, x0 double, y0 double, x1 double, y1 double, matched boolean")
    return M.average_precision(m, spark.createDataFrame([(0, n_gt)], "label int, n_gt long"), buckets).first().ap


@pytest.mark.parametrize("hits,n,want", [([1, 0, 1], 2, 5 / 6), ([1], 2, 0.5), ([0, 0], 3, 0.0), ([1, 1], 2, 1.0)])
def test_average_precision_by_hand(spark, hits, n, want):
    assert ap_of(spark, hits, n) == pytest.approx(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=40), st.sampled_from([1, 7, 100, 4096]))
def test_average_precision_does_not_depend_on_buckets(spark, hits, buckets):
    n = max(1, sum(hits))
    best, area = 0.0, 0.0
    for i in range(len(hits) - 1, -1, -1):
        best = max(best, sum(hits[: i + 1]) / (i + 1))
        area += best / n if hits[i] else 0
    assert ap_of(spark, hits, n, buckets) == pytest.approx(area)


def test_map_counts_labels_without_detections_and_probes_without_any(spark):
    t, d = frames(spark, [(0, 0, 1, 0.0, 0.0, 10.0, 10.0), (0, 1, 1, 0.0, 0.0, 10.0, 10.0)], [(0, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 0, 7, 0.8, 0.0, 0.0, 1.0, 1.0)])
    counts = M.truth_counts(t)
    matches = M.greedy_match(d, t)
    probes = spark.createDataFrame([(0,), (1,)], "probe_id int")
    assert {r.probe_id: r.map50 for r in M.map50(matches, counts, probes).collect()} == {0: 0.5, 1: 0.0}
    r = M.counts_by_probe(matches, counts).first()
    assert (r.n_pred, r.tp, r.fp, r.n_gt, r.fn, r.n_classes) == (2, 1, 1, 2, 1, 2)
    assert M.scored_labels(d, t).count() == 1
    assert {x.map50 for x in M.map50(matches, counts.limit(0), probes).collect()} == {0.0}


def test_verdict_is_strict(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2999)], "probe_id int, map50 double")
    assert {r.probe_id: r.failed for r in M.verdicts(scores).collect()} == {0: False, 1: False, 2: True}


def test_suppression(spark):
    _, d = frames(spark, [(0, 0, 1, 0.0, 0.0, 1.0, 1.0)], [(0, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 0, 0, 0.8, 1.0, 0.0, 11.0, 10.0), (0, 0, 0, 0.7, 5.0, 0.0, 15.0, 10.0), (0, 0, 1, 0.6, 0.0, 0.0, 10.0, 10.0)])
    assert {r.score: r.kept for r in suppress(d).collect()} == {0.9: True, 0.8: False, 0.7: True, 0.6: True}
    assert len(BOX) == 4


def test_suppression_keeps_probes_apart(spark):
    rng = random.Random(5)
    box = lambda: (x := rng.randrange(0, 20), y := rng.randrange(0, 20), x + rng.randrange(5, 20), y + rng.randrange(5, 20))
    rows = list({(rng.randrange(3), rng.randrange(4), rng.randrange(2), rng.randrange(1, 9) / 8, *map(float, box())) for _ in range(300)})
    _, d = frames(spark, [(0, 0, 1, 0.0, 0.0, 1.0, 1.0)], rows)
    want, kept = {}, {}
    for r in sorted(rows, key=lambda r: (r[:3], -r[3], r[4:])):
        free = all(plain_iou(r[4:], k) <= 0.45 for k in kept.get(r[:3], []))
        want[r] = free
        if free:
            kept.setdefault(r[:3], []).append(r[4:])
    assert {(r.probe_id, r.image_id, r.label, r.score, r.x0, r.y0, r.x1, r.y1): r.kept for r in suppress(d).collect()} == want


def test_pairs_and_suppression_reach_every_probe(spark):
    from pathlib import Path

    from edgefield.queries import scoring
    from edgefield.sources.tables import PROBES, detections

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("the generated tables are not here")
    every = {k for k, _ in PROBES}
    assert {r.probe_id for r in scoring.iou_pairs_by_probe(spark, sf).collect()} == every
    out = scoring.nms_by_probe(spark, sf).collect()
    assert {r.probe_id for r in out} == every and sum(r.n for r in out) == detections(spark, sf).count()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, -1.5, 0.0, 0.25, 0.25001, 7.0, float("inf")]), st.integers(0, 30)), max_size=60, unique=True), st.sampled_from([1, 2, 5, 1024]))
def test_ranges_rise_in_the_order_of_value_and_tie(spark, rows, parts):
    df = spark.createDataFrame(rows, "v double, t long")
    got = sorted(((r.v is not None, r.v or 0.0), r.t, r.g) for r in ordered_ranges(df, "v", "t", "g", parts).collect())
    assert len(got) == len(rows) and [g for *_, g in got] == sorted(g for *_, g in got)


def test_a_value_that_most_rows_share_is_cut_by_the_tie(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN id / 100 ELSE 5.0D END AS v", "id AS t")
    sizes = [r["count"] for r in ordered_ranges(df, "v", "t", "g", 64).groupBy("g").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 64 * 4


def test_first_ranks_are_those_of_one_sort(spark):
    df = spark.range(500).selectExpr("id % 2 AS k", "CAST(pmod(id * 37, 41) AS double) AS v")
    want = {(r.k, r.v): r.n for r in df.selectExpr("k", "v", "rank() OVER (PARTITION BY k ORDER BY v) AS n").collect()}
    assert {(r.k, r.v): r.n for r in first_ranks(df, ["k"], "v", "n", 7).collect()} == want


def test_average_precision_with_one_score_for_all(spark):
    rows = [(0, i, 0, 0.5, 0.0, 0.0, 1.0, 1.0, i % 3 == 0) for i in range(300)]
    m = spark.createDataFrame(rows, "probe_id int, image_id long, label int, score double, x0 double, y0 double, x1 double, y1 double, matched boolean")
    hits, best, area = 100, 0.0, 0.0
    for i in range(299, -1, -1):
        best = max(best, (i // 3 + 1) / (i + 1))
        area += best * (i % 3 == 0)
    assert M.average_precision(m, spark.createDataFrame([(0, hits)], "label int, n_gt long"), 16).first().ap == pytest.approx(area / hits)


def test_line_items_are_dealt_once_for_claims(spark):
    from pathlib import Path

    from edgefield.queries import scoring

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("the generated tables are not here")
    for query in (scoring.greedy_match, scoring.induced_fp_anti):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        claims = plan[plan.index("MapInArrow") :]
        assert claims.count("Exchange") == 1 and claims.count("Sort [") == 1 and "Join" not in plan


def test_what_is_told_of_claims_in_their_tasks_is_what_their_rows_say(spark):
    rng = random.Random(9)
    box = lambda: (x := rng.randrange(0, 30), y := rng.randrange(0, 30), x + rng.randrange(5, 25), y + rng.randrange(5, 25))
    rows, seen = [], {}
    for _ in range(150):
        k = (rng.choice([None, *range(12)]), rng.randrange(3))
        seen[k] = seen.get(k, 0) + 1
        if k[0] is not None:
            rows.append((*k, True, None, seen[k], None, *map(float, box())))
    for _ in range(900):
        rows.append((rng.choice([None, *range(13)]), rng.choice([None, 0, 1, 2, 3]), False, rng.choice([None, 0, 1, 2]), None, rng.choice([None, float("nan"), 0.5, 0.25, -0.0, 0.0, 1.0]), *map(float, box())))
    df = spark.createDataFrame(rows, "image_id long, label int, is_truth boolean, probe_id int, gt_idx int, score double, x0 double, y0 double, x1 double, y1 double")
    df = df.repartitionByRange(3, "image_id", "label").sortWithinPartitions("image_id", "label").localCheckpoint()
    matches = M.claims(df).localCheckpoint()
    truths = df.where("is_truth").select("image_id", "label", "gt_idx", *BOX)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(matches, M.greedy_match(df.where("NOT is_truth").select("probe_id", "image_id", "label", "score", *BOX), truths))
    counts, columns = M.truth_counts(truths), matches.columns
    assert same(M.induced(df), M.induced_false_positives(matches).select(*columns)) and M.induced(df).count() > 20
    pieces = M.scored(df)
    assert same(M.piecewise_counts(pieces, counts), M.counts_by_probe(matches, counts))
    told = lambda ap: {(r.probe_id, r.label): (round(r.ap, 12), r.n_gt) for r in ap.where("probe_id IS NOT NULL").collect()}
    got = told(M.piecewise_precision(pieces, counts, 5))
    assert got == told(M.average_precision(matches, counts)) and len(got) == 9
    assert pieces.agg(F.max("n")).first()[0] > 8
