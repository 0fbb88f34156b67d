import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgefield.llm import negatives, queries
from edgefield.llm.negatives import Mining, hard_negatives

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, p=Mining(), is_anchor=lambda i: i % 100 == 0):
    """By comparing every anchor with every row; rows are told apart by their place in the list."""
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) and abs(x) <= negatives.LARGEST for x in r[1])

    good = [(i, [math.floor(p.scale * x) for x in e], label) for i, e, label in filter(usable, rows)]
    out = []
    for a, (anchor, q, label) in enumerate(good):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other == label) for b, (i, v, other) in enumerate(good) if b != a and len(v) == len(q))
        for s, positive, _ in [x for x in scored if x[2]][: p.positives]:
            band = [x for x in scored if not x[2] and p.least_percent * -s <= 100 * -x[0] <= 100 * -s][: p.negatives]
            out += [(anchor, positive, rank, i, -s, -t) for rank, (t, i, _) in enumerate(band, 1)]
    return sorted(out)


def mined(spark, rows, p=Mining(), kind=KIND, **more):
    df = spark.createDataFrame(rows, kind).repartition(3)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard_negatives(df, p=p, **more).collect())


@pytest.mark.parametrize("p", [Mining(), Mining(page_rows=7, block=3, pivots=5, sample=40), Mining(positives=2, negatives=9, least_percent=30, pivots=1, page_rows=16)])
def test_clusters_are_brute_force(spark, p):
    rng = np.random.default_rng(17)
    centres = rng.standard_normal((12, 16))
    rows = [(int(i), (centres[i % 12] * rng.uniform(0.2, 3) + 0.3 * rng.standard_normal(16)).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(900)]
    assert mined(spark, rows, p) == brute(rows, p)


def test_pages_far_away_are_left_out(spark, monkeypatch):
    """Anchors in tight clusters need few pages; the answer is still that of all rows."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(20)[i % 20] * 10 + 0.01 * rng.standard_normal(20)).tolist(), int(rng.integers(0, 3))) for i in range(2000)]
    p = Mining(page_rows=50, block=10, pivots=32)
    sizes = []
    real = negatives.written
    monkeypatch.setattr(negatives, "written", lambda df, name: (sizes.append(out.count()) if name == "routes" else None, out)[1] if (out := real(df, name)) is not None else None)
    assert mined(spark, rows, p) == brute(rows, p)
    assert max(sizes) < 0.35 * (2000 / 50) * 20  # of all (page, anchor) pairs, blocks have several anchors


def test_ties_copies_and_repeated_ids(spark):
    same = [(i, [0.5, 0.25, -0.125], i % 2) for i in range(700)]
    repeated = [(800, [0.5, 0.25, 0.0], 0)] * 3 + [(801, [0.4, 0.2, 0.0], 1)] * 2
    rows = same + repeated
    p = Mining(page_rows=40, block=4)
    assert mined(spark, rows, p) == brute(rows, p)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 1.9], 2), (3, None, 1), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 2.0, 3.0], 2), (None, [1.0, 2.0], 2),
        (8, [1.0, 2.0], None), (100, [], 1), (101, [], 1), (102, [], 3), (200, [0.0, 0.0], 1), (201, [-1.0, -2.0], 1), (300, [1.0, 2.0, 3.0], 5), (400, [3e9, 4e9, 1.0, 7.0], 1), (401, [3e9, 4e9, 2.0, 6.0], 1), (402, [3e9, 3.9e9, 2.0, 5.0], 2), (403, [1e200, 0.0, 0.0, 0.0], 2), (-100, [1.0, 1.5], 2),
    ]
    got = mined(spark, rows)
    top = 2**63 - 1
    assert got == [(*r[:4], *(min(top, s) for s in r[4:])) for r in brute(rows)]
    assert {r[0] for r in got} == {0, 100, 200, 400, -100} or {r[0] for r in got} <= {0, 100, 200, 300, 400, -100}
    clash = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS page", "'x' AS uid", "'x' AS pivot", "2 AS anchor", "3 AS rank")
    assert hard_negatives(clash).count() == len(got)
    assert hard_negatives(clash.where("false")).count() == 0


def test_any_rows_can_be_anchors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist(), int(rng.integers(0, 3))) for i in range(200)]
    assert mined(spark, rows, is_anchor=F.col("vec_id") % 10 == 3) == brute(rows, is_anchor=lambda i: i % 10 == 3)


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(sf)}/embeddings.parquet'")
    want = con.sql(queries.OP11_SQL)
    got = queries.op11_hard_negatives(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
