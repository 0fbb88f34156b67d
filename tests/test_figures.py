from edgefield.queries.preparing import figures_matched


def test_a_figure_meets_every_value(spark):
    values = [k / 10 for k in range(1, 51)] + [0.0, 1234.5, 1e-7]
    figures = ["3.4", "0.999", "1.0", "4.98", "2.05", "0.0", "0.00", "0.0000001", "1240.0", "1241.0", "6.0", "1.006", "5.02", "99999.9"] + [f"{k / 1000:.3f}" for k in range(1, 6000, 7)]
    docs = spark.createDataFrame([(i, f"so {f} it is") for i, f in enumerate(figures)] + [(-1, "3.4 and 3.4 and 9.9 and 5.0"), (-2, "none"), (-3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_figures, r.n_matched) for r in figures_matched(docs, spark.createDataFrame([(v,) for v in values * 2], "v double")).collect()}
    close = lambda a, b: abs(a - b) <= 0.005 * max(abs(a), abs(b))
    want = {i: (1, int(any(close(float(f), v) for v in values))) for i, f in enumerate(figures)}
    assert got == want | {-1: (3, 2)}
