import json

import pytest
from pyspark.sql import functions as F

from edgefield.functions import text as T
from edgefield.operators import figures


def walked(node, path=""):
    """What a file holds, by path."""
    if isinstance(node, dict):
        for k, v in node.items():
            if not set(k) & set(".[]"):
                yield from walked(v, f"{path}.{k}" if path else k)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walked(v, f"{path}[{i}]")
    else:
        try:
            yield path, float(node)
        except (TypeError, ValueError):
            yield path, None


FILES = {
    "deep": json.dumps({"a": [1, [2.5, {"b": [{"c": -3e2}]}], "7.5", "x", None, True], "k.x": {"y": 1}, "e": {}, "l": [], "z": {"a": {"b": {"c": {"d": 12345678.25}}}}}),
    "top": json.dumps([[1, 2], {"x": 3}]), "number": "5", "bad": "{no", "empty": "",
}


def test_flattened_is_a_walk(spark):
    df = spark.createDataFrame([*FILES.items(), ("none", None)], "file string, body string")
    got = sorted((r.file, r.path, r.value) for r in figures.flattened(df).collect())
    want = sorted((f, p, v) for f in ("deep", "top", "number") for p, v in walked(json.loads(FILES[f])))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_citations_and_their_verdicts(spark):
    text = "\n".join(
        ["It took 2.51 ms <!-- bench:deep.a[1][0] -->, -300 <!--bench:deep.a[1][1].b[0].c-->", "`3 <!-- bench:deep.a[0] -->` 1,000.5 µs <!-- bench:deep.z -->", "9 <!-- bench:gone.a --> and 3 % <!-- bench:top[1].x --> 2<!-- bench:top[0][1] -->", "5 <!-- bench:number --> 1 <!-- bench:bad.x --> 12,345,700 <!-- bench:deep.z.a.b.c.d -->", "7.5 <!-- bench:deep.a[2] --> 4 <!-- bench:deep.k.x.y -->"]
    )
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no figures 1.5")], "doc_id long, text string")
    files = spark.createDataFrame([*FILES.items(), (None, "{}"), ("top", json.dumps([[1, 9], {"x": 3.01}]))], "file string, body string")
    got = [(r.line, r.source, r.cited, r.actual, r.verdict) for r in figures.checked(docs, files).orderBy("line", "source").collect()]
    fine, none = figures.FINE, figures.NO_VALUE
    assert got == sorted(
        [
            (1, "deep.a[1][0]", 2.51, 2.5, fine), (1, "deep.a[1][1].b[0].c", -300.0, -300.0, fine), (2, "deep.a[0]", 3.0, 1.0, figures.DIFFERS), (2, "deep.z", 1000.5, None, none), (3, "gone.a", 9.0, None, figures.NO_FILE),
            (3, "top[1].x", 3.0, 3.0, fine), (3, "top[0][1]", 2.0, 2.0, fine), (4, "number", 5.0, 5.0, fine), (4, "bad.x", 1.0, None, none), (4, "deep.z.a.b.c.d", 12345700.0, 12345678.25, fine), (5, "deep.a[2]", 7.5, 7.5, fine), (5, "deep.k.x.y", 4.0, None, none),
        ],
        key=lambda r: r[:2],
    )
    assert figures.checked(docs.where("doc_id > 1"), files).count() == 0


@pytest.mark.parametrize("text, want", [("a [TBD] b [tbd soon] [Update after run 3] [update] [TBDX] [see TBD]", 3), ("", 0), ("[[TBD]]", 1)])
def test_placeholders(spark, text, want):
    assert spark.range(1).select(T.placeholders(F.lit(text)).alias("n")).first()["n"] == want


def test_uncited_decimals(spark):
    text = "a 1.25 b 1.2.3 v2.5 x\n12.5ms and 0.5. <!-- 9.9\n8.8 --> 7.75 `6.5` 3.5 % <!-- bench:a.b --> end 4.5, 2.25.x"
    got = spark.range(1).select(T.uncited_figures(F.lit(text)).alias("f")).first()["f"]
    assert [(f.line, f.figure) for f in got] == [(1, "1.25"), (2, "12.5"), (2, "0.5"), (3, "7.75"), (3, "4.5"), (3, "2.25")]


def test_limitations(spark):
    text = "1. **not here** x\n## Known limitations\n\n1. **One `code`\n  here.** more **bold**\n2. plain\n3. **Two** x\n10. **Three**"
    got = spark.range(1).select(T.limitations(F.lit(text)).alias("a"), T.limitations(F.lit("no heading\n1. **x**")).alias("b")).first()
    assert got["a"] == ["One code here.", "Two", "Three"] and got["b"] == []
