"""Datasets, maps, text checks and physical quantities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgefield.functions import geometry as G
from edgefield.functions import text as T
from edgefield.functions.axes import AXES
from edgefield.operators import maps as M
from edgefield.queries import fixtures as X
from edgefield.sources import selection as S
from edgefield.sources.tables import table


def _annotations(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("ann_id"), F.pmod("l_partkey", F.lit(6)).cast("int").alias("label"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)).alias("iscrowd"),
        F.pmod(F.col("l_partkey") * 37, F.lit(600)).cast("double").alias("x"), F.pmod(F.col("l_suppkey") * 53, F.lit(400)).cast("double").alias("y"), (20 + 2 * F.col("l_quantity")).alias("w"), (16 + F.col("l_quantity")).alias("h"),
    )


_ANN = "a AS (SELECT l_orderkey AS image_id, l_partkey * 100 + l_linenumber AS ann_id, CAST(l_partkey % 6 AS INT) AS label, l_linestatus = 'F' AND l_linenumber = 7 AS iscrowd, CAST(l_partkey * 37 % 600 AS DOUBLE) AS x, CAST(l_suppkey * 53 % 400 AS DOUBLE) AS y, 20 + 2 * l_quantity AS w, 16 + l_quantity AS h FROM lineitem)"


def coco_select(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.pmod("o_custkey", F.lit(8)) + 1).alias("licence"))
    out = S.select_images(_annotations(spark, d), images, [0, 1, 2, 3, 4], [4, 5, 7, 8])
    return out.select("image_id", "n", "licence", F.round(F.aggregate("objects", F.lit(0.0), lambda acc, o: acc + o["x1"] + o["y1"]), 2).alias("corner_sum"))


def licence_breakdown(spark, d):
    return table(spark, d, "orders").groupBy((F.pmod("o_custkey", F.lit(8)) + 1).alias("licence")).agg(F.count("*").alias("n"))


_CLS = "CASE l_partkey % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'person' ELSE 'bus' END"


def nod_select(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("ann_id"), F.expr(_CLS).alias("cls"), F.col("l_quantity").alias("area"))
    return S.subject_images(a, "car", "person")


def annotation_text(spark, d):
    li = table(spark, d, "lineitem")
    line = F.when(F.col("l_linenumber") == 7, F.lit("% header")).otherwise(F.concat_ws(" ", F.expr(_CLS), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("8"), F.lit("0")))
    return S.parse_annotations(li.select(line.alias("value"))).groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("width"), F.max("y1").alias("lowest"))


def label_intersection(spark, d):
    """Labels that both the annotations and a model know."""
    model = spark.createDataFrame([(0,), (2,), (4,), (9,)], "label int")
    return _annotations(spark, d).select("label").intersect(model)


def off_grid_columns(spark, d):
    """Columns of a map that events fall on and that its coarse grid lacks."""
    e = table(spark, d, "events").select(F.pmod("event_id", F.lit(31)).cast("int").alias("col"))
    return e.subtract(e.where("col % 8 = 7"))


def probe_identity(spark, d):
    """Probes of two machines side by side: identical, differing, or on one only."""
    e = table(spark, d, "events")
    a = e.where("event_id % 3 != 0").select("event_id", F.col("value").alias("a"))
    b = e.where("event_id % 5 != 0").select("event_id", F.when(F.col("event_type") == "view", F.col("value") + 0.5).otherwise(F.col("value")).alias("b"))
    kind = F.when(F.col("a").isNull(), "second only").when(F.col("b").isNull(), "first only").when(F.col("a") == F.col("b"), "identical").otherwise("differs")
    return a.join(b, "event_id", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"))


def _cells(spark, d):
    """A map of 17 x 17 cells, each scored by the events that fall on it."""
    e = table(spark, d, "events").select(F.pmod("event_id", F.lit(17)).cast("int").alias("i"), F.pmod(F.floor(F.col("event_id") / 17), F.lit(17)).cast("int").alias("j"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    cells = e.groupBy("i", "j").agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    return cells.select("i", "j", (F.col("c") / (F.col("n") * 10000.0)).alias("map50"), (F.col("c") < 5000 * F.col("n")).alias("failed"))


_CELLS = "g AS (SELECT (event_id % 17)::INT AS i, (event_id // 17 % 17)::INT AS j, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS c, count(*) AS n FROM events GROUP BY 1, 2), cells AS (SELECT i, j, c / (n * 10000.0::DOUBLE) AS map50, c < 5000 * n AS failed FROM g)"


def boundary_edges(spark, d):
    return M.edges(_cells(spark, d))


def uncovered_mask(spark, d):
    cells = _cells(spark, d).withColumn("x", F.col("i") / 16.0).withColumn("y", F.col("j") / 16.0)
    regions = spark.createDataFrame([("x", 0.25, 0.0), ("y", 0.8, 1.0)], "axis string, a double, b double")
    return M.in_regions(cells, regions).select("i", "j", "uncovered")


def nearest_opposite(spark, d):
    return M.nearest_other(_cells(spark, d))


def failed_cells(spark, d):
    return _cells(spark, d).agg(F.sum(F.col("failed").cast("long")).alias("n_failed"), F.count("*").alias("n"))


def image_stops(spark, d):
    """Rows and columns of a map with an image."""
    has = _cells(spark, d).where("(i * 7 + j * 3) % 5 = 0 AND i % 2 = 0")
    return has.agg(F.array_join(F.array_sort(F.collect_set("i")), ",").alias("is"), F.array_join(F.array_sort(F.collect_set("j")), ",").alias("js"))


def nearest_images(spark, d):
    return _cells(spark, d).select("i", "j", F.hypot(F.col("i") - 5.0, F.col("j") - 9.0).alias("r")).orderBy("r", "i", "j").limit(20).select("i", "j")


def figures_matched(docs, values):
    """docs: doc_id, text; values: v. Counts of each document's figures, and of those that any of the values is close enough to.

    Both sides are cut to their distinct numbers and meet in buckets of the tolerance; 0 is close to 0 only and has a bucket of its own."""
    figures = docs.select("doc_id", F.explode(F.array_distinct(T.cited_numbers(F.col("text")))).alias("figure")).withColumn("x", F.col("figure").try_cast("double"))
    here = F.when(F.col("x") > 0, T.near_buckets(F.col("x"))).otherwise(F.array(F.lit(None).cast("long")))
    there = F.when(F.col("v") > 0, T.tolerance_bucket(F.col("v")))
    numbers = figures.select("x").distinct().withColumn("b", F.explode(here))
    v = values.select("v").where("v >= 0").distinct().withColumn("b", there)
    hits = numbers.join(v, numbers["b"].eqNullSafe(v["b"])).where(T.close_enough(F.col("x"), F.col("v"))).select("x", F.lit(1).alias("hit")).distinct()
    return figures.join(hits, "x", "left").groupBy("doc_id").agg(F.count("*").alias("n_figures"), F.count("hit").alias("n_matched"))


def doc_figures(spark, d):
    """Decimal figures of texts against a table of values, to half a per cent; figures without a match are problems."""
    return figures_matched(table(spark, d, "documents"), table(spark, d, "part").select((F.col("p_size") / 10.0).alias("v")))


def citations(spark, d):
    text = F.col("text")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.size(T.cited_numbers(T.masked_code(text))).cast("long").alias("uncited"), T.placeholders(text).cast("long").alias("placeholders"), F.regexp_count(text, F.lit("the")).cast("long").alias("the"))
    return c.groupBy("conv_id").agg(F.sum("uncited").alias("uncited"), F.sum("placeholders").alias("placeholders"), F.sum("the").alias("the"))


def decision_export(spark, d):
    """Decisions in the order of their ids, numbered from what stood before."""
    c = table(spark, d, "conversations")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return c.select("conv_id", F.format_string("%04d-%s", seq, F.col("role")).alias("decision_id"), F.length("text").alias("chars"))


_AXIS_NAMES = ("motion_blur.exposure_ms", "motion_blur.angular_velocity_deg_s", "fog.beta_per_m", "low_light.illuminance_lux", "defocus.subject_distance_m", "lens_distortion.k1", "x.view_deg", "y.coc_diameter_um")


def unit_of(spark, d):
    """What the name of each event's axis says: degradation, field and unit."""
    axis = F.element_at(F.array(*map(F.lit, _AXIS_NAMES)), F.pmod("event_id", F.lit(len(_AXIS_NAMES))).cast("int") + 1)
    a = table(spark, d, "events").select("event_id", axis.alias("axis")).withColumn("p", T.degradation_of(F.col("axis")))
    return a.select("event_id", "axis", F.col("p.degradation").alias("degradation"), F.col("p.field").alias("field"), T.unit_of(F.col("p.field")).alias("unit"))


def probe_keys(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("v"))
    key = T.store_key(F.lit("road"), F.col("event_type"), F.lit(100), F.col("event_id"), F.create_map(F.lit("b.y"), F.col("v"), F.lit("a.x"), F.lit("1")))
    return e.select("event_id", T.probe_id(F.col("event_type"), F.col("v")).alias("probe_id"), key.alias("store_key"), T.command(F.col("event_type"), F.col("v"), F.lit(7)).alias("command"))


def severity_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.lit(0.5).alias("lo"), F.lit(400.0).alias("hi"), F.when(F.pmod("event_id", F.lit(2)) == 0, "hi").otherwise("lo").alias("end"))
    s = e.withColumn("s", G.to_severity(F.col("value"), F.col("lo"), F.col("hi"), F.col("end")))
    return s.select("event_id", F.round("s", 9).alias("severity"), F.round(G.clamp(G.from_severity(F.col("s"), F.col("lo"), F.col("hi"), F.col("end")), F.lit(1.0), F.lit(99.0)), 9).alias("value"))


def physics_derived(spark, d):
    """Physical quantities of every event's condition, its value being how far each axis is turned up."""
    q = F.col("q")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("q"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return rows.select(
        "id", r(G.psf_length_px(q * 40, F.lit(60.0)), "psf_px"), r(G.circle_of_confusion_px(0.6 + q * 5.4, F.lit(4.7), pitch_um=2.0), "coc_px"), r(G.corner_displacement_px(q * 0.4, q * 0.1), "corner_px"), r(G.row_shift_px(q * 40, F.lit(120.0)), "row_shift_px"),
        r(G.transmission(q * 0.12, F.lit(5.0)), "t_near"), r(G.transmission(q * 0.12, F.lit(80.0)), "t_far"), r(G.visibility_m(q * 0.12), "visibility_m"), r(G.signal_electrons(0.5 + q * 399.5, F.lit(10.0)), "signal_e"),
    )


_PHYSICS = """WITH r AS (SELECT event_id AS id, value / 100.0::DOUBLE AS q FROM events) SELECT id, round(900 * tan(radians(60.0::DOUBLE * (q * 40) / 1000)), 9) AS psf_px,
round(abs((0.6::DOUBLE + q * 5.4) - 20) / (0.6::DOUBLE + q * 5.4) * (0.008::DOUBLE * 0.008) / (4.7::DOUBLE * (20 - 0.008::DOUBLE)) / 2e-6::DOUBLE, 9) AS coc_px,
round(abs(q * 0.4::DOUBLE * 0.5 + q * 0.1::DOUBLE * 0.25) * (0.9::DOUBLE * 256 * sqrt(2.0) / 2), 9) AS corner_px, round(900 * tan(radians(120.0::DOUBLE * (q * 40) / 1000)), 9) AS row_shift_px,
round(exp(-(q * 0.12::DOUBLE) * 5), 9) AS t_near, round(exp(-(q * 0.12::DOUBLE) * 80), 9) AS t_far, round(CASE WHEN q * 0.12 > 1e-9 THEN 3.912::DOUBLE / (q * 0.12::DOUBLE) END, 9) AS visibility_m, round((0.5::DOUBLE + q * 399.5) * 10 * 180 / 1000, 9) AS signal_e FROM r"""


_LADDERS = ("motion_blur.exposure_ms", "low_light.illuminance_lux", "fog.beta_per_m", "jpeg.quality")


def fixture_64(spark, d):
    """Sixteen probes on each of four axes for every run, between the ends that the run has seen; light in equal ratios and the others in equal steps."""
    axes = spark.createDataFrame([(i, n, AXES[n].lo, AXES[n].hi, n.startswith("low_light")) for i, n in enumerate(_LADDERS)], "place int, axis string, lo double, hi double, ratio boolean")
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.pmod("event_id", F.lit(4)).cast("int").alias("place"), (F.col("value") / 100).alias("q"))
    seen = e.groupBy("run_id", "place").agg(F.min("q").alias("a"), F.max("q").alias("b")).join(F.broadcast(axes), "place")  # four axes
    at = lambda q: F.col("lo") + F.col(q) * (F.col("hi") - F.col("lo"))
    rungs = seen.select("run_id", "axis", F.posexplode(G.ladder(at("a"), at("b"), 16, F.col("ratio"))).alias("k", "v"))
    return rungs.select("run_id", F.format_string("%s#%02d", "axis", "k").alias("probe_id"), F.round("v", 6).alias("value"))


def letterbox(spark, d):
    """Sizes of images scaled into a square of 640, and the scale, for boxes of all kinds."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 64).alias("w"), (F.pmod("p_partkey", F.lit(50)) * 29 + 48).alias("h"))
    s = F.least(640.0 / F.col("w"), 640.0 / F.col("h"))
    return p.select("p_partkey", F.round(s, 9).alias("scale"), F.bround(F.col("w") * s).cast("long").alias("sw"), F.bround(F.col("h") * s).cast("long").alias("sh"))


def frame_measures_small(spark, d):
    """Mean, contrast and sharpness of 8 x 8 frames with plain array functions; borders mirror without the edge pixel."""
    g = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + F.lit(400.0) * v.cast("double")))).cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", g.alias("g"))
    mirror = lambda k: F.when(k < 0, -k).when(k > 7, 14 - k).otherwise(k)
    at = lambda r, c: F.get("g", (mirror(r) * 8 + mirror(c)).cast("int"))

    def lap(i):
        r, c = F.floor(i / 8), F.pmod(i, F.lit(8))
        return at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c)

    e = e.withColumn("l", F.transform(F.sequence(F.lit(0), F.lit(63)), lap))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    var = lambda c: (64 * squares(c) - total(c) * total(c)) / 4096.0
    return e.select("vec_id", (total("g") / 64).alias("mean_level"), F.round(F.sqrt(var("g")), 9).alias("rms_contrast"), var("l").alias("laplacian_var"))


_MIRROR = "CASE WHEN {k} < 0 THEN -({k}) WHEN {k} > 7 THEN 14 - ({k}) ELSE {k} END"


def _px(dr: int, dc: int) -> str:
    r, c = _MIRROR.format(k=f"(i // 8 + {dr})"), _MIRROR.format(k=f"(i % 8 + {dc})")
    return f"g[({r}) * 8 + ({c}) + 1]"


QUERIES = {
    f.__name__: f
    for f in (
        coco_select, licence_breakdown, nod_select, annotation_text, label_intersection, off_grid_columns, probe_identity, boundary_edges, uncovered_mask, nearest_opposite, failed_cells, image_stops, nearest_images,
        doc_figures, citations, decision_export, unit_of, probe_keys, severity_roundtrip, physics_derived, fixture_64, letterbox, frame_measures_small,
    )
}
_UNIT = "CASE WHEN f LIKE '%\\_deg\\_s' ESCAPE '\\' THEN 'deg/s' WHEN f LIKE '%\\_per\\_m' ESCAPE '\\' THEN '1/m' WHEN f LIKE '%\\_deg' ESCAPE '\\' THEN 'deg' WHEN f LIKE '%\\_ms' ESCAPE '\\' THEN 'ms' WHEN f LIKE '%\\_lux' ESCAPE '\\' THEN 'lux' WHEN f LIKE '%\\_um' ESCAPE '\\' THEN 'um' WHEN f LIKE '%\\_m' ESCAPE '\\' THEN 'm' ELSE '1' END"
SQL = {
    "coco_select": f"WITH {_ANN}, o AS (SELECT image_id, count(*) AS n, round(sum(x + w + y + h), 2) AS corner_sum FROM a WHERE NOT iscrowd AND label IN (0, 1, 2, 3, 4) AND w * h >= 1024 GROUP BY 1 HAVING count(*) >= 3) SELECT image_id, n, o_custkey % 8 + 1 AS licence, corner_sum FROM o JOIN orders ON o_orderkey = image_id WHERE o_custkey % 8 + 1 IN (4, 5, 7, 8) ORDER BY n DESC, image_id LIMIT 100",
    "licence_breakdown": "SELECT o_custkey % 8 + 1 AS licence, count(*) AS n FROM orders GROUP BY 1",
    "nod_select": f"WITH k AS (SELECT l_orderkey AS image_id, {_CLS} AS cls, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 100 + l_linenumber) AS rk FROM lineitem) SELECT image_id, max(CASE WHEN rk = 1 THEN cls END) AS main FROM k GROUP BY 1 HAVING max((cls = 'car')::INT) = 1 AND max(CASE WHEN rk = 1 THEN cls END) <> 'person'",
    "annotation_text": f"SELECT {_CLS} AS cls, count(*) AS n, sum(l_linenumber)::DOUBLE AS width, max(l_suppkey + 8)::DOUBLE AS lowest FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1",
    "label_intersection": f"WITH {_ANN} SELECT DISTINCT label FROM a WHERE label IN (0, 2, 4, 9)",
    "off_grid_columns": "SELECT (event_id % 31)::INT AS col FROM events EXCEPT SELECT (event_id % 31)::INT FROM events WHERE event_id % 31 % 8 = 7",
    "probe_identity": "WITH a AS (SELECT event_id, value AS a FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, CASE WHEN event_type = 'view' THEN value + 0.5 ELSE value END AS b FROM events WHERE event_id % 5 <> 0) SELECT CASE WHEN a IS NULL THEN 'second only' WHEN b IS NULL THEN 'first only' WHEN a = b THEN 'identical' ELSE 'differs' END AS kind, count(*) AS n, max(abs(a - b)) AS max_diff FROM a FULL JOIN b USING (event_id) GROUP BY 1",
    "boundary_edges": f"WITH {_CELLS}, k AS (SELECT i, j, failed, lag(failed) OVER (PARTITION BY j ORDER BY i) AS l, lag(failed) OVER (PARTITION BY i ORDER BY j) AS t FROM cells) SELECT i, j, 'left' AS side FROM k WHERE l <> failed UNION ALL SELECT i, j, 'top' FROM k WHERE t <> failed",
    "uncovered_mask": f"WITH {_CELLS} SELECT i, j, (i / 16.0 BETWEEN 0.0 AND 0.25) OR (j / 16.0 BETWEEN 0.8 AND 1.0) AS uncovered FROM cells",
    "nearest_opposite": f"WITH {_CELLS} SELECT a.i, a.j, a.failed, coalesce(min(greatest(abs(a.i - b.i), abs(a.j - b.j))), 1000000)::INT AS distance FROM cells a LEFT JOIN cells b ON a.failed <> b.failed GROUP BY ALL",
    "failed_cells": f"WITH {_CELLS} SELECT sum(failed::INT)::BIGINT AS n_failed, count(*) AS n FROM cells",
    "image_stops": f"WITH {_CELLS}, h AS (SELECT * FROM cells WHERE (i * 7 + j * 3) % 5 = 0 AND i % 2 = 0) SELECT array_to_string(list_sort(list(DISTINCT i)), ',') AS \"is\", array_to_string(list_sort(list(DISTINCT j)), ',') AS js FROM h",
    "nearest_images": f"WITH {_CELLS} SELECT i, j FROM cells ORDER BY sqrt((i - 5.0::DOUBLE) * (i - 5.0::DOUBLE) + (j - 9.0::DOUBLE) * (j - 9.0::DOUBLE)), i, j LIMIT 20",
    "doc_figures": rf"WITH f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{T.NUMBER}'))) AS figure FROM documents), x AS (SELECT doc_id, try_cast(figure AS DOUBLE) AS x FROM f), v AS (SELECT DISTINCT p_size / 10.0::DOUBLE AS v FROM part), h AS (SELECT DISTINCT x FROM (SELECT DISTINCT x FROM x) JOIN v ON abs(x - v) <= 0.005 * greatest(abs(x), abs(v))) SELECT doc_id, count(*) AS n_figures, sum((h.x IS NOT NULL)::INT)::BIGINT AS n_matched FROM x LEFT JOIN h USING (x) GROUP BY 1",
    "citations": rf"SELECT conv_id, sum(len(regexp_extract_all(regexp_replace(regexp_replace(text, '`[^`\n]*`', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '{T.NUMBER}')))::BIGINT AS uncited, sum(len(regexp_extract_all(text, '\[TBD\]')))::BIGINT AS placeholders, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS the FROM conversations GROUP BY 1",
    "decision_export": "SELECT conv_id, printf('%04d-%s', row_number() OVER (PARTITION BY conv_id ORDER BY turn, role), role) AS decision_id, length(text)::INT AS chars FROM conversations",
    "unit_of": f"WITH a AS (SELECT event_id, [{', '.join(repr(x) for x in _AXIS_NAMES)}][event_id % {len(_AXIS_NAMES)} + 1] AS axis FROM events), b AS (SELECT event_id, axis, split_part(axis, '.', 1) AS degradation, split_part(axis, '.', 2) AS f FROM a) SELECT event_id, axis, degradation, f AS field, {_UNIT} AS unit FROM b",
    "probe_keys": """SELECT event_id, event_type || '@' || user_id AS probe_id, 'road|' || event_type || '|100|' || event_id || '|{"a.x":"1","b.y":"' || user_id || '"}' AS store_key, 'edgefield probe --axis ' || event_type || ' --value ' || user_id || ' --seed 7' AS command FROM events""",
    "severity_roundtrip": "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN (value - 0.5) / 399.5 ELSE (value - 400.0) / -399.5 END, 9) AS severity, round(least(greatest(value, 1.0), 99.0), 9) AS value FROM events",
    "physics_derived": _PHYSICS,
    "fixture_64": """WITH e AS (SELECT user_id AS run_id, event_id % 4 AS place, min(value / 100) AS p, max(value / 100) AS q FROM events GROUP BY ALL),
s AS (SELECT run_id, axis, ratio, lo + p * (hi - lo) AS a, lo + q * (hi - lo) AS b FROM e JOIN (VALUES (0, 'motion_blur.exposure_ms', 0.0::DOUBLE, 40.0::DOUBLE, false), (1, 'low_light.illuminance_lux', 0.5, 400.0, true), (2, 'fog.beta_per_m', 0.0, 0.12, false), (3, 'jpeg.quality', 5.0, 100.0, false)) v(place, axis, lo, hi, ratio) USING (place))
SELECT run_id, printf('%s#%02d', axis, k) AS probe_id, round(CASE WHEN ratio THEN a * pow(b / a, k / 15.0::DOUBLE) ELSE a + (b - a) * k / 15 END, 6) AS value FROM s, range(16) r(k)""",
    "letterbox": "WITH p AS (SELECT p_partkey, p_size * 37 + 64 AS w, p_partkey % 50 * 29 + 48 AS h FROM part), s AS (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS s FROM p) SELECT p_partkey, round(s, 9) AS scale, round_even(w * s, 0)::BIGINT AS sw, round_even(h * s, 0)::BIGINT AS sh FROM s",
    "frame_measures_small": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + 400 * v::DOUBLE)))::DOUBLE) AS g FROM embeddings), p AS (SELECT vec_id, g, i FROM e, range(64) r(i)),
l AS (SELECT vec_id, g[i + 1] AS v, {_px(-1, 0)} + {_px(1, 0)} + {_px(0, -1)} + {_px(0, 1)} - 4 * g[i + 1] AS l FROM p)
SELECT vec_id, sum(v) / 64 AS mean_level, round(sqrt((64 * sum(v * v) - sum(v) * sum(v)) / 4096.0::DOUBLE), 9) AS rms_contrast, (64 * sum(l * l) - sum(l) * sum(l)) / 4096.0::DOUBLE AS laplacian_var FROM l GROUP BY 1""",
}
