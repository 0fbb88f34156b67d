"""Decoded heads, ranks, reports, fingerprints, colours, totals over several groupings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgefield.functions import text as T
from edgefield.operators import decoding as D
from edgefield.operators.ranges import first_ranks
from edgefield.plans import report
from edgefield.sources.ledger import numbered
from edgefield.sources.tables import table


def rank_correlation(spark, d):
    """Rank correlation of value and time by kind of event; ranks of ties are the first of them."""
    e = table(spark, d, "events").select("event_type", "value", F.expr("timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01', ts)").alias("at"))
    for of, rank in (("value", "a"), ("at", "b")):
        e = e.join(first_ranks(e, ["event_type"], of, rank), ["event_type", of])
    return e.groupBy("event_type").agg(F.round(F.corr(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("rho"))


def grid_decode(spark, d):
    """Boxes of a head with centre offsets and log sizes, here from vectors, on cells of a stride of 8."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("raw"), F.transform(F.slice("embedding", 5, 6), lambda x: F.abs(x).cast("double")).alias("scores"))
    b = D.grid_box(F.col("raw"), F.pmod("vec_id", F.lit(80)), F.floor(F.col("vec_id") / 80), F.lit(8.0), F.lit(0.5))
    out = v.select("vec_id", b.alias("b"), D.best_class(F.col("scores"), F.lit(0.5)).alias("c"))
    return out.select("vec_id", *[F.round(f"b.{x}", 6).alias(x) for x in ("x0", "y0", "x1", "y1")], F.col("c.label").alias("label"), F.round("c.score", 6).alias("score"))


def distance_decode(spark, d):
    """Boxes of a head with distances to four sides, each a softmax over eight bins."""
    side = lambda i: F.transform(F.slice("embedding", 1 + 8 * i, 8), lambda x: x.cast("double") * 10)
    b = D.distance_box([side(i) for i in range(4)], F.pmod("vec_id", F.lit(40)), F.floor(F.col("vec_id") / 40), F.lit(8.0), 320.0, F.lit(0.5))
    return table(spark, d, "embeddings").select("vec_id", b.alias("b")).select("vec_id", *[F.round(f"b.{x}", 6).alias(x) for x in ("x0", "y0", "x1", "y1")])


def json_figures(spark, d):
    """A figure by its path in JSON; a path that is absent gives none."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.no.such[0]").alias("none"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("none").alias("n_none"))


def report_rules(spark, d):
    """Findings and coverage that break a report's rules."""
    e = table(spark, d, "events")
    f = e.select(F.concat(F.lit("a"), "event_id").alias("axis"), F.when(F.col("event_type") == "view", "located").otherwise("passes_throughout").alias("status"), F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("value")).alias("lower"), F.lit(50.0).alias("upper"))
    c = e.select(F.concat(F.lit("a"), "event_id").alias("axis"), F.col("value").alias("percent"))
    return report.broken_rules(f, c, ["x"] * 5)


def fingerprint_redaction(spark, d):
    m = F.create_map(F.lit("cpu_model"), F.col("p_brand"), F.lit("kleidicv"), F.lit("yes"), F.lit("cv2_module"), F.col("p_type"), F.lit("opencv"), F.lit("5"))
    p = table(spark, d, "part").select("p_partkey", T.public_fingerprint(m, F.pmod("p_partkey", F.lit(2)) == 0).alias("f"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.map_keys("f")), ",").alias("keys"), F.try_element_at("f", F.lit("kleidicv")).alias("kleidicv"))


def map_colours(spark, d):
    e = table(spark, d, "events").select("event_id", T.colour(F.when(F.pmod("event_id", F.lit(50)) > 0, F.col("value") / 100)).alias("colour"))
    return e


def figures_with_units(spark, d):
    return table(spark, d, "part").select("p_partkey", T.with_unit(F.col("p_size") / 8.0, F.lit("ms"), 3).alias("shown"))


def probes_rollup(spark, d):
    """Probe totals by round and kind, by round, and over all."""
    e = table(spark, d, "events").select(F.pmod("event_id", F.lit(7)).alias("round"), "event_type", "value")
    return e.rollup("round", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def probes_cube(spark, d):
    e = table(spark, d, "events").select(F.pmod("event_id", F.lit(3)).alias("machine"), "event_type", "user_id")
    return e.cube("machine", "event_type").agg(F.countDistinct("user_id").alias("runs"))


def decision_numbers(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), "turn", "role")
    return numbered(c, 3, ["turn", "role"]).select("run_id", "seq", "decision_id")


def wave_select(spark, d):
    """One probe of a wave by its place in the array."""
    e = table(spark, d, "events").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return e.where("idx = 4").select(F.col("user_id").alias("run_id"), "event_id")


QUERIES = {f.__name__: f for f in (rank_correlation, grid_decode, distance_decode, json_figures, report_rules, fingerprint_redaction, map_colours, figures_with_units, probes_rollup, probes_cube, decision_numbers, wave_select)}
_E = lambda i: f"(SELECT sum(exp(v * 10 - t) * (k - 1)) / sum(exp(v * 10 - t)) FROM (SELECT unnest(list_transform(embedding[{1 + 8 * i}:{8 + 8 * i}], lambda x: x::DOUBLE)) AS v, unnest(range(1, 9)) AS k), (SELECT list_max(list_transform(embedding[{1 + 8 * i}:{8 + 8 * i}], lambda x: x::DOUBLE * 10)) AS t))"
_CLIP = "round(greatest(0.0, least(320.0, {})) / 0.5, 6)"
_MIX = "printf('%02x', floor({i}[k + 1] * (1 - (x - k)) + {i}[k + 2] * (x - k) + 0.5)::INT)"
_CHANNEL = lambda i: "[" + ", ".join(str(int(s[i : i + 2], 16)) for s in T.STOPS) + "]"
SQL = {
    "rank_correlation": "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value)::DOUBLE AS a, rank() OVER (PARTITION BY event_type ORDER BY ts)::DOUBLE AS b FROM events) SELECT event_type, round(corr(a, b), 6) AS rho FROM r GROUP BY 1",
    "grid_decode": """WITH v AS (SELECT vec_id, (embedding[1]::DOUBLE + vec_id % 80) AS cx, (embedding[2]::DOUBLE + floor(vec_id / 80)) AS cy, exp(embedding[3]::DOUBLE) AS w, exp(embedding[4]::DOUBLE) AS h, list_transform(embedding[5:10], lambda x: abs(x)::DOUBLE) AS s FROM embeddings)
SELECT vec_id, round((cx - w / 2) * 8 / 0.5, 6) AS x0, round((cy - h / 2) * 8 / 0.5, 6) AS y0, round((cx + w / 2) * 8 / 0.5, 6) AS x1, round((cy + h / 2) * 8 / 0.5, 6) AS y1, list_position(s, list_max(s))::INT - 1 AS label, round(list_max(s) * 0.5, 6) AS score FROM v""",
    "distance_decode": f"SELECT vec_id, {_CLIP.format(f'(vec_id % 40) * 8 + 3.5 - {_E(0)} * 8')} AS x0, {_CLIP.format(f'floor(vec_id / 40) * 8 + 3.5 - {_E(1)} * 8')} AS y0, {_CLIP.format(f'(vec_id % 40) * 8 + 3.5 + {_E(2)} * 8')} AS x1, {_CLIP.format(f'floor(vec_id / 40) * 8 + 3.5 + {_E(3)} * 8')} AS y1 FROM embeddings",
    "json_figures": "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(json_extract_string(props, '$.no.such[0]')) AS n_none FROM events GROUP BY 1",
    "report_rules": "SELECT 'a' || event_id AS axis, 'bounds' AS rule FROM events WHERE event_type = 'view' AND (event_id % 3 = 0 OR value > 50) UNION ALL SELECT 'a' || event_id, 'percent' FROM events WHERE value < 0 OR value > 100",
    "fingerprint_redaction": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cpu_model,opencv' ELSE 'cpu_model,cv2_module,kleidicv,opencv' END AS keys, CASE WHEN p_partkey % 2 <> 0 THEN 'yes' END AS kleidicv FROM part",
    "map_colours": f"WITH e AS (SELECT event_id, greatest(0.0, least(1.0, coalesce(CASE WHEN event_id % 50 > 0 THEN value / 100 END, 0.0))) * 8 AS x FROM events), k AS (SELECT *, least(floor(x), 7)::INT AS k FROM e) SELECT event_id, '#' || {_MIX.format(i=_CHANNEL(0))} || {_MIX.format(i=_CHANNEL(2))} || {_MIX.format(i=_CHANNEL(4))} AS colour FROM k",
    "figures_with_units": "SELECT p_partkey, printf('%.3f', p_size / 8.0::DOUBLE) || ' ms' AS shown FROM part",
    "probes_rollup": "SELECT event_id % 7 AS round, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ROLLUP (event_id % 7, event_type)",
    "probes_cube": "SELECT event_id % 3 AS machine, event_type, count(DISTINCT user_id) AS runs FROM events GROUP BY CUBE (event_id % 3, event_type)",
    "decision_numbers": "SELECT conv_id AS run_id, (row_number() OVER w + 3)::INT AS seq, printf('0000-agent-%03d', row_number() OVER w + 3) AS decision_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)",
    "wave_select": "SELECT user_id AS run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events) WHERE idx = 4",
}
