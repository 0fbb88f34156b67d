"""Text of runs and reports, sensor noise, whole costs, and measures of frames through the operators themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from edgefield.functions import geometry as G
from edgefield.functions import text as T
from edgefield.operators import ledgers as L
from edgefield.operators import measures
from edgefield.sources.tables import table


def _markdown(spark, d):
    """A page of text for each part: a heading, limitations, figures with and without a source. Parts are dealt evenly first: a small file
    holds many, and reading a page takes far longer than sending its part."""
    n, k = F.col("p_size"), F.col("p_partkey")
    text = F.concat(
        F.lit("# Part\n2. **not yet** one\n"), F.when(k % 3 > 0, "## Known limitations\n").otherwise("## Others\n"), F.lit("1. **Only `p"), k.cast("string"), F.lit("`   of\tthem** and 1.25 more\n"),
        F.when(k % 2 == 0, F.concat(F.lit("2. **Size "), n.cast("string"), F.lit("** was 3.75 ms\n"))).otherwise(""), F.lit("took "), n.cast("string"), F.lit(".5 ms <!-- bench:a.b["), (k % 5).cast("string"), F.lit("].v --> and 1,"), F.lpad(n.cast("string"), 3, "0"),
        F.lit(" <!--bench:n-->\n`2.5\n2.75` or "), n.cast("string"), F.lit(".125\n<!-- 9.5\n-->6.5 v1.2.3"),
    )
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(k.alias("doc_id"), text.alias("text"))


def limitations(spark, d):
    """The limitations that each page names."""
    return _markdown(spark, d).select("doc_id", F.posexplode(T.limitations(F.col("text"))).alias("place", "limitation"))


def cited_figures(spark, d):
    """Figures of each page with the unit and the source that stand beside them."""
    return _markdown(spark, d).select("doc_id", F.explode(T.cited_figures(F.col("text"))).alias("f")).select("doc_id", "f.value", "f.unit", "f.path")


def uncited_figures(spark, d):
    """Decimals of each page without a source, with their lines."""
    return _markdown(spark, d).select("doc_id", F.explode(T.uncited_figures(F.col("text"))).alias("f")).select("doc_id", "f.line", "f.figure")


def decision_trace(spark, d):
    """A line for every decision of a run."""
    e, k = table(spark, d, "events"), F.pmod("event_id", F.lit(5)).cast("int")
    tool = F.element_at(F.array(*map(F.lit, ("explain_failure", "agent.model_call", "reallocate_budget", "prioritize_axes", "get_envelope"))), k + 1)
    detail = T.trace_detail(tool, F.col("event_id"), F.floor("value") / 50.0, F.floor("value") / 25.0, F.floor("value").cast("int"), F.array(F.col("event_type"), F.lit("fog")), F.when(F.col("value") < 50, "order_applied").otherwise("over_budget"), F.col("event_type"))
    return e.select("event_id", T.trace_line(F.format_string("%04d-agent", "user_id"), tool, F.col("value") < 50, detail).alias("line"))


def probe_commands(spark, d):
    """Commands that repeat a probe: by its conditions, and for a worker with what is pinned."""
    e = table(spark, d, "events")
    condition = F.create_map(F.lit("motion_blur.exposure_ms"), F.pmod("event_id", F.lit(40)).cast("string"), F.lit("fog.beta_per_m"), F.concat(F.lit("0.0"), F.pmod("event_id", F.lit(9)).cast("string")))
    fixed = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("low_light.exposure_ms"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select("event_id", T.set_command(condition, F.col("user_id")).alias("command"), T.worker_command(condition, fixed, F.lit("road"), F.col("event_type"), F.lit(100), F.col("user_id")).alias("worker"))


def sensor_noise(spark, d):
    """Signal, shot noise and modelled ratio of a mid-grey patch, and the shift of a row, for the light and exposure of each event."""
    e = table(spark, d, "events").withColumn("ms", F.pmod("event_id", F.lit(40)) + 1.0)
    signal = G.signal_electrons(F.col("value") * 4, F.col("ms"))
    row = G.shift_per_row(G.row_shift_px(F.col("ms"), F.lit(60.0)), F.pmod("event_id", F.lit(3)) * 360)
    return e.select("event_id", F.round(signal, 6).alias("signal_e"), F.round(G.shot_noise(signal), 6).alias("shot_e"), F.round(G.modelled_snr_db(signal), 6).alias("snr_db"), F.round(row, 9).alias("row_px"))


def whole_run_cost(spark, d):
    """Tasks, functions, transitions and model calls of every run; runs without the latter have tasks only."""
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("machine"), (F.col("l_quantity") * 4).alias("seconds"), F.lit(2).alias("vcpu"), F.lit(4).alias("gb"))
    prices = spark.createDataFrame([("A", 0.04048, 0.004445), ("N", 0.03238, 0.00356), ("R", 0.03, 0.003)], "machine string, vcpu_hour double, gb_hour double")
    extras = table(spark, d, "orders").where("o_orderkey % 3 > 0").groupBy(F.col("o_orderkey").alias("run_id")).agg((F.count("*") * 512.0).alias("gb_seconds"), (F.count("*") * 40).alias("requests"), F.sum(F.pmod("o_custkey", F.lit(50))).alias("transitions"), (F.sum(F.pmod("o_custkey", F.lit(7))) / 100.0).alias("model_usd"))
    return L.run_costs(tasks, prices, extras).select("run_id", "tasks", *[F.round(c, 6).alias(c) for c in ("billed_s", "task_usd", "function_usd", "transition_usd", "model_usd", "total_usd")])


def tiles(spark, d):
    """Every embedding as a grey frame of 8 x 8."""

    def run(batches):
        for batch in batches:
            at = 400 * batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64)
            pixels = np.repeat(np.clip(np.floor(128 + at), 0, 255).astype(np.uint8), 3, axis=1)
            n, side = len(pixels), pa.array(np.full(len(pixels), 8, np.int32))
            ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 192)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), side, side, pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(pixels)])], ["image_id", "height", "width", "pixels"])

    return table(spark, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) = 64").select("vec_id", "embedding").mapInArrow(run, "image_id long, height int, width int, pixels binary")


def tile_measures(spark, d):
    """The operator's own measures of every frame."""
    out = measures.measure(tiles(spark, d), ["image_id"])
    return out.select("image_id", F.round("laplacian_var", 6).alias("laplacian_var"), F.round("rms_contrast", 6).alias("rms_contrast"), F.round("mean_level", 6).alias("mean_level"))


def tile_luminance(spark, d):
    """Every frame at half its size, and the mean linear luminance of that."""
    out = measures.prepared(tiles(spark, d), 4)
    return out.select("image_id", "height", "width", F.round("mean_linear", 6).alias("mean_linear"))


TILE = "t AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + 400 * v::DOUBLE)))::DOUBLE) AS g FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64)"
QUERIES = {f.__name__: f for f in (limitations, cited_figures, uncited_figures, decision_trace, probe_commands, sensor_noise, whole_run_cost, tile_measures, tile_luminance)}
SQL = {
    "limitations": "SELECT p_partkey AS doc_id, 0::INT AS place, 'Only p' || p_partkey || ' of them' AS limitation FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 1, 'Size ' || p_size FROM part WHERE p_partkey % 6 IN (2, 4)",
    "cited_figures": "SELECT p_partkey AS doc_id, p_size + 0.5::DOUBLE AS value, 'ms' AS unit, 'a.b[' || (p_partkey % 5) || '].v' AS path FROM part UNION ALL SELECT p_partkey, (1000 + p_size)::DOUBLE, NULL, 'n' FROM part",
    "uncited_figures": "WITH l AS (SELECT p_partkey AS doc_id, p_size, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5 END AS took FROM part) SELECT doc_id, 4::INT AS line, '1.25' AS figure FROM l UNION ALL SELECT doc_id, 5, '3.75' FROM l WHERE took = 6 UNION ALL SELECT doc_id, took + 2, p_size || '.125' FROM l UNION ALL SELECT doc_id, took + 4, '6.5' FROM l",
    "decision_trace": """WITH e AS (SELECT *, ['explain_failure', 'agent.model_call', 'reallocate_budget', 'prioritize_axes', 'get_envelope'][event_id % 5 + 1] AS tool, floor(value) AS v, CASE WHEN value < 50 THEN 'order_applied' ELSE 'over_budget' END AS reason FROM events)
SELECT event_id, rpad(printf('%04d-agent', user_id), 16, ' ') || ' ' || rpad(tool, 24, ' ') || ' ' || CASE WHEN value < 50 THEN 'accepted' ELSE 'REFUSED ' END || CASE event_id % 5 WHEN 0 THEN ' facts for ' || event_type
  WHEN 1 THEN printf(' call %d: charged $%.4f, contract left $%.4f', event_id, v / 50, v / 25) WHEN 2 THEN printf(' %d probes split -> %s', v::INT, reason) WHEN 3 THEN ' order ' || event_type || ',fog -> ' || reason ELSE '' END AS line FROM e""",
    "probe_commands": "SELECT event_id, c AS command, c || CASE WHEN event_id % 2 = 0 THEN ' --fix low_light.exposure_ms=' || user_id ELSE '' END || ' --dataset road --pipeline ' || event_type || ' --frames 100' AS worker FROM (SELECT *, printf('edgefield probe --set fog.beta_per_m=0.0%d motion_blur.exposure_ms=%d --seed %d', event_id % 9, event_id % 40, user_id) AS c FROM events)",
    "sensor_noise": "WITH e AS (SELECT event_id, value * 4 * (event_id % 40 + 1) * 180 / 1000 AS s, event_id % 40 + 1.0::DOUBLE AS ms FROM events) SELECT event_id, round(s, 6) AS signal_e, round(sqrt(s / 2), 6) AS shot_e, round(20 * log10(greatest(s / 2, 1e-9) / sqrt(s / 2 + 4)), 6) AS snr_db, round(900 * tan(radians(60 * ms / 1000)) / nullif(event_id % 3 * 360, 0), 9) AS row_px FROM e",
    "whole_run_cost": """WITH t AS (SELECT l_orderkey AS run_id, count(*) AS tasks, sum(greatest(l_quantity * 4, 60.0)) AS billed_s, sum(greatest(l_quantity * 4, 60.0) / 3600.0::DOUBLE * (2 * v::DOUBLE + 4 * g::DOUBLE)) AS task_usd FROM lineitem JOIN (VALUES ('A', 0.04048, 0.004445), ('N', 0.03238, 0.00356), ('R', 0.03, 0.003)) p(machine, v, g) ON machine = l_returnflag GROUP BY 1),
x AS (SELECT o_orderkey AS run_id, count(*) * (512 * 0.0000133334::DOUBLE + 40 * 0.0000002::DOUBLE) AS f, sum(o_custkey % 50) * 0.000025::DOUBLE AS s, sum(o_custkey % 7) / 100.0::DOUBLE AS m FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1)
SELECT run_id, tasks, round(billed_s::DOUBLE, 6) AS billed_s, round(task_usd, 6) AS task_usd, round(coalesce(f, 0), 6) AS function_usd, round(coalesce(s, 0), 6) AS transition_usd, round(coalesce(m, 0), 6) AS model_usd, round(task_usd + coalesce(f, 0) + coalesce(s, 0) + coalesce(m, 0), 6) AS total_usd FROM t LEFT JOIN x USING (run_id)""",
    "tile_measures": f"""WITH {TILE}, p AS (SELECT image_id, g, i, i // 8 AS y, i % 8 AS x FROM t, range(64) r(i)),
l AS (SELECT image_id, g[i + 1] AS v, g[8 * y + abs(x - 1) + 1] + g[8 * y + 7 - abs(6 - x) + 1] + g[8 * abs(y - 1) + x + 1] + g[8 * (7 - abs(6 - y)) + x + 1] - 4 * g[i + 1] AS l FROM p)
SELECT image_id, round((64 * sum(l * l) - sum(l) * sum(l)) / 4096.0::DOUBLE, 6) AS laplacian_var, round(sqrt((64 * sum(v * v) - sum(v) * sum(v)) / 4096.0::DOUBLE), 6) AS rms_contrast, round(sum(v) / 64, 6) AS mean_level FROM l GROUP BY 1""",
    "tile_luminance": f"WITH {TILE}, b AS (SELECT image_id, round_even((g[16 * y + 2 * x + 1] + g[16 * y + 2 * x + 2] + g[16 * y + 2 * x + 9] + g[16 * y + 2 * x + 10]) / 4, 0) AS v FROM t, range(4) a(y), range(4) c(x)) SELECT image_id, 4::INT AS height, 4::INT AS width, round(avg(pow(v / 255.0::DOUBLE, 2.2::DOUBLE)), 6) AS mean_linear FROM b GROUP BY 1",
}
