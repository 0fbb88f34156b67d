"""Figures cited in texts, held against the value at the path that each names.

Recorded results are JSON of any shape. A file becomes one row for each value in it, its path beside it, level by level: the
objects and arrays of a level are exploded and what they hold is the next one. Citations meet those rows by file and path, so a
citation costs one row of an equi-join, whatever the size of its file, and files that no text cites are not opened up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.functions import text as T
from edgefield.sources.shared import written

SHARE = 0.005  # texts round: a figure may be off by this share of the value
FINE, NO_FILE, NO_VALUE, DIFFERS = "fine", "no such file", "no number there", "another value"


def flattened(files: DataFrame) -> DataFrame:
    """files: file, body (JSON as text). One row for each value that is neither object nor array: file, path, value (null for what is
    no number; a text that reads as one counts), kind.

    Paths are keys joined by dots, with [i] for the places of an array, from 0. A name that holds a dot or a bracket cannot be
    said in a path: what is below it gets no row. A body that is no JSON gets none either. There is one job for each level of nesting."""
    spark = files.sparkSession
    is_open = F.col("shape").rlike("^(OBJECT|ARRAY)")
    level = written(files.select("file", F.lit("").alias("path"), F.try_parse_json("body").alias("v")).where("v IS NOT NULL").withColumn("shape", F.schema_of_variant("v")), "level")
    found = []
    while True:
        value = F.coalesce(F.try_variant_get("v", "$", "double"), F.try_variant_get("v", "$", "boolean").cast("double"))
        found.append(level.where(~is_open).select("file", "path", value.alias("value"), F.lower("shape").alias("kind")))
        open_ = level.where(is_open)
        if open_.isEmpty():
            break
        inner = open_.select("file", "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(F.col("key").isNull() | ~F.col("key").rlike(r"[.\[\]]"))
        step = F.when(F.col("key").isNull(), F.format_string("[%d]", "pos")).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))
        level = written(inner.select("file", F.concat("path", step).alias("path"), F.col("value").alias("v"), F.schema_of_variant("value").alias("shape")), "level")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cited(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row for each citation: doc_id, line (from 1), cited, unit, file, path within the file, source (both, as written)."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.transform(T.cited_figures(x), lambda c: F.struct((i + 1).alias("line"), c["value"].alias("cited"), c["unit"].alias("unit"), c["path"].alias("source"))))
    rows = docs.select("doc_id", F.explode(F.flatten(lines)).alias("c")).select("doc_id", "c.*")
    file = F.regexp_extract("source", r"^[^.\[]*", 0)
    return rows.withColumn("file", file).withColumn("path", F.regexp_replace(F.substr("source", F.length(file) + 1), r"^\.", ""))


def checked(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Every citation with the value it names and what is wrong with it, if anything: doc_id, line, source, cited, actual, verdict.

    A null text cites nothing; a text without citations gives no row. Of files that share a name the values of all are compared, and a
    citation is fine if one of them is; files with a null name or body count for nothing. Long texts are split into lines in place."""
    claims = written(cited(docs), "citations")
    named = claims.select("file").distinct()
    there = files.where("file IS NOT NULL AND body IS NOT NULL").join(named, "file", "left_semi")
    wanted = claims.select("file", "path").distinct()
    values = flattened(there).join(wanted, ["file", "path"], "left_semi").where("value IS NOT NULL").groupBy("file", "path").agg(F.array_sort(F.collect_set("value")).alias("values"))
    known = there.select("file").distinct().withColumn("known", F.lit(True))
    off = lambda v: F.abs(v - F.col("cited")) / F.greatest(F.abs(v), F.lit(1e-9))
    nearest = F.array_min(F.transform("values", lambda v: F.struct(off(v).alias("off"), v.alias("v"))))
    out = claims.join(known, "file", "left").join(values, ["file", "path"], "left").withColumn("near", nearest)
    verdict = F.when(F.col("known").isNull(), NO_FILE).when(F.col("near").isNull(), NO_VALUE).when((F.col("near.off") <= SHARE), FINE).otherwise(DIFFERS)
    return out.select("doc_id", "line", "source", "cited", F.col("near.v").alias("actual"), verdict.alias("verdict"))
