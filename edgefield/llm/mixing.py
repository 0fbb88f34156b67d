"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed up to cells of source, language and topic, weighted by their tokens (words). Targets are weights of levels:
those a caller states, and for all others the present share to a power. Cell weights are raked in turn to the target marginals of
the three, until a sweep finds no marginal further off than the tolerance. A document's calibrated probability is its cell's raked weight by its present one, scaled so that the expected
tokens make the wanted share of all, and at most 1. A document is drawn by a hash of its id, so a rerun, or the loss of an
executor, draws the same ones.

Everything iterative works on the cells, and a sweep is one job; sums are by groupBy, so that a level with any share of the cells is
summed up before it is shuffled. The documents are read twice, once to be summed up and once to be drawn.

What cannot be met is told by report(): a stated level that the corpus lacks has its weight spread over the others; marginals that no
weights satisfy together (as when two levels only occur together) leave what is off after the last sweep; and where the draw
asks for more of a cell than there is, all of it is drawn and the expected share stays below the target.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import forget, written

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"  # the level of nulls


class Mix(NamedTuple):
    share: float = 0.5  # of all tokens that the draw is to have
    targets: dict[str, dict[str, float]] = {}  # of a dimension: weights of levels, at most 1 together; the other levels share the rest
    tempers: tuple[float, float, float] = (0.5, 0.7, 0.7)  # levels without a stated weight are weighed by their present tokens to this power
    tolerance: float = 1e-6  # of a marginal's share
    sweeps: int = 60  # at most, for marginals that cannot be met
    seed: str = "mix-1"

    def check(self) -> None:
        for d, weights in self.targets.items():
            if d not in DIMENSIONS or any(w < 0 for w in weights.values()) or not 0 < sum(weights.values()) <= 1 + 1e-9:
                raise ValueError(f"weights of {d} are not negative, and more than 0 and at most 1 together")
        if not 0 < self.share <= 1:
            raise ValueError("a share is more than 0 and at most 1")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A document's form, for tables that hold no topic of their own: by how often marks occur for a word."""
    text = F.coalesce(text, F.lit(""))
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return (
        F.when(tokens == 0, "empty")
        .when(count("|") * 4 >= tokens, "table")
        .when(count("!") * 2 >= tokens, "shout")
        .when((count("#") + count("$") + count("%") + count("&") + count("*")) * 2 >= tokens, "noise")
        .when(count("\n") * 12 >= tokens, "list")
        .otherwise("prose")
    )


def _levels(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) if d in docs.columns else F.lit(NONE).alias(d) for d in DIMENSIONS]


def _targets(cells: DataFrame, d: str, temper: float, stated: dict[str, float], total: float) -> DataFrame:
    """Each level of a dimension with the tokens that it is to have."""
    weight = F.lit(None).cast("double")
    if stated:
        weight = F.try_element_at(F.create_map(*[F.lit(x) for k, w in stated.items() for x in (k, float(w))]), F.col(d))
    levels = cells.groupBy(d).agg(F.sum("t").alias("t")).select(d, F.pow("t", F.lit(temper)).alias("p"), weight.alias("weight"))
    listed, others = levels.agg(F.sum("weight"), F.sum(F.when(F.col("weight").isNull(), F.col("p")))).first()
    rest = max(0.0, 1.0 - sum(stated.values())) if listed else 1.0
    raw = F.coalesce("weight", F.col("p") * (rest / others if others else 0.0))
    whole = (listed or 0.0) + (rest if others else 0.0)
    return levels.select(d, (raw / whole * total).alias(f"m_{d}"))


def cells(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows: source, lang, topic (not null), tokens. One row for each cell: its tokens t, raked weight w and m_source, m_lang and
    m_topic, the tokens that its levels are to have."""
    mix.check()
    present = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0"), "cells")
    total = present.agg(F.sum("t")).first()[0]
    if total is None:
        return present.withColumns({"w": F.col("t"), **{f"m_{d}": F.col("t") for d in DIMENSIONS}})
    now = present
    for d, temper in zip(DIMENSIONS, mix.tempers):
        now = now.join(_targets(present, d, temper, mix.targets.get(d, {}), total), d)
    now = written(now.withColumn("w", F.col("t")), "raked")
    forget(present)
    for _ in range(mix.sweeps):
        then = now
        for d in DIMENSIONS:
            sums = then.groupBy(d).agg(F.sum("w").alias("s"))
            raked = F.when(F.col("s") > 0, F.col("w") * F.col(f"m_{d}") / F.col("s")).otherwise(0.0)
            then = then.join(sums, d).withColumns({f"off_{d}": F.abs(F.col("s") - F.col(f"m_{d}")), "w": raked}).drop("s")
        then = written(then, "raked")
        off = then.agg(F.max(F.greatest(*[f"off_{d}" for d in DIMENSIONS]))).first()[0] / total
        forget(now)
        now = then.drop(*[f"off_{d}" for d in DIMENSIONS])
        now._written_path = then._written_path
        if off <= mix.tolerance:
            break
    return now


def scale(fitted: DataFrame, mix: Mix) -> float:
    """What the factors w / t are multiplied by, so that probabilities of at most 1 draw the wanted share of the tokens.

    Cells held at 1 only become more; it ends when no more are. If all that has a weight is held, the draw has less than the share."""
    total = fitted.agg(F.sum("t")).first()[0]
    if total is None:
        return 1.0
    factor, out, before = F.col("w") / F.col("t"), mix.share, -1
    while True:
        held = F.lit(out) * factor >= 1
        n, full, free = fitted.agg(F.count_if(held), F.sum(F.when(held, F.col("t")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("w")))).first()
        if n == before or not free:
            return out
        before = n
        out = max(out, (mix.share * total - full) / free)


def report(fitted: DataFrame, mix: Mix) -> DataFrame:
    """How the mix came out: for each dimension and level its present, target, raked and expected share, and how far off raking is.

    fitted is what cells() returns. Levels that are stated and absent have no row."""
    by = scale(fitted, mix)
    drawn = F.col("t") * F.least(F.lit(1.0), F.lit(by) * F.col("w") / F.col("t"))
    totals = fitted.agg(F.sum("t").alias("_t"), F.sum("w").alias("_w"), F.sum(drawn).alias("_e"))  # one row
    out = None
    for d in DIMENSIONS:
        rows = fitted.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("level")).agg(F.sum("t").alias("t"), F.max(f"m_{d}").alias("m"), F.sum("w").alias("w"), F.sum(drawn).alias("e"))
        out = rows if out is None else out.unionByName(rows)
    shares = out.crossJoin(F.broadcast(totals)).select("dimension", "level", (F.col("t") / F.col("_t")).alias("present"), (F.col("m") / F.col("_t")).alias("target"), (F.col("w") / F.col("_w")).alias("raked"), (F.col("e") / F.col("_e")).alias("expected"))
    return shares.withColumn("off", F.abs(F.col("raked") - F.col("target")))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs: doc_id, text, source, lang, and topic if there is one. Adds topic, tokens, factor, probability and kept to docs.

    A null level is a level of its own, and so is a missing column. Documents without words weigh nothing: factor 1, probability 1.
    A null doc_id is drawn like the empty string. Repeated rows share their fate. Columns of docs named tokens, factor,
    probability or kept are replaced; others come through. No rows give no rows."""
    docs = docs.drop("tokens", "factor", "probability", "kept")
    rows = docs.withColumn("tokens", tokens_of(F.col("text")))
    rows = rows.withColumn("topic", F.coalesce(F.col("topic").cast("string"), F.lit(NONE)) if "topic" in docs.columns else topic_of(F.col("text"), F.col("tokens")))
    fitted = cells(rows.select(*_levels(rows), "tokens"), mix)
    by = scale(fitted, mix)
    factors = fitted.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], (F.col("w") / F.col("t")).alias("factor"))
    level = lambda d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) if d in rows.columns else F.lit(NONE)
    on = (level("source") == F.col("_source")) & (level("lang") == F.col("_lang")) & (level("topic") == F.col("_topic")) & (F.col("tokens") > 0)
    out = rows.join(factors, on, "left").drop("_source", "_lang", "_topic").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    out = out.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(by) * F.col("factor"))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return out.withColumn("kept", draw < F.col("probability"))


def oracle(mix: Mix = Mix(), sweeps: int = 20, rounds: int = 8) -> str:
    """The same as SQL over documents, with as many sweeps and rounds written out as these tables need at most."""
    count = lambda m: f"(length(x) - length(replace(x, {m}, '')))"
    topic = (
        f"CASE WHEN tokens = 0 THEN 'empty' WHEN {count(chr(39) + '|' + chr(39))} * 4 >= tokens THEN 'table' WHEN {count(chr(39) + '!' + chr(39))} * 2 >= tokens THEN 'shout' "
        f"WHEN ({' + '.join(count(chr(39) + m + chr(39)) for m in '#$%&*')}) * 2 >= tokens THEN 'noise' WHEN {count('chr(10)')} * 12 >= tokens THEN 'list' ELSE 'prose' END"
    )
    sql = [
        rf"d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents)",
        f"r AS (SELECT doc_id, source, lang, tokens, {topic} AS topic FROM d)",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t FROM r GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for d, temper in zip(DIMENSIONS, mix.tempers):
        stated = mix.targets.get(d, {})
        weight = f"CASE {d} " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in stated.items()) + " END" if stated else "NULL::DOUBLE"
        sql.append(f"p_{d} AS (SELECT {d}, pow(sum(t), {temper}) AS p, {weight} AS weight FROM c GROUP BY {d})")
        rest = f"CASE WHEN max(weight) OVER () IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, {1.0 - sum(stated.values())}::DOUBLE) END"
        sql.append(f"q_{d} AS (SELECT {d}, coalesce(weight, {rest} * p / sum(CASE WHEN weight IS NULL THEN p END) OVER ()) AS m FROM p_{d})")
        sql.append(f"m_{d} AS (SELECT {d}, m / sum(m) OVER () * (SELECT sum(t) FROM c) AS m FROM q_{d})")
    sql.append("w0 AS MATERIALIZED (SELECT c.*, m_source.m AS ms, m_lang.m AS ml, m_topic.m AS mt, t AS w FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))")
    sql.append("o0 AS (SELECT 1.0::DOUBLE AS o)")
    n = 0
    for k in range(sweeps):
        for d, m in zip(DIMENSIONS, ("ms", "ml", "mt")):
            stop = f"(SELECT o FROM o{k}) <= {mix.tolerance}"
            sql.append(f"v{n} AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY {d}) AS s FROM w{n})")
            sql.append(f"w{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (s) REPLACE (CASE WHEN {stop} THEN w WHEN s > 0 THEN w * {m} / s ELSE 0 END AS w) FROM v{n})")
            n += 1
        off = [f"(SELECT max(abs(s - {m})) FROM v{n - 3 + i})" for i, m in enumerate(("ms", "ml", "mt"))]
        sql.append(f"o{k + 1} AS MATERIALIZED (SELECT CASE WHEN (SELECT o FROM o{k}) <= {mix.tolerance} THEN 0 ELSE greatest({', '.join(off)}) / (SELECT sum(t) FROM c) END AS o)")
    sql.append(f"s0 AS (SELECT {mix.share} AS s)")
    for i in range(rounds):
        held = f"(SELECT s FROM s{i}) * (w / t) >= 1"
        sql.append(
            f"s{i + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN {held} THEN 0.0 ELSE w END) > 0 THEN greatest((SELECT s FROM s{i}), ({mix.share} * sum(t) - sum(CASE WHEN {held} THEN t ELSE 0.0 END)) / sum(CASE WHEN {held} THEN 0.0 ELSE w END)) ELSE (SELECT s FROM s{i}) END AS s FROM w{n})"
        )
    sql.append(f"f AS (SELECT r.*, CASE WHEN tokens = 0 THEN 1.0 ELSE w / t END AS factor FROM r LEFT JOIN w{n} USING (source, lang, topic))")
    sql.append(f"p AS (SELECT *, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, (SELECT s FROM s{rounds}) * factor) END AS probability FROM f)")
    return (
        "WITH "
        + ",\n".join(sql)
        + f"\nSELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(factor, 6) AS factor, round(probability, 6) AS probability, ('0x' || substr(md5('{mix.seed}' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < probability AS kept FROM p"
    )
