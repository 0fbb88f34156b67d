"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgefield.llm import embeddings, langid, matroska, minhash, mixing, negatives, packing, secrets, sharding, substrings, toxicity, turns, urls
from edgefield.llm._common import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not as SQL: a learned model; held-out accuracy is tested."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs, model).withColumn("n_offending", F.size("sentences").cast("long"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHash(shingle=4))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not as SQL: a learned model; held-out accuracy is tested."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predicted(docs, langid.learn(docs))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id, k.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.doc_id = d.doc_id
"""


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not as SQL: files are written and parsed; round trips are tested."""
    return matroska.digests(matroska.stored(table(spark, sf_dir, "documents")))


#: Languages and forms have stated weights, the rest of forms 0.15 together; sources are evened out.
OP6_MIX = mixing.Mix(targets={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.8, "list": 0.05}})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), OP6_MIX)
    level = lambda d: F.coalesce(d, F.lit(mixing.NONE)).alias(d)
    return out.select("doc_id", level("source"), level("lang"), "topic", "tokens", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not as SQL: the battery of tests and its cut-offs are held against a brute-force version in the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.find_secrets(docs, keep=["doc_id"]))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.with_digest(packing.tokenized_pieces(table(spark, sf_dir, "documents"))))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not as SQL: the trees are learned step by step; rules, hosts and paths are held against a plain version in the tests."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


OP10_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM g JOIN f USING (k) WHERE m < doc_id)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label))


OP11_SQL = """
WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, len(embedding) AS size
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM f a JOIN f b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id AND a.size = b.size),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return turns.digests(original, turns.repaired(turns.damaged(original)))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_matroska": op5_matroska,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_dedup": OP3_SQL,
    "op6_mixing": mixing.oracle(OP6_MIX),
    "op10_substring_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_conversation_repair": turns.ORACLE_SQL,
    "op13_sharding": sharding.oracle(),
}
