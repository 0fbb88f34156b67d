"""A corpus from raw documents to packed sequences: five stages, each applying one operator to all that the one before kept.

Stages take documents (doc_id, text, lang, source, n_chars and any others) and return their columns, the last one pieces. For all
of them: no rows give no rows; a null column besides those named below changes nothing; columns whose names clash with those of
an operator come through as they are; texts are read whole, however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgefield.llm import langid, minhash, mixing, packing, secrets
from edgefield.llm._common import forget, set_aside, table, written

LEAST_LANGUAGE_SCORE = 0.25  # below it a document's language is not known well enough to keep the document
MIX = mixing.Mix(share=0.7, targets={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}})  # of the tokens that reach mixing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, in none of the languages learned, or whose language is quite unsure, go; the others get the predicted
    language. With two families of two languages the score is never below its bound, and only the first two send documents away.

    Null and empty texts have no letter and go. Equal texts share their fate, whatever their ids; a null id teaches nothing.
    Where no row has a language nothing is learned and all go."""
    slim, back = set_aside(docs, "doc_id", "text", "lang")
    out = langid.annotated(slim, langid.learn(slim), judge=True)
    kept = out.where(F.col("familiar") & (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return back(kept.withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Of rows that repeat an id with equal texts one stays, whichever it is; an id's different texts stay or go together. Rows without an
    id are near copies of nothing, but of those with equal texts one stays. Null and empty texts have no copies."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.isEmpty():
        forget(again)
        return out
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays, repeated rows too. A null text stays null, an empty one empty; n_chars follows."""
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that languages meet their stated weights, and sources and forms are evened out.

    Nulls are levels of their own. Documents without words weigh nothing and stay. Repeated ids share their draw."""
    slim, back = set_aside(docs, "doc_id", "text", "source", "lang")
    return back(mixing.mixed(slim, MIX).where("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the sequences. A null or empty text is the end id alone; repeated rows have places of their own."""
    return packing.packed(packing.with_digest(packing.tokenized_pieces(docs)))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: SQL cannot express the learned language stage; the others are held against plain versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        then = written(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = then
    return STAGES[-1][1](spark, docs, sf_dir)
