"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence's probability is logistic in its words; a document is toxic if any sentence is, or by a leak that covers what
words do not show: P = 1 - (1 - leak) * product(1 - p of each sentence), a noisy-or. Weights, bias and leak are learned from
document labels alone. Sentences at 0.5 and above are located in the text.

Learning sees a bounded sample of labelled documents, drawn by a hash of the id, half of them toxic if there are so many. Words
that tell the classes apart are picked by counts on Spark; one task learns from the sample's (sentence, word) pairs, and the driver
gets the words and their weights only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import forget, is_held_out, lean, written
from edgefield.llm._words import PLAIN, Words, words

_ENDS = np.zeros(256, bool)
_ENDS[[10, 13, 33, 46, 63]] = True  # line ends, ! . ?


class Learning(NamedTuple):
    sample: int = 12_000  # labelled documents, at most about
    vocabulary: int = 4096  # words, at most
    least_toxic: int = 4  # toxic documents that a word must stand in
    least_z: float = 4.0  # of a word's log-odds
    rounds: int = 400
    ridge: float = 1e-4
    slice_rows: int = 1000


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    leak: float


def _sentences(w: Words) -> np.ndarray:
    """A number for each word's sentence; it rises, and no sentence crosses documents."""
    ends = np.flatnonzero(_ENDS[w.data])
    at = np.searchsorted(ends, w.start)
    new = np.r_[True, (at[1:] != at[:-1]) | (w.row[1:] != w.row[:-1])] if len(at) else np.zeros(0, bool)
    return np.cumsum(new) - 1


def _seen(p: Learning):
    """Each document's distinct words."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, p.slice_rows):
                part = batch.slice(lo, p.slice_rows)
                w = words(part.column("text"), lower=True, space=PLAIN)
                bounds = w.first_of_row()
                one = [np.unique(w.hash[a:b]).view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "words": pa.array(one, pa.list_(pa.int64()))})

    return run


def _instances(p: Learning, vocabulary: np.ndarray):
    """For each document, (sentence, word number) of the vocabulary's words in it, each pair once."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, p.slice_rows):
                part = batch.slice(lo, p.slice_rows)
                w = words(part.column("text"), lower=True, space=PLAIN)
                sentence = _sentences(w)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), max(0, len(vocabulary) - 1))
                known = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) and len(at) else np.zeros(0, np.int64)
                _, first = np.unique(sentence[known] * max(1, len(vocabulary)) + at[known], return_index=True)
                known = known[first]  # by sentence, and so by document
                cuts = np.searchsorted(w.row[known], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[known].astype(np.int32))) for x in (sentence, at)]
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "sentence": lists[0], "word": lists[1]})

    return run


def _train(toxic: np.ndarray, bag_of: np.ndarray, inst: np.ndarray, term: np.ndarray, size: int, p: Learning) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by Adam on the noisy-or likelihood. bag_of: each sentence's document; inst, term: the pairs' sentences and words."""
    n = len(bag_of)
    y = toxic.astype(float)
    share = float(np.clip(y.mean(), 1e-3, 0.5))
    theta = np.zeros(size + 2)
    theta[size], theta[size + 1] = -4.0, np.log(share * 0.3 / (1 - share * 0.3))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, p.rounds + 1):
        z = theta[size] + np.bincount(inst, theta[term], minlength=n)
        ps, leak = logistic(z), logistic(theta[size + 1])
        log_q = np.log1p(-leak) + np.bincount(bag_of, np.log1p(-np.minimum(ps, 1 - 1e-9)), minlength=len(y))
        q = np.exp(log_q)
        pull = (1 - y) - y * q / np.maximum(1 - q, 1e-9)
        dz = ps * pull[bag_of] if n else np.zeros(0)
        g = np.zeros_like(theta)
        g[:size] = np.bincount(term, dz[inst], minlength=size) / len(y) + p.ridge * theta[:size]
        g[size] = dz.sum() / len(y)
        g[size + 1] = leak * pull.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[size] = min(theta[size], -2.0)
    return theta[:size], float(theta[size]), float(logistic(theta[size + 1]))


def learn(docs: DataFrame, labels: DataFrame, p: Learning = Learning()) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1). Rows whose id hashes to the held-out fifth teach nothing.

    A document with several labels has the largest. Without labelled documents of both kinds nothing is learned: the score is the
    smoothed share of toxic labels for every text."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = (ones + 0.5) / (ones + zeros + 5.0)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, share)
    if not ones or not zeros:
        return nothing
    take = F.when(F.col("toxic") == 1, min(1.0, p.sample / 2 / ones)).otherwise(min(1.0, p.sample / 2 / zeros))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < take * (1 << 20))
    # p.sample ids at most about: the bound of this broadcast
    texts = written(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text"), "labelled")
    seen = texts.mapInArrow(lean(_seen(p)), "toxic int, words array<long>")
    by_word = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= p.least_toxic)
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        forget(texts)
        return nothing
    a, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    z = (F.log(a / (n1 - F.col("t") + 0.5)) - F.log(c / (F.lit(n0) - (F.col("n") - F.col("t")) + 0.5))) / F.sqrt(1 / a + 1 / c)
    picked = by_word.withColumn("z", z).where(F.col("z") >= p.least_z).orderBy(F.desc("z"), "word").limit(p.vocabulary).collect()
    vocabulary = np.sort(np.array([r["word"] for r in picked], np.int64).view(np.uint64))

    def fitted(rows: pa.Table) -> pa.Table:
        """The weights, then bias and leak, from the whole sample, which p.sample bounds."""
        sentence, word = (rows.column(c).combine_chunks() for c in ("sentence", "word"))
        document = np.repeat(np.arange(rows.num_rows), np.diff(sentence.offsets.to_numpy()))
        key = document << 32 | sentence.flatten().to_numpy()
        own, inst = np.unique(key, return_inverse=True)
        weights, bias, leak = _train(rows.column("toxic").to_numpy(), own >> 32, inst, word.flatten().to_numpy(), len(vocabulary), p)
        return pa.table({"i": pa.array(range(len(weights) + 2), pa.int32()), "v": pa.array([*weights, bias, leak], pa.float64())})

    rows = texts.mapInArrow(lean(_instances(p, vocabulary)), "toxic int, sentence array<int>, word array<int>")
    *weights, bias, leak = (r["v"] for r in rows.groupBy().applyInArrow(fitted, "i int, v double").orderBy("i").collect())
    forget(texts)
    # the sample's classes are not in their proportion; the leak is set to what is, where no word shows
    odds = leak / (1 - leak) * (ones / zeros) / (n1 / n0)
    return Model(vocabulary, np.array(weights), bias, float(odds / (1 + odds)))


def _scored(model: Model, p: Learning):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, p.slice_rows):
                part = batch.slice(lo, p.slice_rows)
                n = part.num_rows
                w = words(part.column("text"), lower=True, space=PLAIN)
                log_q = np.full(n, np.log1p(-model.leak))
                found: list[list] = [[] for _ in range(n)]
                at = np.minimum(np.searchsorted(model.words, w.hash), max(0, len(model.words) - 1))
                hit = np.flatnonzero(model.words[at] == w.hash) if len(model.words) and len(at) else np.zeros(0, np.int64)
                if len(hit):
                    sentence = _sentences(w)
                    pair = np.unique(np.stack([sentence[hit], at[hit]]), axis=1)  # a word counts once in a sentence
                    ids, first = np.unique(pair[0], return_index=True)
                    ps = 1 / (1 + np.exp(-(model.bias + np.add.reduceat(model.weights[pair[1]], first))))
                    begins = np.searchsorted(sentence, ids)
                    ends = np.searchsorted(sentence, ids, "right") - 1
                    rows = w.row[begins]
                    np.add.at(log_q, rows, np.log1p(-np.minimum(ps, 1 - 1e-9)))
                    for i in np.flatnonzero(ps >= 0.5).tolist():
                        row = int(rows[i])
                        b = w.data[w.offsets[row] : w.offsets[row + 1]]
                        chars = lambda to: int(((b[: to - w.offsets[row]] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                        found[row].append({"start": chars(w.start[begins[i]]), "stop": chars(w.end[ends[i]]), "score": float(ps[i])})
                score = 1 - np.exp(log_q)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(np.clip(score, 0, 1)), "sentences": pa.array(found, kind)})

    return run


def scored(docs: DataFrame, model: Model, p: Learning = Learning()) -> DataFrame:
    """docs: doc_id, text. One row for each row: doc_id, held_out, score, predicted, sentences (start, stop in code points, score).

    A null or empty text scores the leak. Repeated texts score alike. A null doc_id counts as held out. Columns besides doc_id
    and text are not looked at. No rows give no rows."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scored(model, p)), "doc_id long, score double, sentences array<struct<start:long,stop:long,score:double>>")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
