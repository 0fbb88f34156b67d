"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear support vector machines within it.

Features are frequencies of hashed byte trigrams of the lower-cased text with everything but letters as blanks. Families are
told apart by one-versus-one machines as well; the family with the most votes wins, margins breaking ties, then the language.

Machines tell the known languages apart but say nothing of texts in none of them. For that a text's surprise counts: by how much the
mean information of its trigrams exceeds the entropy of the known language it fits best, less the error of that mean for its
length. Texts with more surprise than the stated share of the sample's own documents, each judged without itself, are
unfamiliar.

Machines learn from a bounded sample of documents with a language, drawn evenly over the languages by a hash of the id; all
texts are read whole, in the sample and when predicting.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgefield.llm._common import is_held_out, lean
from edgefield.llm._words import raw

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "sl", "cs", "sk", "pl"),
}
UNKNOWN = "und"

_SCALE = 1024.0  # of frequencies on their way to the driver as 16-bit floats

_LETTER = np.full(256, 32, np.uint8)  # letters in lower case and bytes of longer characters stay, all else is blank
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


class Learning(NamedTuple):
    sample: int = 6000  # documents, at most about, over all languages
    size: int = 4096  # of the hashed features
    rounds: int = 120
    ridge: float = 1e-3
    keep: float = 0.999  # of the sample's documents that are familiar, at least
    prior: float = 0.05  # weight of evenly spread trigrams against a language's own


class Machine(NamedTuple):
    one: int
    two: int
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    languages: tuple[str, ...]
    families: tuple[tuple[int, ...], ...]  # languages' numbers
    between: tuple[Machine, ...]  # families
    within: tuple[tuple[Machine, ...], ...]
    information: tuple[np.ndarray, ...] = ()  # of each feature, by language
    most: float = np.inf  # surprise of a familiar text


def _trigrams(data: np.ndarray, size: int) -> np.ndarray:
    """The feature of the trigram at each byte; size where it is all blank."""
    b = _LETTER[data].astype(np.uint32)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    out = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) % size
    out[code == 0x202020] = size
    return out


def _slices(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Rows whose texts together have about most bytes."""
    out, lo = [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _padded(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a blank before and two after each, and where each begins."""
    size = np.diff(offsets[lo : hi + 1])
    starts = np.r_[0, np.cumsum(size + 3)]
    out = np.full(starts[-1], 32, np.uint8)
    rows = np.repeat(np.arange(hi - lo), size)
    out[np.arange(offsets[lo], offsets[hi]) - offsets[lo] + 3 * rows + 1] = data[offsets[lo] : offsets[hi]]
    return out, starts


def _histograms(p: Learning):
    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in _slices(offsets):
                b, starts = _padded(data, offsets, lo, hi)
                f = _trigrams(b, p.size)
                rows, counts = [], []
                for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    h = np.bincount(f[a : max(a, e - 2)], minlength=p.size + 1)[: p.size].astype(np.float32)
                    counts.append(int(h.sum()))
                    rows.append((h * (_SCALE / max(1.0, h.sum()))).astype(np.float16).tobytes())
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").slice(lo, hi - lo), "n": pa.array(counts, pa.int64()), "x": pa.array(rows, pa.binary())})

    return run


def _surprise(means: np.ndarray, n: np.ndarray, information: list[np.ndarray] | tuple[np.ndarray, ...]) -> np.ndarray:
    """means: a text's mean information by language; n: its trigrams, three of which share a character."""
    out = np.full(len(n), np.inf)
    for k, w in enumerate(information):
        share = np.exp(-w.astype(np.float64))
        entropy = share @ w
        out = np.minimum(out, means[:, k] - entropy - np.sqrt(3 * max(0.0, share @ (w * w) - entropy**2) / np.maximum(1, n)))
    return out


def _information(x: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int, p: Learning) -> tuple[list[np.ndarray], float]:
    """What each feature tells in each language, and the most surprise of a familiar text; x holds frequencies, a row for each document."""
    sums = [x[lang == k].sum(0, dtype=np.float64) for k in range(languages)]
    counts = [max(1, int((lang == k).sum())) for k in range(languages)]
    bits = lambda total, count, prior: -np.log((total + prior / p.size) / (np.asarray(total).sum(-1, keepdims=True) + prior))
    information = [bits(t, c, p.prior * c).astype(np.float32) for t, c in zip(sums, counts)]
    seen = []
    for lo in range(0, len(x), 256):
        rows = x[lo : lo + 256].astype(np.float64)
        means = np.stack([rows @ w for w in information], 1)
        for k in range(languages):
            own = np.flatnonzero(lang[lo : lo + 256] == k)
            others = np.maximum(0, sums[k] - rows[own])
            means[own, k] = (rows[own] * bits(others, counts[k], p.prior * counts[k])).sum(1)
        some = n[lo : lo + 256] > 0
        seen.append(_surprise(means[some], n[lo : lo + 256][some], information))
    seen = np.concatenate(seen) if seen else np.zeros(0)
    return information, float(np.quantile(seen, p.keep, method="higher")) if len(seen) else np.inf


def _machine(x: np.ndarray, y: np.ndarray, p: Learning) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradients; x is standardised, classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w, b
    rate = 1.0 / (2.0 * max(1e-6, float((weight * (x * x).sum(1)).sum())) / 4 + p.ridge)
    for t in range(1, p.rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * weight * y
        nw, nb = v - rate * (p.ridge * v - 2 * (slack @ x)), vb + rate * 2 * float(slack.sum())
        v, vb = nw + (t - 1) / (t + 2) * (nw - w), nb + (t - 1) / (t + 2) * (nb - b)
        w, b = nw, nb
    return w, b


def learn(docs: DataFrame, p: Learning = Learning(), families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """docs: doc_id, text, lang. Rows of the held-out fifth, null texts and null languages teach nothing.

    A language that families does not list is a family of its own. Without any language every prediction is und."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), (), (), ())
    each = max(1, p.sample // len(languages))
    take = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, each / counts[k]))]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < take * (1 << 20))
    sample = drawn.select("lang", "text").mapInArrow(lean(_histograms(p)), "lang string, n long, x binary")
    listed = {k: name for name, ks in families.items() for k in ks}
    by_family: dict[str, list[int]] = {}
    for i, k in enumerate(languages):
        by_family.setdefault(listed.get(k, f"only {k}"), []).append(i)
    groups = tuple(tuple(v) for _, v in sorted(by_family.items()))

    def fitted(key, rows):
        """The machines of the whole sample, which p.sample bounds; key 0 is between families, then each family's; -1 has what features tell."""
        x = np.empty((rows.num_rows, p.size), np.float32)
        for i, row in enumerate(rows.column("x")):
            x[i] = np.frombuffer(row.as_buffer(), np.float16)
        number = {k: i for i, k in enumerate(languages)}
        lang = np.array([number[k] for k in rows.column("lang").to_pylist()], np.int64)
        x /= _SCALE
        information, most = _information(x, lang, rows.column("n").to_numpy(), len(languages), p)
        scale = 1 / (x.std(0) + 1e-4)
        x *= scale
        out = [(-1, k, 0, w.tobytes(), most) for k, w in enumerate(information)]
        for group, classes in enumerate([[np.isin(lang, g) for g in groups], *[[lang == k for k in g] for g in groups]]):
            for i, j in combinations(range(len(classes)), 2):
                own = np.flatnonzero(classes[i] | classes[j])
                w, b = _machine(x[own], np.where(classes[i][own], 1, -1).astype(np.float32), p) if len(own) else (np.zeros(p.size, np.float32), 0.0)
                out.append((group, i, j, (w * scale).astype(np.float32).tobytes(), float(b)))
        names = ("group", "one", "two", "weights", "bias")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64())
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    machines: list[list[Machine]] = [[] for _ in range(len(groups) + 1)]
    information, most = [], np.inf
    for r in sample.groupBy().applyInArrow(fitted, "group int, one int, two int, weights binary, bias double").orderBy("group", "one", "two").collect():
        if r["group"] < 0:
            information.append(np.frombuffer(r["weights"], np.float32))
            most = r["bias"]
            continue
        machines[r["group"]].append(Machine(r["one"], r["two"], np.frombuffer(r["weights"], np.float32), r["bias"]))
    return Model(languages, groups, tuple(machines[0]), tuple(map(tuple, machines[1:])), tuple(information), most)


def _decided(margins: np.ndarray, machines: tuple[Machine, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The winner by votes, then by the sum of margins, and how sure its machines are of it (their mean logistic)."""
    rows = len(margins)
    votes, total, sure = np.zeros((rows, n)), np.zeros((rows, n)), np.zeros((rows, n))
    for k, m in enumerate(machines):
        d = margins[:, k]
        votes[:, m.one] += d >= 0
        votes[:, m.two] += d < 0
        total[:, m.one] += d
        total[:, m.two] -= d
        s = 1 / (1 + np.exp(-np.clip(2 * d, -30, 30)))
        sure[:, m.one] += s
        sure[:, m.two] += 1 - s
    best = (votes + np.tanh(total) / 4).argmax(1) if n else np.zeros(rows, np.int64)
    return best, sure[np.arange(rows), best] / (n - 1) if n > 1 else np.ones(rows)


def _predicted(model: Model, p: Learning, carry: list[str], judge: bool = False):
    machines = [m for group in (model.between, *model.within) for m in group]
    information = model.information if judge else ()
    table = np.zeros((p.size + 1, len(machines) + len(information) + 1), np.float32)
    for k, w in enumerate(information):
        table[: p.size, len(machines) + k] = w
    for k, m in enumerate(machines):
        table[: p.size, k] = m.weights
    table[: p.size, -1] = 1  # counts
    bias = np.array([m.bias for m in machines])
    cuts = np.cumsum([0, len(model.between), *map(len, model.within)])

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in _slices(offsets):
                b, starts = _padded(data, offsets, lo, hi)
                f = _trigrams(b, p.size)
                f = np.r_[f, p.size, p.size]
                f[starts[1:] - 1] = p.size  # trigrams that reach into the next text
                f[starts[1:] - 2] = p.size
                sums = np.add.reduceat(table[f], starts[:-1], axis=0).astype(np.float64)
                means = sums[:, :-1] / np.maximum(1.0, sums[:, -1:])
                margins = means[:, : len(machines)] + bias
                family, sure = _decided(margins[:, : cuts[1]], model.between, len(model.families))
                langs, score = np.empty(hi - lo, object), np.zeros(hi - lo)
                for g, members in enumerate(model.families):
                    own = np.flatnonzero(family == g)
                    best, within = _decided(margins[own][:, cuts[g + 1] : cuts[g + 2]], model.within[g], len(members))
                    langs[own] = np.array(model.languages, object)[np.array(members)[best]] if len(own) else []
                    score[own] = sure[own] * within
                texts = batch.column("text").slice(lo, hi - lo)
                for i in np.flatnonzero(sums[:, -1] == 0).tolist() if len(model.languages) else range(hi - lo):
                    langs[i], score[i] = UNKNOWN, 0.0
                for i in np.flatnonzero(~np.logical_or.reduceat((b >= 65) & (_LETTER[b] != 32) & (b < 128), starts[:-1])).tolist():
                    if not any(map(str.isalpha, texts[i].as_py() or "")):
                        langs[i], score[i] = UNKNOWN, 0.0
                rows = batch.slice(lo, hi - lo)
                carried = {c: rows.column(c) for c in rows.schema.names if c in carry}
                if judge:
                    n = sums[:, -1]
                    known = (n == 0) | (_surprise(means[:, len(machines) :], n, information) <= model.most) if information else np.ones(hi - lo, bool)
                    carried["familiar"] = pa.array(known)
                yield pa.RecordBatch.from_pydict({**carried, "lang_pred": pa.array(langs.tolist(), pa.string()), "score": pa.array(np.clip(score, 0, 1))})

    return run


def predicted(docs: DataFrame, model: Model, p: Learning = Learning()) -> DataFrame:
    """docs: doc_id, text. One row for each row: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is und at score 0. Repeated texts are predicted alike. A null doc_id counts as held out.
    Columns besides doc_id and text are not looked at. No rows give no rows."""
    out = annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, p, ["doc_id"])
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def annotated(docs: DataFrame, model: Model, p: Learning = Learning(), carry: list[str] | None = None, judge: bool = False) -> DataFrame:
    """docs' columns, or those of carry, with lang_pred and score added, and before them familiar where judge is set: false for texts
    in none of the model's languages. Columns of docs with these names are replaced."""
    docs = docs.drop("lang_pred", "score", *(["familiar"] if judge else []))
    carry = docs.columns if carry is None else carry
    schema = T.StructType([f for f in docs.schema if f.name in carry])
    schema = (schema.add("familiar", "boolean") if judge else schema).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(lean(_predicted(model, p, carry, judge)), schema)
