"""Substring dedup: recurring phrases confirmed on their words, compiled into sharded Aho-Corasick automata, and located in all documents.

A window is 13 consecutive words. Among the 9 phrases of 5 words in a window, the one with the least hash is its anchor, so
equal windows have equal anchors wherever they stand, and about every fifth phrase of a text is an anchor.

1. Documents are dealt to chunks of bounded size. Each chunk sends the hashes of its anchors, one of a kind, to shards by hash.
   A shard answers which of them more than one chunk sent. This only narrows what follows; it decides nothing.
2. A chunk sends the passages around such anchors, and around those that recur between its own documents, to the anchor's
   shard: as words, each distinct window once, with the smallest document of the chunk that has it.
3. A shard confirms on words the phrases that recur in different documents, compiles them into its automaton, and streams the
   passages of all chunks through it. Windows around an occurrence are candidates; candidates are compared on their words,
   and the shard tells each chunk which of its windows recur, and which of those start in a smaller document elsewhere.
4. A chunk removes the words of the windows it was told of, in all but their smallest document.

What the automata do not find stays. Hashes only sort and route: wherever two windows, phrases or words are taken to be equal,
their bytes have been compared. A phrase that stands in every document adds its distinct passages once for each chunk, and
where those are many (a short common phrase in ever new company) they are dealt by window instead of by phrase. The chunks'
texts are shuffled once and that shuffle is read three times; the number of tasks follows the session's partitions, each of
which holds as many chunks or shards as it must, one after the other.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import parts, text_bytes
from edgefield.llm._words import Words, mixed, runs, words

WINDOW = 13
ANCHOR = 5
HOT = 4096  # occurrences of an anchor from which on its windows are dealt one by one
_NONE = np.iinfo(np.int64).max

_ANCHORS = "shard int, chunk int, hashes binary, counts binary"
_RECURRING = "chunk int, hashes binary, hot binary"
_PASSAGES = "shard int, chunk int, docs binary, at binary, sizes binary, text binary"
_TOLD = "chunk int, windows binary"
_TASK_BYTES = 64 << 20


def _sorted_chunk(batch: pa.Table) -> pa.Table:
    """Rows in an order that does not depend on how they came, a null id after all others: word positions stay the same between passes."""
    ids = batch.column("doc_id").fill_null(_NONE)
    return pa.table({"doc_id": batch.column("doc_id"), "id": ids, "text": batch.column("text")}).sort_by([("id", "ascending"), ("text", "ascending")])


def _anchors(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and the phrase that anchors each window (-1: the words there are no window)."""
    phrases, _ = runs(w.hash, w.row, anchor)
    n = max(0, len(w.hash) - window + 1)
    if not n:
        return mixed(phrases), np.zeros(0, np.int64)
    whole = w.row[:n] == w.row[window - 1 :]
    at = np.arange(n)
    best, value = at.copy(), phrases[:n].copy()
    for i in range(1, window - anchor + 1):
        other = phrases[i : i + n]
        less = other < value
        best[less] = at[less] + i
        value = np.minimum(value, other)
    best[~whole] = -1
    return mixed(phrases), best  # anchors have small hashes; mixed, they spread evenly over the shards


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, counts[0] of them; then the next ones."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys (equal ones as they stand), and where a new key begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)


def _earliest(positions: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of the rising positions the first one with its key."""
    order, first = _firsts(keys)
    out = np.empty(len(positions), np.int64)
    out[order] = np.repeat(positions[order[first]], np.diff(np.r_[first, len(order)]))
    return out


def _word_ids(w: Words, some: np.ndarray) -> np.ndarray:
    """For the words at the rising positions some: the position of the first of them with the same bytes; others are undefined."""
    out = np.zeros(len(w.hash), np.int64)
    rep = _earliest(some, w.hash[some])
    size = w.end[some] - w.start[some]
    same = size == w.end[rep] - w.start[rep]
    if same.all():
        other = rep != some
        a, b = _ranges(w.start[some[other]], size[other]), _ranges(w.start[rep[other]], size[other])
        same = np.array([bool((w.data[a] == w.data[b]).all())])
    if not same.all():  # a collision of hashes
        seen: dict[bytes, int] = {}
        rep = np.array([seen.setdefault(w.data[w.start[i] : w.end[i]].tobytes(), i) for i in some.tolist()], np.int64)
    out[some] = rep
    return out


def _classes(w: Words, at: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For runs of n words at the rising positions at: the first of those positions with the same words."""
    if not len(at):
        return at
    covered = np.zeros(len(w.hash) + 1, np.int64)
    covered[at] += 1
    np.add.at(covered, at + n, -1)
    ids = _word_ids(w, np.flatnonzero(np.cumsum(covered)[:-1] > 0))
    rep = _earliest(at, hashes)
    if all((ids[at + k] == ids[rep + k]).all() for k in range(n)):
        return rep
    seen: dict[tuple, int] = {}  # a collision of hashes
    return np.array([seen.setdefault(tuple(ids[i : i + n].tolist()), i) for i in at.tolist()], np.int64)


def _by_shard(route: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted route: the shards that get any of it, and where each one's part begins and ends."""
    shard = ((route >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    return shard[first].astype(np.int32), first, np.r_[first[1:], len(shard)] if len(first) else first


def _blobs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())


def _joined(blobs: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype)


def _within(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _anchors_of(chunk: int, batch: pa.Table, shards: int, window: int, anchor: int) -> pa.Table:
    """A chunk's anchors, each once with the number of its places, one row for each shard that gets any."""
    w = words(batch.column("text"))
    phrases, anchors = _anchors(w, window, anchor)
    used = np.unique(anchors)
    hashes, counts = np.unique(phrases[used[used >= 0]], return_counts=True)
    shard, lo, hi = _by_shard(hashes, shards)
    return pa.table({"shard": pa.array(shard), "chunk": pa.array(np.full(len(shard), chunk, np.int32)), "hashes": _blobs(hashes, lo, hi), "counts": _blobs(counts.astype(np.uint32), lo, hi)})


def _recurring(batch: pa.Table, hot: int) -> pa.Table:
    """For each chunk of a shard: those of its anchors that other chunks have as well, and those that have very many places."""
    chunks, blobs = batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist()
    hashes, counts = np.frombuffer(b"".join(blobs), np.uint64), _joined(batch.column("counts"), np.uint32)
    one, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
    places = np.bincount(inverse, counts, minlength=len(one))
    several, many = (n > 1)[inverse], (places > hot)[inverse]
    out = []
    ends = np.cumsum([len(b) // 8 for b in blobs]).tolist()
    for c, lo, hi in zip(chunks, [0, *ends[:-1]], ends):
        own, s, m = hashes[lo:hi], several[lo:hi], many[lo:hi]
        if s.any() or m.any():
            out.append((c, own[s].tobytes(), own[m].tobytes()))
    return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate((("chunk", pa.int32()), ("hashes", pa.binary()), ("hot", pa.binary())))})


def _passages_of(chunk: int, batch: pa.Table, recurring: np.ndarray, hot: np.ndarray, shards: int, window: int, anchor: int) -> pa.Table:
    """The words around recurring anchors of a chunk, each distinct window once, where its smallest document has it.

    recurring and hot are sorted. A passage is a run of windows with one anchor: docs has its document, at twice the position
    of its first word in the chunk, and one more if a larger document of the chunk has a window of it too."""
    batch = _sorted_chunk(batch)
    w, docs_of = words(batch.column("text")), batch.column("id").to_numpy()
    phrases, anchors = _anchors(w, window, anchor)
    used = np.unique(anchors)
    used = used[used >= 0]
    order, first = _firsts(phrases[used])
    if len(first):  # documents rise with positions
        last = np.r_[first[1:], len(order)] - 1
        doc = docs_of[w.row[used[order]]]
        recurring = np.union1d(recurring, phrases[used[order[first[doc[first] < doc[last]]]]])
    at = np.flatnonzero(anchors >= 0)
    at = at[_within(phrases[anchors[at]], recurring)]
    hashes = runs(w.hash, w.row, window)[0]
    rep = _classes(w, at, hashes[at], window)
    own, inverse = np.unique(rep, return_inverse=True)
    twice = np.zeros(len(own), bool)
    twice[inverse[docs_of[w.row[at]] > docs_of[w.row[rep]]]] = True
    a = anchors[own]
    alone = _within(phrases[a], hot)
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1] + 1) | (a[1:] != a[:-1]) | alone[1:]]) if len(own) else np.zeros(0, np.int64)
    route = np.where(alone, hashes[own], phrases[a])[first] if len(own) else np.zeros(0, np.uint64)
    n = np.diff(np.r_[first, len(own)]) + window - 1  # words
    twice = np.logical_or.reduceat(twice, first) if len(first) else twice
    order = np.argsort(route, kind="stable")
    begin, n = own[first][order], n[order]
    at_word = _ranges(begin, n)
    size = w.end[at_word] - w.start[at_word] + 1
    text = w.data[np.minimum(_ranges(w.start[at_word], size), max(0, len(w.data) - 1))]
    ends = np.cumsum(size)
    text[ends - 1] = 32
    bytes_before = np.r_[0, ends][np.r_[0, np.cumsum(n)]]
    shard, lo, hi = _by_shard(route[order], shards)
    return pa.table(
        {
            "shard": pa.array(shard),
            "chunk": pa.array(np.full(len(shard), chunk, np.int32)),
            "docs": _blobs(docs_of[w.row[begin]], lo, hi),
            "at": _blobs(2 * begin + twice[order], lo, hi),
            "sizes": _blobs(np.diff(bytes_before), lo, hi),
            "text": _blobs(text, bytes_before[lo], bytes_before[hi]),
        }
    )


def _spaced(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, or of those marked, each with a space after it; and where each begins, with the end."""
    start, end = (w.start, w.end) if keep is None else (w.start[keep], w.end[keep])
    edges = np.zeros(len(w.data) + 1, np.int8)
    edges[start] += 1
    edges[end] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    at = np.r_[0, np.cumsum(end - start + 1)]
    letters = np.ones(at[-1], bool)
    letters[at[1:] - 1] = False
    out = np.full(at[-1], 32, np.uint8)
    out[letters] = w.data[inside]
    return out, at


def _occurrences(w: Words, phrases: np.ndarray, anchor: int) -> np.ndarray:
    """Marks each word where an automaton of the phrases at the given positions finds one of them."""
    found = np.zeros(max(0, len(w.hash) - anchor + 1), bool)
    if not len(phrases):
        return found
    spaced, at = _spaced(w)
    text = " " + spaced.tobytes().decode("latin-1")  # a word begins after the space at its place
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for lo, hi in zip(at[phrases].tolist(), at[phrases + anchor].tolist()):
        automaton.add_word(text[lo : hi + 1])
    automaton.make_automaton()
    ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
    begin = np.searchsorted(at, ends) - anchor
    found[begin[w.row[begin] == w.row[begin + anchor - 1]]] = True  # not those across two passages
    return found


def _candidates(w: Words, found: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Windows that hold an occurrence."""
    n = max(0, len(w.hash) - window + 1)
    if not n:
        return np.zeros(0, np.int64)
    sums = np.r_[0, np.cumsum(found)]
    some = sums[np.arange(n) + window - anchor + 1] > sums[:n]
    return np.flatnonzero(some & (w.row[:n] == w.row[window - 1 :]))


def _located(batch: pa.Table, window: int, anchor: int) -> pa.Table:
    """A shard's passages through its automaton. For each chunk: its windows that recur, as twice their position, and one more if a
    smaller document elsewhere has them."""
    sizes = _joined(batch.column("sizes"), np.int64)
    docs, marked = _joined(batch.column("docs"), np.int64), _joined(batch.column("at"), np.int64)
    twice, at = (marked & 1).astype(bool), marked >> 1
    chunk = np.repeat(batch.column("chunk").to_numpy(), [len(b) // 8 for b in batch.column("docs").to_pylist()])
    offsets = np.r_[0, np.cumsum(sizes)]
    w = words(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(batch.column("text").to_pylist()))]))
    phrases, anchors = _anchors(w, window, anchor)
    used = np.unique(anchors)
    used = used[used >= 0]
    one, inverse = np.unique(_classes(w, used, phrases[used], anchor), return_inverse=True)
    least, most, again = np.full(len(one), _NONE), np.full(len(one), np.iinfo(np.int64).min), np.zeros(len(one), bool)
    np.minimum.at(least, inverse, docs[w.row[used]])
    np.maximum.at(most, inverse, docs[w.row[used]])
    again[inverse[twice[w.row[used]]]] = True
    confirmed = one[(least < most) | again]
    windows = _candidates(w, _occurrences(w, confirmed, anchor), window, anchor)
    one, inverse = np.unique(_classes(w, windows, runs(w.hash, w.row, window)[0][windows], window), return_inverse=True)
    row = w.row[windows]
    least = np.full(len(one), _NONE)
    np.minimum.at(least, inverse, docs[row])
    smaller = docs[row] > least[inverse]
    told = np.flatnonzero(smaller | twice[row])
    position = at[row] + windows - w.first_of_row()[row]
    order, first = _firsts(chunk[row[told]])
    told = told[order]
    return pa.table({"chunk": pa.array(chunk[row[told[first]]], pa.int32()), "windows": _blobs(2 * position[told] + smaller[told], first, np.r_[first[1:], len(told)] if len(first) else first)})


_EMPTY = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}


def _removed(batch: pa.Table, told: np.ndarray, window: int) -> pa.Table:
    """The chunk's result: windows that it was told of take their words along, where their document is not the smallest."""
    if not batch.num_rows:
        return pa.table({k: pa.array([], t) for k, t in _EMPTY.items()})
    batch = _sorted_chunk(batch)
    w, docs_of = words(batch.column("text")), batch.column("id").to_numpy()
    gone = np.zeros(len(w.hash) + 1, np.int64)
    if len(told):
        hashes, whole = runs(w.hash, w.row, window)
        at = np.flatnonzero(whole)
        at = at[_within(hashes[at], np.unique(hashes[told >> 1]))]
        rep = _classes(w, at, hashes[at], window)
        known, elsewhere = _within(rep, np.unique(told >> 1)), _within(rep, np.unique(told[told & 1 == 1] >> 1))
        go = at[elsewhere | (known & (docs_of[w.row[at]] > docs_of[w.row[rep]]))]
        np.add.at(gone, go, 1)
        np.add.at(gone, go + window, -1)
    gone = np.cumsum(gone)[:-1] > 0
    bounds = w.first_of_row()
    lost = np.r_[0, np.cumsum(gone)]
    spaced, at = _spaced(w, ~gone)
    ends = at[bounds - lost[bounds]]
    kept = [spaced[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.table({"doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(np.diff(lost[bounds]), pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = 2 << 20, shard_bytes: int = 4 << 20, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text. Returns one row for each row: doc_id, n_words, n_removed, kept (the kept words joined by one space, UTF-8 bytes).

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are those of the input. Windows
    that recur in their own document alone remove nothing, and rows that share a doc_id count as one document. A null text
    has no words. A null doc_id stands after every other id; rows with one remove nothing from each other. Texts shorter
    than a window lose nothing. Columns besides doc_id and text are not looked at. No rows give no rows."""
    size = text_bytes(docs)
    chunks, shards = max(1, math.ceil(size / chunk_bytes)), max(64, math.ceil(size / shard_bytes))
    tasks = max(parts(docs.sparkSession), math.ceil(size / _TASK_BYTES))
    # null ids are spread by their texts
    deal = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(7))), F.xxhash64("text", F.lit(7)))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).withColumn("chunk", F.pmod(deal, F.lit(chunks)).cast("int"))
    dealt = dealt.repartition(tasks, "chunk")

    def anchors_of(key, batch):
        return _anchors_of(key[0].as_py(), batch, shards, window, anchor)

    def passages_of(key, batch, found):
        recurring, many = np.sort(_joined(found.column("hashes"), np.uint64)), np.sort(_joined(found.column("hot"), np.uint64))
        return _passages_of(key[0].as_py(), batch, recurring, many, shards, window, anchor)

    def removed_of(key, batch, told):
        return _removed(batch, _joined(told.column("windows"), np.int64), window)

    by_shard = lambda df: df.repartition(tasks, "shard").groupBy("shard")
    recurring = by_shard(dealt.groupBy("chunk").applyInArrow(anchors_of, _ANCHORS)).applyInArrow(lambda batch: _recurring(batch, hot), _RECURRING)
    passages = dealt.groupBy("chunk").cogroup(recurring.groupBy("chunk")).applyInArrow(passages_of, _PASSAGES)
    told = by_shard(passages).applyInArrow(lambda batch: _located(batch, window, anchor), _TOLD)
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(removed_of, "doc_id long, n_words long, n_removed long, kept binary")


def kept_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
