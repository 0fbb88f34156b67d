import hashlib
import re
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from edgefield.llm import embeddings, minhash, substrings
from edgefield.llm._words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): ord(c) + 32 for c in string.ascii_uppercase}


def union(ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    return find, join


def brute_minhash(docs, k):
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    find, join = union(sets)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                join(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_is_brute_force(spark, sf, k):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), minhash.MinHash(shingle=k)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_minhash(docs, k)


def test_minhash_of_a_family_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(220):
        w = list(base)
        for j in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            w[j] = f"r{i}_{j}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(50)]
    p = minhash.MinHash(shingle=4, block=32)  # small blocks, so that buckets are split
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()}
    assert got == brute_minhash(docs, 4)


def test_minhash_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in minhash.near_duplicates(odd).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1][0][1:] == (1, True) and got[2][0][1:] == (1, False)
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)]
    assert got[7] == [(1, 7, True)] and got[8] == [(1, 7, False)]
    assert got[11][0] == got[11][1] and got[13][0][1:] == (12, False)
    assert sorted(x[1:] for x in got[None]) == [(None, True), (None, True)]
    assert minhash.near_duplicates(none).count() == 0


def brute_substrings(docs, n=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][j : j + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk, hot", [(1 << 12, 1), (1 << 14, substrings.HOT), (1 << 21, substrings.HOT), (1 << 21, 1)])
def test_substrings_are_brute_force(spark, sf, chunk, hot):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10_000 + i, " ".join(f"p{j}" for j in range(i, i + 13))) for i in range(0, 30, 3)] + [(20_000, " ".join(f"p{j}" for j in range(60))), (20_001, "x " * 500), (20_002, "x " * 12), (20_003, "x " * 14)]
    got = substrings.kept_digest(substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), chunk_bytes=chunk, hot=hot)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substrings(docs)


def by_hand(docs, finds=True):
    """The three passes over one chunk and one shard, without Spark; finds False: with automata that find nothing."""
    batch = pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([None if t is None else t.encode() for _, t in docs], pa.binary())})
    passages = substrings._passages_of(0, batch, np.zeros(0, np.uint64), np.zeros(0, np.uint64), 1, 13, 5)
    seen = substrings._occurrences
    substrings._occurrences = seen if finds else lambda w, phrases, anchor: np.zeros(max(0, len(w.hash) - anchor + 1), bool)
    try:
        told = substrings._located(passages, 13, 5)
    finally:
        substrings._occurrences = seen
    out = substrings._removed(batch, substrings._joined(told.column("windows"), np.int64), 13)
    return {i: (w, r, hashlib.sha256(k).hexdigest()) for i, w, r, k in zip(*(out.column(c).to_pylist() for c in ("doc_id", "n_words", "n_removed", "kept")))}


def test_automata_alone_name_what_goes():
    passage = " ".join(f"p{j}" for j in range(40))
    docs = [(1, "a b " + passage), (2, passage + " c d"), (3, "x " * 40), (4, "y " + passage[:60]), (5, "x " * 20)]
    assert by_hand(docs) == brute_substrings(docs) and by_hand(docs)[2][1] == 40
    assert all(r == 0 for _, r, _ in by_hand(docs, finds=False).values())


def test_equal_hashes_of_unequal_words_remove_nothing(monkeypatch):
    w = words(pa.array(["a b c d a b c e a b c d".encode()], pa.binary()))
    same = w._replace(hash=np.zeros(len(w.hash), np.uint64))
    assert substrings._word_ids(same, np.arange(12)).tolist() == [0, 1, 2, 3, 0, 1, 2, 7, 0, 1, 2, 3]
    assert substrings._classes(w, np.array([0, 4, 8]), np.zeros(3, np.uint64), 4).tolist() == [0, 4, 0]
    docs = [(i, " ".join(f"w{i % 3}x{j}" for j in range(i, i + 30))) for i in range(12)]
    monkeypatch.setattr(substrings, "mixed", lambda x: x & np.uint64(3))  # phrases collide
    whole = substrings.runs
    monkeypatch.setattr(substrings, "runs", lambda h, r, k: (whole(h, r, k)[0] & np.uint64(1), whole(h, r, k)[1]) if k == 13 else whole(h, r, k))
    assert by_hand(docs) == brute_substrings(docs)


def test_substrings_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in substrings.remove_repeats(odd, chunk_bytes=1 << 16).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, bytes(r.kept)))
    assert got[3] == [(0, 0, b"")] and got[5] == [(0, 0, b"")] and got[9][0][1] == 0
    assert got[10] == [(64, 60, b"other words go on")]
    assert got[11] == [(60, 60, b"")] * 2 and got[13] == [(60_001, 60_000, b"tail")]
    assert len(got[None]) == 2 and all(x[1] == 0 for x in got[None])
    assert substrings.remove_repeats(none).count() == 0


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 32))
    for g in range(12):  # groups around a centre, some of them close to the threshold
        x[g * 20 : g * 20 + 20] = x[g * 20] + rng.standard_normal((20, 32)) * (0.05 + 0.03 * g)
    x[300] = x[301] = x[302]
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    u = np.array([r for _, r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    find, join = union(range(len(rows)))
    for a, b in zip(*np.nonzero(near)):
        join(int(a), int(b))
    p = embeddings.Hyperplanes(recall=0.99999, block=64)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), p).collect()}
    assert [got[i].n_links for i in range(700)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(700)] == [find(i) for i in range(700)]
    assert all(got[i].kept == (got[i].component_id == i) for i in range(700))


def test_embeddings_recall_at_the_default(spark, sf):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x[750:] = x[:750] + rng.standard_normal((750, 64)) * rng.uniform(0.1, 0.5, (750, 1))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    over = [got[i] - n for i, n in enumerate(near.sum(1).tolist())]
    assert max(over) <= 0 and sum(got.values()) >= 0.98 * near.sum()


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "b"), (5, [nan, 1.0], "b"), (6, [None, 1.0], "b"), (7, [inf, 1.0], "b"), (8, [1.0, 0.0], "b"), (9, [1.0, 0.0, 0.0], "b"), (10, [], "b"), (11, [1e-30, 0.0], "b"), (12, [0.0, 0.0], "b"), (None, [1.0, 0.0], "b"), (13, [-1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id string").withColumnRenamed("component_id", "rep")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[8] == (3, 1, False) and got[11] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 9, 10, 12, 13):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True) and len(got) == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
