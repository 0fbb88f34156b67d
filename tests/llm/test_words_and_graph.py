import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgefield.llm import _words
from edgefield.llm._graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1cé 漢Z", max_size=40)), max_size=8), st.integers(1, 9))
def test_words_are_those_of_the_pattern(texts, slice_):
    before, _words.SLICE = _words.SLICE, slice_
    try:
        w = _words.words(pa.array(texts, pa.string()))
    finally:
        _words.SLICE = before
    got = [(int(r), bytes(w.data[s:e]).decode()) for r, s, e in zip(w.row, w.start, w.end)]
    assert got == [(i, m) for i, t in enumerate(texts) for m in WORD.findall(t or "")]
    by = {}
    for (_, word), h in zip(got, w.hash.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_lower_case_is_of_ascii_only():
    a, b, c = (_words.words(pa.array([x]), lower=True).hash.tolist() for x in ("ABC É", "abc É", "abc é"))
    assert a == b and a != c


def test_runs_stay_in_their_row():
    w = _words.words(pa.array(["a b c", "a b", None, "b c"]))
    hashes, whole = _words.runs(w.hash, w.row, 2)
    assert whole.tolist() == [True, True, False, True, False, True]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[5]
    assert len(_words.runs(w.hash, w.row, 50)[0]) == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(None, 2), (3, 4)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 300)]])
def test_components_of_simple_graphs(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == {n: min(real[0]) if len(real) > 1 else min(a, b) for a, b in real for n in (a, b)}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert np.all([v <= k for k, v in got.items()])
