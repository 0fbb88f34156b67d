"""MinHash near-dedup by tensored banding.

Two collections of m short bands are computed, each band of r minhashes; a table key is one band of the first collection with
one of the second. That makes m * m tables of 2 * r hashes each from 2 * m * r minhashes, where separate tables would take
2 * r * m * m. Two sets with similarity s share a key with probability (1 - (1 - s**r)**m)**2: 0.9969 at 0.8 for r = 3 and
m = 9, 0.9997 at 0.85.

Equal sets are joined first, by their size and 128 bits of hash. Then, over one document of each set:
1. every document is compared on full sets with the smallest document that shares a table key; links make components;
2. buckets that still hold several components are compared in blocks by sketches of the sets (one minimum of each of 512
   parts). Pairs of different components whose estimate lies no more than 4.5 standard deviations below the threshold are
   compared on full sets; their links complete the components. A pair is looked at in the first table where its keys agree.
   A sketch draws its members from the union without replacement, so for small sets the deviation is far below a binomial one.
So a group of thousands of copies costs about one comparison for each copy and key, not one for each pair, and no pair that
shares a key and could link two components is left out.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.llm._blocks import into_blocks
from edgefield.llm._common import forget, lean, parts, whole_groups, written
from edgefield.llm._graph import connected_components
from edgefield.llm._words import mixed, runs, words


class MinHash(NamedTuple):
    shingle: int = 5  # words
    percent: int = 80  # least similarity
    band: int = 3  # r
    bands: int = 9  # m
    sketch: int = 512  # parts
    block: int = 1024  # rows of a chunk
    seed: int = 20260102


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, left array<long>, right array<long>"
_AT_ONCE = 1 << 16  # shingles that are minhashed together


def _shingles(texts: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes; fewer than k words are one shingle."""
    w = words(texts, lower=True)
    hashes, whole = runs(w.hash, w.row, k)
    bounds = w.first_of_row()
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = hi - lo
        if n >= k:
            out.append(np.unique(hashes[lo : hi - k + 1]))
        elif n:
            out.append(runs(w.hash[lo:hi], w.row[lo:hi], n)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _minima(values: np.ndarray, starts: np.ndarray, salts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    out = np.empty((len(salts), len(starts)), np.uint64)
    for i, (salt, odd) in enumerate(zip(salts, odds)):
        x = values ^ salt
        x *= odd
        out[i] = np.minimum.reduceat(x, starts)
    return out


def _signatures(sets: list[np.ndarray], p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the left and right bands, a row for each set; all sets have members."""
    rng = np.random.default_rng(p.seed)
    n = 2 * p.bands * p.band
    salts = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    odds = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    minima = []
    sizes = np.array([len(s) for s in sets])
    lo = 0
    while lo < len(sets):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), _AT_ONCE, "right")))
        minima.append(_minima(np.concatenate(sets[lo:hi]), np.r_[0, np.cumsum(sizes[lo:hi])[:-1]], salts, odds))
        lo = hi
    by_band = np.concatenate(minima, axis=1).reshape(2 * p.bands, p.band, -1)
    keys = np.zeros((2 * p.bands, by_band.shape[2]), np.uint64)
    for i in range(p.band):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + by_band[:, i])
    return keys[: p.bands].T, keys[p.bands :].T


def _signed(p: MinHash):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sets = _shingles(part.column("text"), p.shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[list] = [[[] for _ in sets], [[] for _ in sets]]
                if full:
                    for side, found in zip(keys, _signatures([sets[i] for i in full], p)):
                        for i, row in zip(full, found.astype(np.int64).tolist()):
                            side[i] = row
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_a": pa.array([int(s.sum().astype(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                        "set_b": pa.array([int(np.bitwise_xor.reduce(mixed(s)).astype(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                        "left": pa.array(keys[0], pa.list_(pa.int64())),
                        "right": pa.array(keys[1], pa.list_(pa.int64())),
                    }
                )

    return run


def _sketch(s: np.ndarray, size: int) -> bytes:
    """The least 8 bits-mixed value of each part of the hashes' range; 0: the part is empty."""
    x = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    part = (x >> np.uint64(40)).astype(np.int64) % size
    order = np.lexsort((x, part))
    part, x = part[order], x[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    out = np.zeros(size, np.uint8)
    out[part[first]] = (mixed(x[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _full_sets(p: MinHash):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = _shingles(part.column("text"), p.shingle)
                yield pa.RecordBatch.from_pydict(
                    {
                        "rep": part.column("doc_id"),
                        "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        "sketch": pa.array([_sketch(s, p.sketch) if len(s) else bytes(p.sketch) for s in sets], pa.binary()),
                    }
                )

    return run


def _plausible(p: MinHash):
    """From blocks of rows with sketches: pairs of different components that may reach the threshold, in lists by their smaller id."""
    least = p.percent / 100

    def pairs(table: pa.Table):
        block = table.column("block").to_numpy()
        rep, comp, n = (table.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
        side, alike = table.column("side").to_numpy(), table.column("alike").to_numpy(zero_copy_only=False)
        i_of, j_of = (table.column(c).to_numpy() for c in ("i", "j"))
        lefts, rights = (np.stack(table.column(c).to_numpy()) for c in ("left", "right"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, p.sketch)
        cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = np.arange(lo, hi)
            a, b = (rows, rows) if alike[lo] else (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1])
            for i in a.tolist():
                other = b[(comp[b] != comp[i]) & (rep[b] > rep[i])] if alike[lo] else b[comp[b] != comp[i]]
                other = other[(100 * np.minimum(n[other], n[i]) >= p.percent * np.maximum(n[other], n[i]))]
                if not len(other):
                    continue
                mine, theirs = sketches[i], sketches[other]
                shown = ((theirs != 0) | (mine != 0)).sum(1)
                same = ((theirs == mine) & (mine != 0)).sum(1)
                union = (n[other] + n[i]) / (1 + least)  # at the threshold
                unseen = np.maximum(0.0, union - shown) / np.maximum(1.0, union - 1)
                good = other[same + 1 >= shown * (least - 4.5 * np.sqrt(least * (1 - least) / shown * unseen))]
                first = ((lefts[good] == lefts[i]).argmax(1) == i_of[i]) & ((rights[good] == rights[i]).argmax(1) == j_of[i])
                good = good[first]
                if len(good):
                    yield int(rep[i]), rep[good].tolist()

    def run(batches):
        for table in whole_groups(batches, "block"):
            found = list(pairs(table))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "bs": pa.array([y for _, y in found], pa.list_(pa.int64()))})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    """pairs a, b that reach the threshold on full sets."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    n, m = F.size("of_a"), F.size("of_b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    near = pairs.join(one, "a").join(two, "b").where(100 * F.least(n, m) >= p.percent * F.greatest(n, m))
    return near.where(100 * both >= p.percent * (n + m - both)).select("a", "b")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """docs: doc_id, text. Returns one row for each row: doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and link with nothing. Rows that share a doc_id are one node, with the links of each of their texts. A null
    doc_id has no component and is kept. Of a component the smallest doc_id is kept. Columns besides doc_id and text are not
    looked at. No rows give no rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(texts.mapInArrow(lean(_signed(p)), _SIGNED), "signed")
    reps = written(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.any_value("left").alias("left"), F.any_value("right").alias("right")),
        "reps",
    )
    tables = reps.select("rep", F.posexplode("left").alias("i", "one"), "right").select("rep", "i", "one", F.posexplode("right").alias("j", "two"))
    keys = tables.select("rep", "i", "j", F.xxhash64("i", "j", "one", "two").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    hits = written(keys.join(shared, "key"), "hits")
    wanted = hits.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(lean(_full_sets(p)), "rep long, shingles array<long>, sketch binary"), "sets")
    links = written(_verified(hits.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), sets, p), "links")
    near = connected_components(links)

    of = hits.join(near.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = of.join(several, "key").join(sets.select("rep", "sketch", F.size("shingles").alias("n_shingles")), "rep").join(reps.select("rep", "left", "right"), "rep")
    blocks = into_blocks(left, "key", "n", "rep", p.block).select("block", "rep", "component", "n_shingles", "sketch", "i", "j", "left", "right", "side", "alike")
    found = blocks.repartition(parts(spark), "block").sortWithinPartitions("block").mapInArrow(lean(_plausible(p)), "a long, bs array<long>")
    more = found.select("a", F.explode("bs").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    again = written(_verified(more, sets, p), "links")
    rows = reps.select("set_a", "set_b", "n_shingles", "rep")
    same_id = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").join(rows, ["set_a", "set_b", "n_shingles"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(reduce(DataFrame.union, [near.select(F.col("node").alias("a"), F.col("component").alias("b")), again, same_id]))
    for done in (hits, reps, sets, links, again):
        forget(done)
    out = signed.select("doc_id", "n_shingles").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
