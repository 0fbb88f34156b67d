"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

Equal vectors are joined first. One of each gets a code of k signs in each of L tables; vectors that share a code in a table
are compared in double precision, in blocks. k grows with the number of vectors so that buckets of unrelated vectors stay
small, and L follows from k: a pair at the threshold shares a bucket with the wanted probability at least (0.99 by default),
closer pairs with more.

A pair counts in the first table only where its codes agree, so no pair needs to be written down to be counted once: a block
returns for each vector the number of its links that count there, and one link into the block's spanning forest.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.llm._blocks import into_blocks
from edgefield.llm._common import forget, lean, parts, whole_groups, written
from edgefield.llm._graph import connected_components


class Hyperplanes(NamedTuple):
    cosine: float = 0.9
    recall: float = 0.99  # for a pair just at the threshold
    rows_per_bucket: int = 16  # of unrelated vectors, about
    block: int = 1024
    seed: int = 20260103

    def shape(self, n: int) -> tuple[int, int]:
        """Signs in a code, and tables, for n vectors."""
        bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / self.rows_per_bucket + 1))))
        same = (1 - math.acos(self.cosine) / math.pi) ** bits
        return bits, max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - same)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, by way of their largest component so that no square overflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(vectors: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components one after the other (null: NaN), and where each vector begins, with the end."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False), offsets - offsets[0]


def _coded(p: Hyperplanes, bits: int, tables: int):
    """Codes of the vectors, one for each table; vectors that are not finite or zero get no row."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                values, offsets = _matrix(part.column("embedding"))
                sizes = np.diff(offsets)
                for size in np.unique(sizes[sizes > 0]).tolist():
                    rows = np.flatnonzero(sizes == size)
                    x = values[offsets[rows][:, None] + np.arange(size)]
                    good = np.isfinite(x).all(1) & (x != 0).any(1)
                    rows, x = rows[good], x[good]
                    if not len(rows):
                        continue
                    if size not in planes:
                        planes[size] = np.random.default_rng([p.seed, size]).standard_normal((size, bits * tables))
                    taken, x = part.take(pa.array(rows)), _unit(x)
                    signs = (x @ planes[size] >= 0).reshape(len(rows), tables, bits)
                    codes = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                    yield pa.RecordBatch.from_pydict({"rep": taken.column("rep"), "weight": taken.column("weight"), "embedding": taken.column("embedding"), "codes": pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))})

    return run


def _compared(p: Hyperplanes):
    """From blocks: for each vector its links that count in this table, and a link to the least id it reaches in the block."""

    def block(rep, weight, x, codes, table, a, b, alike):
        links = np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))
        near = x[a] @ x[b].T >= p.cosine
        if alike:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            return links, root
        a_, b_ = a[i], b[j]
        counts = ~(codes[a_, :table] == codes[b_, :table]).any(1) if table else np.ones(len(i), bool)
        np.add.at(links, a_[counts], weight[b_[counts]])
        if not alike:
            np.add.at(links, b_[counts], weight[a_[counts]])
        while True:  # the least position reachable; rows are in the order of their ids
            before = root.copy()
            np.minimum.at(root, a_, root[b_])
            np.minimum.at(root, b_, root[a_])
            root = root[root]
            if (root == before).all():
                return links, root

    def run(batches):
        for table in whole_groups(batches, "block"):
            table = table.sort_by([("block", "ascending"), ("rep", "ascending")])
            key = table.column("block").to_numpy()
            rep, weight, of = (table.column(c).to_numpy() for c in ("rep", "weight", "t"))
            side, alike = table.column("side").to_numpy(), table.column("alike").to_numpy(zero_copy_only=False)
            codes = _matrix(table.column("codes"))[0].astype(np.int32).reshape(len(key), -1)
            values, offsets = _matrix(table.column("embedding"))
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            links, root = np.zeros(len(key), np.int64), rep.copy()
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows = np.arange(hi - lo)
                a, b = (rows, rows) if alike[lo] else (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1])
                if len(a) and len(b) and hi - lo > 1:
                    x = _unit(values[offsets[lo] : offsets[hi]].reshape(hi - lo, -1))
                    links[lo:hi], least = block(rep[lo:hi], weight[lo:hi], x, codes[lo:hi], int(of[lo]), a, b, bool(alike[lo]))
                    root[lo:hi] = rep[lo:hi][least]
            some = (links > 0) | (root != rep)
            if some.any():
                yield pa.RecordBatch.from_pydict({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})

    return run


def near_duplicates(vectors: DataFrame, p: Hyperplanes = Hyperplanes()) -> DataFrame:
    """vectors: vec_id, embedding (an array of numbers). One row for each row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, link with
    nothing. Equal vectors link with each other. A null vec_id takes no part: no links, no component, kept. vec_id is taken
    as unique; rows that repeat one count as vectors of their own. Columns besides these two are not looked at. No rows give
    no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    reps = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    kind = dict(rows.dtypes)["embedding"]
    reps = written(reps, "reps")
    bits, tables = p.shape(reps.count())
    coded = written(reps.mapInArrow(lean(_coded(p, bits, tables)), f"rep long, weight long, embedding {kind}, codes array<int>"), "coded")
    forget(reps)
    hits = coded.select("rep", F.size("embedding").alias("size"), F.posexplode("codes").alias("t", "code"))
    hits = hits.select("rep", "t", F.xxhash64("size", "t", "code").alias("bucket"))
    shared = hits.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = into_blocks(hits.join(shared, "bucket"), "bucket", "n", "rep", p.block).select("rep", "t", "block", "side", "alike")
    full = blocks.join(coded, "rep")
    found = written(full.repartition(parts(spark), "block").sortWithinPartitions("block").mapInArrow(lean(_compared(p)), "rep long, links long, root long"), "found")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_rep = (
        coded.select("rep", "weight", "embedding")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.join(of_rep, "embedding", "left").where("vec_id IS NOT NULL").unionByName(rows.where("vec_id IS NULL").select("vec_id", "embedding", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"))
