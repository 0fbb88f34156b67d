"""Hard-negative mining: for an anchor and each of its positives, the best rows of other labels whose score is in a band below it.

One-dimensional distance keys. Rows' inner products with an anchor become distances when each vector of a length gets one more component
that brings its norm to the largest one, M, and the anchor gets a zero: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each augmented vector is stored
with its nearest pivot and its distance to it, and the table is sorted by (pivot, distance) into pages, leaves of an index on a single
number. By the triangle inequality a page of pivot p that holds distances lo to hi has nothing nearer to q than max(lo - |qp|, |qp| - hi)
and nothing further than |qp| + hi.

A search begins with the page an anchor stands in. What it finds there bounds the distance of its k-th row, and so the key intervals, one
for each pivot, that may hold better ones: an annulus around the pivot. Pages are taken in the order of their least distance, and the
intervals shrink with each better row, until no page left can hold one: the bound certifies the answer. Positives are one band of
scores from that bound upwards; negatives are bands below each positive, so that pages nearer than the band are left out too.

Anchors grow with the rows, so the scan is of blocks of anchors against pages: a page is sent to the blocks that may need it, and a
task holds one block, its best rows so far and one page. Where neighbours are hardly nearer than the rest, as with random
vectors of many components, most pages go to most blocks, and the work is that of comparing the anchors with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgefield.llm._common import forget, lean, parts, written

LARGEST = 1e140  # components of a larger size count as not finite: sums of their squares would not be
_EXACT = 2.0**53


class Mining(NamedTuple):
    scale: float = 256.0  # components become floor(scale * x)
    positives: int = 5
    negatives: int = 5
    least_percent: int = 80  # of the positive's score, for a negative
    pivots: int = 64  # for each vector length that the sample has
    sample: int = 2048  # rows, for the pivots only
    page_rows: int = 1024
    page_bytes: int = 1 << 20
    block: int = 1024  # anchors


class Space(NamedTuple):
    """For each vector length: the square of the largest norm, and pivots of one more component."""

    largest: dict[int, float]
    pivots: dict[int, np.ndarray]

    def of(self, size: int) -> tuple[float, np.ndarray]:
        largest = self.largest[size]
        origin = np.zeros((1, size + 1))
        origin[0, -1] = np.sqrt(largest)
        return largest, self.pivots.get(size, origin)

    def slack(self, size: int) -> float:
        """More than the rounding of distances at this length."""
        return 1e-9 * (1.0 + np.sqrt(self.largest[size]))


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0.0))]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row to each pivot, by differences, so that small ones are right too."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _by_size(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length in a batch: its row numbers and their components after scaling."""
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, np.floor(scale * values[(offsets[rows] - offsets[0])[:, None] + np.arange(size)])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least type that holds them all."""
    top = np.abs(x).max(initial=0.0)
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64).tobytes()


def _unpacked(blob: bytes, n: int, size: int) -> np.ndarray:
    if not n * size:
        return np.zeros((n, size))
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(blob) // (n * size)]
    return np.frombuffer(blob, kind).reshape(n, size).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Inner products, exactly: in doubles where no sum can leave their whole numbers, otherwise in Python's."""
    if largest < _EXACT:
        return q @ x.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).dot(whole(x).T) if q.shape[1] else np.zeros((len(q), len(x)))


def _largest(scale: float):
    def run(batches):
        for batch in batches:
            found = [(size, float((x * x).sum(axis=1).max())) for size, _, x in _by_size(batch, scale)]
            yield pa.RecordBatch.from_pydict({"size": pa.array([s for s, _ in found], pa.int32()), "largest": pa.array([v for _, v in found], pa.float64())})

    return run


def _space(rows: DataFrame, p: Mining) -> Space:
    """Norms of all rows; pivots from a bounded sample, by means after a start of rows far from each other. The driver holds the sample."""
    largest = {r["size"]: r["v"] for r in rows.select("embedding").mapInArrow(lean(_largest(p.scale)), "size int, largest double").groupBy("size").agg(F.max("largest").alias("v")).collect()}
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(p.sample).select("embedding").toArrow()
    pivots = {}
    for batch in sample.combine_chunks().to_batches():
        for size, _, x in _by_size(batch, p.scale):
            x = np.unique(_augmented(x, largest[size]), axis=0)
            chosen = [x[0]]
            far = ((x - x[0]) ** 2).sum(axis=1)
            while len(chosen) < min(p.pivots, len(x)):
                chosen.append(x[int(far.argmax())])
                far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
            centres = np.array(chosen)
            for _ in range(4):
                nearest = _distances(x, centres).argmin(axis=1)
                centres = np.array([x[nearest == k].mean(axis=0) if (nearest == k).any() else c for k, c in enumerate(centres)])
            pivots[size] = centres
    return Space(largest, pivots)


def _keyed(space: Space, scale: float):
    """Rows with their pivot and distance, components packed."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                for size, rows, x in _by_size(part, scale):
                    largest, pivots = space.of(size)
                    far = _distances(_augmented(x, largest), pivots)
                    nearest = far.argmin(axis=1)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "size": pa.array(np.full(len(rows), size, np.int32)), "pivot": pa.array(nearest.astype(np.int32)), "distance": pa.array(far[np.arange(len(rows)), nearest]),
                            "vec_id": taken.column("vec_id"), "label": taken.column("label"), "anchor": taken.column("anchor"), "vector": pa.array([_packed(v) for v in x], pa.binary()),
                        }
                    )

    return run


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    return np.concatenate([_unpacked(v, 1, size) for v in vectors]) if vectors else np.zeros((0, size))


def _gathered(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], most) -> Iterator[tuple[tuple, list[dict]]]:
    """Sorted rows in runs of one key, of most(size) rows at most."""
    held: list[dict] = []
    of = None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if held and (k != of or len(held) >= most(row["size"])):
                yield of, held
                held = []
            of = k
            held.append(row)
    if held:
        yield of, held


PAGE = "page long, size int, pivot int, lo double, hi double, vec_ids array<long>, labels array<long>, anchors array<boolean>, matrix binary"


def _pages(p: Mining):
    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for (size, pivot), rows in _gathered(batches, ("size", "pivot"), lambda size: max(1, min(p.page_rows, p.page_bytes // (8 * size + 1)))):
            columns = {c: [r[c] for r in rows] for c in ("vec_id", "label", "anchor", "vector", "distance")}
            yield pa.RecordBatch.from_pydict(
                {
                    "page": pa.array([serial], pa.int64()), "size": pa.array([size], pa.int32()), "pivot": pa.array([pivot], pa.int32()), "lo": [columns["distance"][0]], "hi": [columns["distance"][-1]],
                    "vec_ids": pa.array([columns["vec_id"]], pa.list_(pa.int64())), "labels": pa.array([columns["label"]], pa.list_(pa.int64())), "anchors": pa.array([columns["anchor"]], pa.list_(pa.bool_())),
                    "matrix": pa.array([_packed(_matrix(columns["vector"], size))], pa.binary()),
                }
            )
            serial += 1

    return run


def _best(found: list[tuple], k: int) -> list[tuple]:
    """The first k of (-score, vec_id, ...)."""
    return sorted(found)[:k]


ANCHOR = "uid string, anchor_id long, label long, size int, pivot int, distance double, vector binary, lows array<double>, highs array<double>"


def _anchors(space: Space, k: int):
    """The anchors of pages, each with the band that its own page leaves: scores from its k-th best row of the same label there."""

    def run(batches):
        for batch in batches:
            for page in batch.to_pylist():
                here = np.flatnonzero(np.array(page["anchors"], bool))
                if not len(here):
                    continue
                size, n = page["size"], len(page["vec_ids"])
                largest, pivots = space.of(size)
                x = _unpacked(page["matrix"], n, size)
                labels = np.array(page["labels"])
                far = _distances(_augmented(x[here], largest), pivots[page["pivot"]][None])[:, 0]
                scores = _scores(x[here], x, largest)
                lows = []
                for row, i in enumerate(here):
                    same = labels == labels[i]
                    same[i] = False
                    there = sorted(scores[row][same].tolist(), reverse=True)
                    lows.append([float(there[k - 1])] if len(there) >= k else [-np.inf])
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": [f"{page['page']}-{i}" for i in here], "anchor_id": pa.array([page["vec_ids"][i] for i in here], pa.int64()), "label": pa.array([int(labels[i]) for i in here], pa.int64()),
                        "size": pa.array([size] * len(here), pa.int32()), "pivot": pa.array([page["pivot"]] * len(here), pa.int32()), "distance": pa.array(far), "vector": pa.array([_packed(x[i]) for i in here], pa.binary()),
                        "lows": pa.array(lows, pa.list_(pa.float64())), "highs": pa.array([[np.inf]] * len(here), pa.list_(pa.float64())),
                    }
                )

    return run


BLOCK = "block long, size int, uids array<string>, labels array<long>, matrix binary, lows array<array<double>>, highs array<array<double>>, nearest array<double>, furthest array<double>, outer double, inner double"


def _blocks(space: Space, p: Mining):
    """Anchors that stand near each other in the order of the keys, with what pages they may need: for each pivot the least and largest
    distance of an anchor, and over all bands the outer and inner radius."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for (size,), rows in _gathered(batches, ("size",), lambda size: max(1, min(p.block, 8 * p.page_bytes // (8 * size + 1)))):
            largest, pivots = space.of(size)
            q = _matrix([r["vector"] for r in rows], size)
            far = _distances(np.c_[q, np.zeros(len(q))], pivots)
            norms = (q * q).sum(axis=1) + largest
            lows, highs = [[float(v) for v in r["lows"]] for r in rows], [[float(v) for v in r["highs"]] for r in rows]
            outer = max(_radius(n, min(low)) for n, low in zip(norms.tolist(), lows)) + space.slack(size)
            inner = min(_radius(n, max(high)) for n, high in zip(norms.tolist(), highs)) - space.slack(size)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([serial], pa.int64()), "size": pa.array([size], pa.int32()), "uids": [[r["uid"] for r in rows]], "labels": pa.array([[r["label"] for r in rows]], pa.list_(pa.int64())),
                    "matrix": pa.array([_packed(q)], pa.binary()), "lows": pa.array([lows], pa.list_(pa.list_(pa.float64()))), "highs": pa.array([highs], pa.list_(pa.list_(pa.float64()))),
                    "nearest": [far.min(axis=0).tolist()], "furthest": [far.max(axis=0).tolist()], "outer": [float(outer)], "inner": [float(inner)],
                }
            )
            serial += 1

    return run


def _radius(norms: float, score: float) -> float:
    """The distance that goes with a score; rounded scores may ask for a little less than nothing."""
    return float(np.sqrt(max(0.0, norms - 2.0 * score)))


class _Scan:
    """A block of anchors with the best rows of their bands so far."""

    def __init__(self, row: dict, space: Space, k: int, same_label: bool):
        self.size, self.k, self.same, self.space = row["size"], k, same_label, space
        self.largest, self.pivots = space.of(self.size)
        self.uids, self.labels = row["uids"], np.array(row["labels"])
        self.q = _unpacked(row["matrix"], len(self.uids), self.size)
        self.far = _distances(np.c_[self.q, np.zeros(len(self.q))], self.pivots)
        self.norms = (self.q * self.q).sum(axis=1) + self.largest
        self.lows, self.highs = row["lows"], row["highs"]
        self.best: list[list[list[tuple]]] = [[[] for _ in low] for low in self.lows]
        self.least = np.array([min(low) for low in self.lows])  # below it no row of an anchor counts any more
        self.most = np.array([max(high) for high in self.highs])

    def take(self, page: dict) -> None:
        """The page's rows, for the anchors whose interval it still meets."""
        far, slack = self.far[:, page["pivot"]], self.space.slack(self.size)
        near = np.maximum(np.maximum(page["lo"] - far, far - page["hi"]), 0.0)
        outer = np.sqrt(np.maximum(self.norms - 2.0 * self.least, 0.0)) + slack
        inner = np.sqrt(np.maximum(self.norms - 2.0 * self.most, 0.0)) - slack
        active = np.flatnonzero((near <= outer) & (far + page["hi"] >= inner))
        if not len(active):
            return
        ids, labels = page["vec_ids"], np.array(page["labels"])
        scores = _scores(self.q[active], _unpacked(page["matrix"], len(ids), self.size), self.largest)
        fits = (labels[None] == self.labels[active][:, None]) == self.same
        fits &= (scores >= self.least[active][:, None]) & (scores <= self.most[active][:, None])
        for row in np.flatnonzero(fits.any(axis=1)).tolist():
            a = int(active[row])
            there = np.flatnonzero(fits[row])
            found = [(-int(s), ids[i], f"{page['page']}-{i}") for s, i in zip(scores[row, there].tolist(), there.tolist())]
            if self.same:
                found = [f for f in found if f[2] != self.uids[a]]
            for band, (low, high) in enumerate(zip(self.lows[a], self.highs[a])):
                mine = [f for f in found if low <= -f[0] <= high]
                if mine:
                    self.best[a][band] = _best(self.best[a][band] + mine, self.k)
            self.least[a] = min(max(low, float(-b[-1][0])) if len(b) == self.k else low for low, b in zip(self.lows[a], self.best[a]))

    def result(self) -> pa.RecordBatch:
        rows = [(uid, band, -s, i) for uid, bands in zip(self.uids, self.best) for band, b in enumerate(bands) for s, i, _ in b]
        columns = list(zip(*rows)) if rows else [[]] * 4
        whole = [max(-(2**63), min(2**63 - 1, s)) for s in columns[2]]
        return pa.RecordBatch.from_pydict({"uid": pa.array(columns[0], pa.string()), "band": pa.array(columns[1], pa.int32()), "score": pa.array(whole, pa.int64()), "value": pa.array([float(s) for s in columns[2]], pa.float64()), "vec_id": pa.array(columns[3], pa.int64())})


def _scanned(space: Space, k: int, same_label: bool):
    """From a block's row and after it pages by their least distance: the best rows of each band."""

    def run(batches):
        scan = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: v[0] for c, v in batch.slice(i, 1).to_pydict().items()}
                if row["uids"] is not None:
                    if scan is not None:
                        yield scan.result()
                    scan = _Scan(row, space, k, same_label)
                else:
                    scan.take(row)
        if scan is not None:
            yield scan.result()

    return run


def _search(pages: DataFrame, anchors: DataFrame, space: Space, p: Mining, k: int, same_label: bool) -> DataFrame:
    """For each anchor and band the best k rows, as uid, band, rank, score, value (the score as a double), vec_id; written."""
    spark = pages.sparkSession
    n = anchors.count()
    wide = parts(spark)
    dealt = anchors.repartitionByRange(max(1, -(-n // p.block)), "size", "pivot", "distance", "uid").sortWithinPartitions("size", "pivot", "distance", "uid")
    blocks = written(dealt.mapInArrow(lean(_blocks(space, p)), BLOCK), "blocks")
    slices = max(1, -(-2 * wide // max(1, blocks.count())))  # few blocks: several tasks take a share of the pages for each
    needs = blocks.select("block", "size", "outer", "inner", F.posexplode(F.arrays_zip("nearest", "furthest")).alias("pivot", "_d"))
    needs = needs.select("block", "size", "pivot", "outer", "inner", F.col("_d.nearest").alias("_near"), F.col("_d.furthest").alias("_far"))
    heads = pages.select("page", "size", "pivot", "lo", "hi")
    least = F.greatest(F.col("lo") - F.col("_far"), F.col("_near") - F.col("hi"), F.lit(0.0))
    routes = heads.join(needs, ["size", "pivot"]).where((least <= F.col("outer")) & (F.col("_far") + F.col("hi") >= F.col("inner"))).select("page", "block", least.alias("near"))
    routes = written(routes, "routes")
    fields = ["uids", "labels", "matrix", "lows", "highs"]
    kinds = dict(blocks.dtypes)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    sent = routes.join(pages, "page").select(
        "block", F.pmod(F.xxhash64("page"), F.lit(slices)).cast("int").alias("slice"), "near", "page", "size", "pivot", "lo", "hi", "vec_ids", none("uids", kinds["uids"]), "labels", "matrix", none("lows", kinds["lows"]), none("highs", kinds["highs"])
    )
    first = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(-1.0).alias("near"), none("page", "long"), "size", none("pivot", "int"), none("lo", "double"), none("hi", "double"), none("vec_ids", "array<long>"), *fields)
    tasks = first.unionByName(sent).repartition(min(slices * max(1, -(-n // p.block)), 8 * wide), "block", "slice").sortWithinPartitions("block", "slice", "near", "page")
    found = tasks.mapInArrow(lean(_scanned(space, k, same_label)), "uid string, band int, score long, value double, vec_id long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "band").orderBy(F.desc("value"), F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    out = written(best, "best")
    forget(routes)
    forget(blocks)
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, p: Mining = Mining()) -> DataFrame:
    """vectors: vec_id, embedding (an array of numbers), label (a whole number). For each anchor (is_anchor, by default those whose
    vec_id is divisible by 100) and each of its first positives: rank, negative_id, positive_score, negative_score.

    An anchor's positives are the other rows of its label with the highest scores, its negatives for a positive those rows of other labels
    that have the highest scores from least_percent of the positive's score up to that score; ties go to the smaller vec_id. A positive
    without such rows, one of a negative score among them, gives no row. Scores are whole numbers and exact; those beyond 64 bits are shown
    as the nearest that fits, and the ends of bands beyond 53 bits are those of a double.

    Rows without a vec_id, a label or a vector, or with a null, non-finite or larger than 1e140 component take no part. Vectors meet
    those of their own length only; two empty ones score 0. Rows that repeat a vec_id count each for itself, also as an anchor, and a
    repeated row is another row. Equal vectors may be any share of the rows: pages are cut by rows. Other columns are not looked at. No
    rows give no rows."""
    anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LARGEST)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", fine))
    spark = vectors.sparkSession
    space = _space(rows, p)
    keyed = written(rows.mapInArrow(lean(_keyed(space, p.scale)), "size int, pivot int, distance double, vec_id long, label long, anchor boolean, vector binary"), "keyed")
    by = ["size", "pivot", "distance", "vec_id", "_tie"]
    dealt = keyed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts(spark), *by).sortWithinPartitions(*by).drop("_tie")
    pages = written(dealt.mapInArrow(lean(_pages(p)), PAGE), "pages")
    forget(keyed)
    anchors = written(pages.where(F.exists("anchors", lambda a: a)).select("page", "size", "pivot", "vec_ids", "labels", "anchors", "matrix").mapInArrow(lean(_anchors(space, p.positives)), ANCHOR), "anchors")
    positives = _search(pages, anchors, space, p, p.positives, same_label=True)
    bands = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "value"))).alias("_b"))  # of one anchor: as many as it may have positives
    none_fits = F.lit(float("inf"))  # below a negative score the band is empty
    share = F.lit(p.least_percent)
    least = lambda b: F.when(b["score"] < 0, none_fits).when(b["score"] < 1 << 53, F.ceil(b["score"].cast("decimal(38,0)") * share / 100).cast("double")).otherwise(b["value"] * share / 100)
    banded = anchors.drop("lows", "highs").join(bands, "uid").withColumn("lows", F.transform("_b", least)).withColumn("highs", F.transform("_b", lambda b: b["value"])).drop("_b")
    banded = written(banded, "banded")
    found = _search(pages, banded, space, p, p.negatives, same_label=False)
    forget(banded)
    named = positives.join(anchors.select("uid", "anchor_id"), "uid").select("uid", "anchor_id", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found, ["uid", "band"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
