"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents become token ids with an end id; each is cut into whole sequences and a rest. Only the histogram of the rests'
lengths (at most one count for each length up to the sequence's) comes to the driver. There lengths are placed longest
first, each into the packs with the fewest tokens that still take it, many equal packs at a time; what is kept is a
list of packing patterns with their counts. Pieces are ranked within their length on Spark, and a piece finds its
pattern, sequence and offset by its rank.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgefield.llm._common import lean, written

SEQUENCE = 2048
END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    """The byte-level BPE of a rank file: the ids that the tokenizers library gives for the same vocabulary, at a quarter of the time."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """docs: doc_id, text. One row for each piece of a document: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit).

    A null or empty text is the end id alone. The vocabulary's special strings in a text get their special ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encode = _encoder(path)
        other = []

        def plain(text: str) -> np.ndarray:
            try:
                return np.asarray(encode.encode_ordinary(text), "<u4")
            except BaseException as e:  # its splitter overflows on very long runs of white space, and says so by a panic
                if type(e).__name__ != "PanicException":
                    raise
                if not other:
                    from tokenizers import Tokenizer

                    other.append(Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json"))
                return np.array(other[0].encode(text, add_special_tokens=False).ids, "<u4")

        special = re.compile("|".join(map(re.escape, SPECIAL)))

        def ids_of(text: str) -> np.ndarray:
            out, at = [], 0
            for m in special.finditer(text):
                out += [plain(text[at : m.start()]), np.array([SPECIAL[m[0]]], "<u4")]
                at = m.end()
            out += [plain(text[at:]), np.array([end_id], "<u4")]
            return np.concatenate(out)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = ids_of(text or "")
                    blob = ids.tobytes()
                    rows += [(doc_id, s, min(sequence, len(ids) - s), len(ids), blob[4 * s : 4 * (s + sequence)]) for s in range(0, len(ids), sequence)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(columns[0], pa.int64()), **{n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "doc_tokens"), columns[1:4])}, "ids": pa.array(columns[4], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, start long, length long, doc_tokens long, ids binary")


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    count: int


def patterns(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Shortest-pack-first: how many packs of which lengths take all of the histogram's pieces.

    Packs with the same lengths are one entry, so the work grows with the number of lengths and not with that of the pieces."""
    room: list[tuple[int, int]] = []  # heap of (tokens so far, serial)
    open_: dict[int, tuple[tuple[int, ...], int, int]] = {}  # serial: lengths, tokens, count
    full: Counter = Counter()
    serial = 0

    def put(lengths: tuple[int, ...], tokens: int, count: int) -> None:
        nonlocal serial
        if size - tokens < least:
            full[lengths] += count
            return
        open_[serial] = (lengths, tokens, count)
        heapq.heappush(room, (tokens, serial))
        serial += 1

    least = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if room and room[0][0] + length <= size:
                _, key = heapq.heappop(room)
                lengths, tokens, count = open_.pop(key)
                used = min(count, left)
                if count > used:
                    put(lengths, tokens, count - used)
                put((*lengths, length), tokens + length, used)
            else:  # a pack that a piece opens is the shortest one for the next piece
                stack = min(left, size // length)
                packs = left // stack
                used = stack * packs
                put((length,) * stack, length * stack, packs)
            left -= used
    for lengths, _, count in open_.values():
        full[lengths] += count
    return [Pattern(k, n) for k, n in full.items()]


def _slots(histogram: dict[int, int], size: int, first_sequence: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, first sequence, pieces of that length in a pack, offset of the first): where ranks go."""
    out, taken = [], defaultdict(int)
    at = first_sequence
    for lengths, count in patterns(histogram, size):
        offset = 0
        for length, n in Counter(lengths).items():
            rank = taken[length]
            out.append((length, rank, rank + n * count, at, n, offset))
            taken[length] += n * count
            offset += n * length
        at += count
    return out


def packed(pieces: DataFrame, sequence: int = SEQUENCE, group_rows: int = 4096) -> DataFrame:
    """pieces: doc_id, start, length and any other columns. Adds sequence_id and offset to every row.

    Lengths are 1 to sequence, others are an error; together (doc_id, start, length) need not be unique, repeated rows go to places of their own. Other
    columns come through as they are, save ones named sequence_id or offset, which are replaced. No rows give no rows."""
    spark = pieces.sparkSession
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    n = pieces.count()
    groups = max(1, n // group_rows)
    # a rank within each length: counts of small groups are summed up, and rows are numbered within a group only
    ranked = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", F.lit(3)), F.lit(groups)))
    counts = written(ranked.groupBy("length", "_group").agg(F.count("*").alias("_n")), "counts")
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(length is None or not 0 < length <= sequence for length in histogram):
        raise ValueError(f"lengths of pieces are from 1 to {sequence}")
    slots = spark.createDataFrame(_slots(histogram, sequence, 0), "_length long, _from long, _to long, _sequence long, _per long, _offset long")
    # rows that are equal in all columns may change places; no others do when a task is run again
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "start", F.xxhash64(*[f"`{c}`" for c, kind in pieces.dtypes if "map<" not in kind]))
    rank = ranked.withColumn("_row", F.row_number().over(within) - 1).join(starts, ["length", "_group"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    # at most a few entries for each length up to sequence: a bound that does not depend on the corpus
    placed = rank.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(nth / F.col("_per"))).withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_per")) * F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
