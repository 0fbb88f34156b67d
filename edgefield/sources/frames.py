"""Frames of a validation set as a data source: a manifest of one image a line, read in ranges of bytes, each task opening its own files.

    spark.dataSource.register(Frames)
    spark.read.format("frames").schema("image_id long, file string, height int").option("limit", 100).load("/data/manifest.jsonl")

A line is {"file": ..., "objects": [{"label": ..., "box": [x0, y0, x1, y1]}]}, file being a path beside the manifest or a whole one.
image_id is the byte at which the line begins: it grows with the lines, and no task has to know how many lines lie before its own.

Options: path; limit, of lines with an image and applied before any file is opened (0: all); split_bytes, the manifest's bytes to a task.
Only what the schema asks for is read: without height, width, pixels and problem no file is opened, and without pixels and problem only
headers are. With the option bounds, and a session that pushes filters into Python sources, bounds on image_id leave out whole ranges.

problem says why a line has no frame: line (no JSON object with a file name), missing, header or pixels. Such rows have nulls for what
could not be read. An empty line is none, and an empty manifest has no rows. A line that repeats another is a frame of its own. Formats are
binary PPM and PGM of 8 bits; `decoders` of a subclass adds others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_FILE_COLUMNS = {"height", "width", "pixels", "problem"}
_OBJECTS = pa.list_(pa.struct([("label", pa.string()), ("box", pa.list_(pa.float64()))]))
_TYPES = {"image_id": pa.int64(), "file": pa.string(), "objects": _OBJECTS, "height": pa.int32(), "width": pa.int32(), "pixels": pa.binary(), "problem": pa.string()}
_NETPBM = re.compile(rb"P([56])\s(?:\s*#[^\n]*\n)*\s*(\d+)\s+(\d+)\s+255\s")


def netpbm_size(head: bytes) -> tuple[int, int, int, int]:
    """Height, width, channels and where the pixels begin."""
    m = _NETPBM.match(head)
    if not m or not int(m[2]) or not int(m[3]):
        raise ValueError("not a binary PGM or PPM of 8 bits")
    return int(m[3]), int(m[2]), 3 if m[1] == b"6" else 1, m.end()


def netpbm(content: bytes) -> np.ndarray:
    """A frame as height x width x 3, blue first."""
    h, w, c, at = netpbm_size(content[:1024])
    pixels = np.frombuffer(content, np.uint8, h * w * c, at).reshape(h, w, c)  # too few bytes are a ValueError
    return pixels[..., ::-1] if c == 3 else np.repeat(pixels, 3, axis=2)


class Lines(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FrameReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str], decoders: dict):
        self.options, self.columns, self.decoders = options, columns, decoders
        self.least, self.below = 0, 1 << 62
        unknown = set(columns) - set(_TYPES)
        if unknown or "path" not in options:
            raise ValueError(f"no such column: {sorted(unknown)}" if unknown else "frames need the path of a manifest")

    def partitions(self) -> list[Lines]:
        where, path = _at(self.options["path"])
        end, step = where.get_file_info(path).size, int(self.options.get("split_bytes", 8 << 20))
        if end is None:
            raise FileNotFoundError(self.options["path"])
        limit = int(self.options.get("limit", 0))
        if limit:
            end = _end_of(where, path, limit)
        starts = range(0, end, step)
        return [Lines(s, min(s + step, end)) for s in starts if s < self.below and s + step > self.least] or [Lines(0, 0)]

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        base = self.options["path"].rsplit("/", 1)[0]
        rows: list[dict] = []
        size = 0
        for at, line in _lines(self.options["path"], part.start, part.end):
            if not self.least <= at < self.below:
                continue
            rows.append(self._row(at, line, base))
            size += len(line) + len(rows[-1].get("pixels") or b"")
            if size > 8 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, at: int, line: bytes, base: str) -> dict:
        row: dict = {"image_id": at}
        try:
            image = json.loads(line)
            row["file"] = name = image["file"]
            uri = name if name.startswith("/") or "://" in name else f"{base}/{name}"
        except (ValueError, TypeError, KeyError, AttributeError):
            return {"image_id": at, "problem": "line"}
        row["objects"] = [_object(o) for o in image.get("objects") or [] if isinstance(o, dict)]
        if _FILE_COLUMNS.isdisjoint(self.columns):
            return row
        decode, sized = self.decoders.get(name.rsplit(".", 1)[-1].lower(), self.decoders["ppm"])
        whole = "pixels" in self.columns or "problem" in self.columns
        try:
            where, path = _at(uri)
            with where.open_input_stream(path) as f:
                content = f.read() if whole else f.read(1024)
        except OSError:
            return row | {"problem": "missing"}
        try:
            row["height"], row["width"] = sized(content[:1024])[:2]
        except ValueError:
            return row | {"problem": "header"}
        if whole:
            try:
                row["pixels"] = decode(content).tobytes()
            except ValueError:
                row["problem"] = "pixels"
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in self.columns], self.columns)


class BoundedReader(FrameReader):
    """Takes bounds on image_id from the query. Spark refuses such a reader where the session does not push filters into Python sources."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("image_id",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.below = min(self.below, f.value + 1)
            yield f  # ranges are as fine as lines, but Spark checks each row all the same


class Frames(DataSource):
    """decoders: by suffix, what makes pixels of a file's bytes and what makes (height, width, ...) of its first 1024. Both raise ValueError."""

    decoders: dict[str, tuple[Callable, Callable]] = {"ppm": (netpbm, netpbm_size), "pgm": (netpbm, netpbm_size)}

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "image_id long, file string, objects array<struct<label:string,box:array<double>>>, height int, width int, pixels binary, problem string"

    def reader(self, schema: StructType) -> FrameReader:
        kind = BoundedReader if self.options.get("bounds") == "true" else FrameReader
        return kind(dict(self.options), schema.fieldNames(), self.decoders)


def _object(o: dict) -> dict:
    box = o.get("box")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"label": o["label"] if isinstance(o.get("label"), str) else None, "box": [float(v) if number(v) else None for v in box] if isinstance(box, list) else None}


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _lines(uri: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range of bytes; lines of nothing but white space are left out."""
    if start >= end:
        return
    where, path = _at(uri)
    with pa.PythonFile(where.open_input_file(path), mode="r") as f:
        f.seek(max(start - 1, 0))
        at = f.tell()
        held = b""
        if start:  # a line that began before the range is another task's
            while (k := held.find(b"\n")) < 0:
                more = f.read(1 << 16)
                if not more:
                    return
                at, held = at + len(held), more
            at, held = at + k + 1, held[k + 1 :]
        while at < end:
            parts = [held]
            while (k := parts[-1].find(b"\n")) < 0 and (more := f.read(1 << 20)):
                parts.append(more)
            whole = b"".join(parts)
            stop = sum(map(len, parts[:-1])) + k if k >= 0 else len(whole)
            if whole[:stop].strip():
                yield at, whole[:stop]
            if k < 0:
                return
            at, held = at + stop + 1, whole[stop + 1 :]


def _end_of(where: fs.FileSystem, path: str, limit: int) -> int:
    """Where the line after the first so many images begins: the manifest is read to there and no further."""
    at = n = 0
    with where.open_input_stream(path) as f:
        rest = b""
        while n < limit and (more := f.read(1 << 16)):
            *whole, rest = (rest + more).split(b"\n")
            for line in whole:
                at += len(line) + 1
                n += bool(line.strip())
                if n == limit:
                    return at
        return at + len(rest)


def frames(spark: SparkSession, manifest: str, limit: int = 0, split_bytes: int = 8 << 20) -> tuple[DataFrame, Observation]:
    """The frames of a manifest that can be read, with objects, and what is known of the others once an action on them has ended: found,
    missing and undecodable, counted in the same pass."""
    spark.dataSource.register(Frames)
    seen = Observation("frames")
    every = spark.read.format("frames").option("limit", limit).option("split_bytes", split_bytes).load(manifest)
    kinds = [F.count_if(F.col("problem").isNull()).alias("found"), F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem").isin("line", "header", "pixels")).alias("undecodable")]
    return every.observe(seen, *kinds).where("problem IS NULL").drop("problem"), seen


def truths(images: DataFrame, known: list[str]) -> DataFrame:
    """images: image_id, objects. image_id, label, gt_idx (by image and label, in order) and the box; objects of unknown labels are left out."""
    numbers = F.create_map(*[F.lit(v) for i, k in enumerate(known) for v in (k, i)])
    labelled = F.filter(F.transform("objects", lambda o, at: F.struct(F.try_element_at(numbers, o["label"]).alias("label"), o["box"].alias("box"), at.alias("at"))), lambda o: o["label"].isNotNull())
    rows = images.withColumn("o", labelled).select("image_id", "o", F.explode("o").alias("t"))
    before = F.size(F.filter("o", lambda o: (o["label"] == F.col("t.label")) & (o["at"] < F.col("t.at"))))
    return rows.select("image_id", "t.label", (before + 1).alias("gt_idx"), *[F.get("t.box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
