"""A store of probe results, keyed by everything that decides them: what was measured once is not paid for again.

A store is a folder. A put writes a batch of its own and then publishes it by renaming one entry of the log, which either happens or
does not, so a reader never sees half a batch and two writers never lose each other's. Compaction writes the live records as a new
batch whose entry names those that it stands for; what another writer published meanwhile is not among them and stays live.
Batches that are no longer live are deleted by `vacuum`, later than any reader still needs them.

Records lie in buckets of their key, so that a look-up of a few probes reads the buckets they fall in.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16  # of a store: the same as long as it lives
IDENTITY = ("dataset", "frames", "pipeline", "condition", "seed")


def number_key(value: Column) -> Column:
    """A number as text with twelve digits: values that differ by rounding only are one, and so are 0 and -0."""
    return F.format_string("%.11e", value.cast("double") + F.lit(0.0))


def probe_key(dataset: Column, frames: Column, pipeline: Column, condition: Column, seed: Column) -> Column:
    """condition: a map of axis to number, in any order. Two probes have one key if nothing that decides their result differs.

    Texts are written as JSON, so no mark within them can be taken for one between them."""
    steps = F.transform(F.array_sort(F.map_entries(condition)), lambda e: F.array(e["key"], number_key(e["value"])))
    return F.to_json(F.struct(dataset.alias("d"), frames.cast("long").alias("n"), pipeline.alias("p"), steps.alias("c"), seed.cast("long").alias("s")))


class _Entry(NamedTuple):
    batch: str
    at: int  # microseconds
    replaces: tuple[str, ...]


class ProbeStore:
    """records: dataset, frames, pipeline, condition (map of axis to double), seed, and the results in any other columns.

    The store's columns are those of its first batch; a batch that lacks some of them has nulls there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _listed(self, name: str) -> list[Any]:
        fs, where = self._fs(f"{self.path}/{name}")
        return list(fs.listStatus(where)) if fs.exists(where) else []

    def _entries(self) -> list[_Entry]:
        """The published entries; an entry's name says what it is, so no file is opened but a compaction's."""
        out = []
        for status in self._listed("log"):
            name = status.getPath().getName()
            if name.startswith("_") or not name.endswith(".json"):
                continue
            at, batch, kind = name.removesuffix(".json").split("-")
            replaces: tuple[str, ...] = ()
            if kind == "compaction":
                replaces = tuple(json.loads(self.spark.read.text(f"{self.path}/log/{name}", wholetext=True).first()[0]))
            out.append(_Entry(batch, int(at), replaces))
        return out

    def _live(self, entries: list[_Entry]) -> list[_Entry]:
        gone = {b for e in entries for b in e.replaces}
        return [e for e in entries if e.batch not in gone]

    def _published(self, batch: str, kind: str, replaces: list[str], at: int | None = None) -> None:
        fs, hidden = self._fs(f"{self.path}/log/_{batch}.json")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(replaces).encode()))
        out.close()
        _, shown = self._fs(f"{self.path}/log/{time.time_ns() // 1000 if at is None else at:020d}-{batch}-{kind}.json")
        if not fs.rename(hidden, shown):
            raise RuntimeError(f"batch {batch} was not published")

    def _written(self, keyed: DataFrame) -> str:
        batch = uuid.uuid4().hex
        keyed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/batches/batch={batch}")
        return batch

    def put(self, records: DataFrame, order: list[str] = []) -> None:
        """Adds records; of a key's several the last counts, within a put by the order named, among puts the one published last.

        A record with a null in its identity has no key of its own and is an error: it would be found for another probe."""
        keyed = records.withColumn("store_key", probe_key(*[F.col(c) for c in IDENTITY]))
        none = F.lit(False)
        for c in IDENTITY:
            none = none | F.col(c).isNull()
        none = none | F.exists(F.map_values("condition"), lambda v: v.isNull())
        keyed = keyed.withColumn("store_key", F.when(none, F.raise_error(F.lit("a probe's identity has no nulls"))).otherwise(F.col("store_key")))
        rest = [c for c in keyed.columns if c != "store_key"]
        last = F.max_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest))
        one = keyed.groupBy("store_key").agg(last.alias("_r")).select("store_key", "_r.*")
        self._published(self._written(one.withColumn("bucket", self._bucket())), "put", [])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("store_key"), F.lit(BUCKETS)).cast("int")

    def _read(self, entries: list[_Entry]) -> DataFrame | None:
        """Live records of the entries; of a key's several those of the entry published last."""
        live = self._live(entries)
        if not live:
            return None
        at = self.spark.createDataFrame([(e.batch, e.at) for e in live], "batch string, _at long")
        found = self.spark.read.option("basePath", f"{self.path}/batches").option("mergeSchema", True).parquet(*[f"{self.path}/batches/batch={e.batch}" for e in live])
        rows = found.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(at), "batch")  # an entry for each batch since the last compaction
        rest = [c for c in found.columns if c not in ("batch", "bucket", "store_key")]
        newest = F.max_by(F.struct(*rest), F.struct("_at", "batch"))
        return rows.groupBy("bucket", "store_key").agg(newest.alias("_r")).select("bucket", "store_key", "_r.*")

    def records(self) -> DataFrame | None:
        """All live records, or None for a store that has none."""
        found = self._read(self._entries())
        return None if found is None else found.drop("bucket")

    def get(self, wanted: DataFrame, results: list[str]) -> DataFrame:
        """wanted (with the columns of an identity) with hit and the results named, null where the store holds no such probe.

        Repeated probes are each answered. The look-up is an equi-join on bucket and key; the wanted buckets prune the read."""
        keyed = wanted.withColumn("store_key", probe_key(*[F.col(c) for c in IDENTITY])).withColumn("_bucket", self._bucket())
        found = self._read(self._entries())
        if found is None:
            nothing = keyed.withColumn("hit", F.lit(False))
            return nothing.withColumns({c: F.lit(None).cast("double") for c in results}).drop("store_key", "_bucket")
        there = found.select(F.col("bucket").alias("_bucket"), "store_key", *[F.col(c) for c in results], F.lit(True).alias("_hit"))
        return keyed.join(there, ["_bucket", "store_key"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("store_key", "_bucket", "_hit")

    def compact(self) -> None:
        """The live batches become one. Others that are published meanwhile stay as they are, and a reader may use either form."""
        live = self._live(self._entries())
        if len(live) < 2:
            return
        batch = self._written(self._read(live))
        # the compacted records are as old as the newest that they stand for: a put that came in between is newer
        self._published(batch, "compaction", [e.batch for e in live], max(e.at for e in live))

    def vacuum(self, older_than_s: float = 86_400) -> int:
        """Deletes batches that a compaction at least so old stands for, with their entries, and unpublished ones as old. How many went."""
        entries = self._entries()
        gone = {b for e in entries for b in e.replaces}
        known = {e.batch for e in entries}
        limit = (time.time() - older_than_s) * 1000
        count = 0
        fs, _ = self._fs(self.path)
        for status in self._listed("batches"):
            batch = status.getPath().getName().removeprefix("batch=")
            if (batch in gone or batch not in known) and status.getModificationTime() <= limit:
                for log in self._listed("log"):
                    if f"-{batch}-" in log.getPath().getName():
                        fs.delete(log.getPath(), False)
                fs.delete(status.getPath(), True)
                count += 1
        return count
