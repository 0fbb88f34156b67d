"""What the corpus operators share: tables, the shared folder, written intermediate results."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and lost executors lose nothing of it.

    What nobody forgets before goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    _on_disk(df.sparkSession, path, lambda fs, where: fs.deleteOnExit(where))
    return out


def _on_disk(spark: SparkSession, path: str, act: Callable) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(where.getFileSystem(spark._jsc.hadoopConfiguration()), where)


def forget(df: DataFrame | None) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        _on_disk(df.sparkSession, path, lambda fs, where: fs.delete(where, True))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows; one number, by a scan."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those used put into one, out of the way of an operator's own names; and what puts them back."""
    rest = [c for c in docs.columns if c not in used]
    here = [c for c in used if c in docs.columns]
    slim = docs.select(*here, F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("_rest"))
    return slim, lambda df: df.select(*[F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing learns from: crc32 of the id as text, by 5, leaves 0. A null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def lean(run: Callable) -> Callable:
    """run, on batches of bounded bytes (a row that has more is alone), giving its memory back when a task's rows are through: Python
    workers outlive tasks and wait beside the next ones."""

    def bounded(batch):
        if batch.nbytes <= BATCH_BYTES or batch.num_rows < 2:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from bounded(batch.slice(0, half))
            yield from bounded(batch.slice(half))

    def lean_run(batches):
        yield from run(part for batch in batches for part in bounded(batch))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return lean_run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches that are sorted by key, dealt anew so that no key's rows are parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        first, last = keys[0], keys[-1]
        if held and held[-1].column(batch.schema.get_field_index(key))[-1] != first:
            yield pa.Table.from_batches(held)
            held = []
        if first != last:
            at = len(keys) - 1
            lo = 0
            while lo < at:  # the first row of the last key
                mid = (lo + at) // 2
                if keys[mid] == last:
                    at = mid
                else:
                    lo = mid + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
