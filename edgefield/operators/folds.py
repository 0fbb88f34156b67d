"""Order-dependent folds by key: what becomes of a row depends on all rows of its key before it, and no sum or window says it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt out so that those with equal keys, nulls too, are in one task, whatever made them.

    Dealt by a hash of the keys, not by the keys: rows that a join or an aggregation dealt by the keys already would not be dealt again, and
    such a join may turn out small enough at run time to be done where its rows lie, which leaves a key's rows in several tasks."""
    return rows.repartition(F.xxhash64(*keys))


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict[str, Any]], tuple], keep: list[str], out: str) -> DataFrame:
    """For each row the columns kept and those of out (a DDL list): step(state, row) changes the key's state and gives their values.

    Rows are sorted by key and order, so a task holds one key's state and one batch of rows, however many rows a key has; a key's rows
    follow one another in one task, which is what the order asks for. A null key is a key. The order decides wholly, so that a
    task that runs again does the same: rows that tie in it have to be alike to the step."""
    schema = StructType([*rows.select(*keep).schema.fields, *StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in StructType.fromDDL(out).fields]

    def run(batches):
        of, state, begun = None, None, False
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            told: list[tuple] = []
            for i, k in enumerate(columns[key]):
                if not begun or k != of:
                    of, state, begun = k, start(), True
                told.append(step(state, {c: v[i] for c, v in columns.items()}))
            made = list(zip(*told)) if told else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), *(pa.array(v, arrow.field(n).type) for n, v in zip(names, made))], schema=arrow)

    return dealt(rows, [key]).sortWithinPartitions(key, *order).mapInArrow(run, schema)
