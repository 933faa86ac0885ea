"""Helpers shared by the training-data operators: shared-folder tables, input columns, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast; the row count is checked before the hint is given.
BROADCAST_ROWS = 100_000
#: Rows that a Python function sees at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-tables"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Hint how a join takes this side: broadcast up to BROADCAST_ROWS rows (counted) of row_bytes each, a merge join beyond.

    row_bytes bounds a row of short columns; sides with longer ones say so, and get fewer rows.
    """
    n = df.count() if rows is None else rows
    return df.hint("broadcast") if n * row_bytes <= BROADCAST_ROWS * 64 else df.hint("merge")


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, upper and lower case taken as the same."""
    taken = {c.lower() for f in frames for c in f.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def map_rows(df: DataFrame, fn: Callable[[list], tuple], schema: str, *cols: str, after: Callable[[], None] | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Arrow batches through fn, which takes one list per column (Arrow arrays as they are) and returns one list per output column.

    A call sees `rows` rows at most. after runs when a task has read its rows: Python workers live on, so what a function has cached is given back there.
    """
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):  # small slices bound what a worker holds as Python objects
                batch = whole.slice(at, rows)
                out = fn(*(c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        if after is not None:
            after()

    return df.select(*(F.col(c) for c in cols)).mapInArrow(run, struct)


def grouped(batches, key: list[str], flush):
    """Runs flush on the rows of each key; batches come sorted by key, and a key may span batches."""
    last, held = None, []
    for batch in batches:
        k = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in key]
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in k], axis=0)
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(starts, starts[1:], strict=False):
            name = tuple(c[x] for c in k)
            if name != last and held:
                if (got := flush(pa.Table.from_batches(held))) is not None:
                    yield got
                held = []
            last = name
            held.append(batch.slice(x, y - x))
    if held and (got := flush(pa.Table.from_batches(held))) is not None:
        yield got


def whole_groups(batches, key: list[str]):
    """Tables that hold the rows of one key or more, each whole; batches come sorted by key."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in key]
        change = np.zeros(batch.num_rows, bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in k], axis=0)
        change[0] = tuple(c[0] for c in k) != last
        starts = np.flatnonzero(change)
        if len(starts):
            cut = int(starts[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
        last = tuple(c[-1] for c in k)
    if held:
        yield pa.Table.from_batches(held)
