"""Arrow batches in Python tasks: one value per row in, new columns out."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies for the driver.

    On a cluster the package comes by `--py-files` or an installation; a path that a worker
    does not have is skipped.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, root] if p)


def to_lists(column: pa.Array) -> list:
    """Python values; lists of numbers go by way of one flat list."""
    if not pa.types.is_list(column.type) or column.null_count or not pa.types.is_integer(column.type.value_type):
        return column.to_pylist()
    flat, ends = column.flatten().to_numpy().tolist(), np.cumsum(column.value_lengths().to_numpy()).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def to_array(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind) or not pa.types.is_integer(kind.value_type):
        return pa.array(values, type=kind)
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    if values and all(isinstance(v, np.ndarray) for v in values):
        flat = np.concatenate(values).astype(kind.value_type.to_pandas_dtype(), copy=False)
    else:
        flat = np.fromiter(chain.from_iterable(values), kind.value_type.to_pandas_dtype(), int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=kind)


def map_rows(
    df: DataFrame,
    keep: list[str],
    reads: list[str],
    added: StructType,
    make: Callable[[], Callable[..., list[tuple]]],
    size: int | None = None,
) -> DataFrame:
    """Add columns computed in Python to the columns `keep`.

    `make` runs once per task and returns a function from one list per column of `reads` to
    one tuple per row. `keep` and `reads` are columns of `df`; rows stay where they are. With
    `size` a call gets at most that many bytes of what is read, or one row, and the task gives
    memory back when it begins, what earlier tasks of its worker left, and when it ends.
    """
    importable(df.sparkSession)
    keep_fields = [df.schema[c] for c in keep]
    schema = StructType([*keep_fields, *added.fields])
    arrow = to_arrow_schema(schema)
    order = [*keep, *(c for c in reads if c not in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if size:
            release_memory()
        work = make()
        for batch in batches:
            for part in slices(batch, [order.index(c) for c in reads], size=size):
                named = dict(zip(order, part.columns))
                rows = work(*(to_lists(named[c]) for c in reads))
                columns = [named[c] for c in keep]
                for k, field in enumerate(added.fields):
                    columns.append(to_array([r[k] for r in rows], arrow.field(len(keep) + k).type))
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)
        if size:
            release_memory()

    return df.select(*order).mapInArrow(run, schema)


#: Rows handled at a time inside a batch; bounds the memory of a task, not what it covers.
ROWS = 1000


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of text, bytes or a list of numbers; nothing for other kinds."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if pa.types.is_list(kind):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.zeros(len(column), np.int64)


def slices(
    batch: pa.RecordBatch, columns: list[int], rows: int = ROWS, size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """A batch in parts that are bounded in rows and, if asked, in the bytes of some columns.

    A row of more bytes than that is a part by itself.
    """
    ends = np.zeros(batch.num_rows + 1, np.int64)
    for k in columns if size else ():
        ends[1:] += _sizes(batch.column(k))
    np.cumsum(ends, out=ends)
    start = 0
    while start < batch.num_rows:
        stop = start + rows
        if size:
            stop = min(stop, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        stop = max(start + 1, min(stop, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give what a task no longer needs back: its worker lives on with the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
