"""Sums of small arrays over a stored table: the one data access of the iterative learners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spindlescope.session import cut_lineage

#: Numbers per row of a partial sum.
CHUNK = 1 << 15
#: Rows of a block that a function sees at once.
BLOCK = 4096


def stored_rows(df: DataFrame, *columns: str, vector: str = "vector") -> DataFrame:
    """Features as arrays (``x``) and further numeric ``columns``, written once: every pass reads them again."""
    return cut_lineage(df.select(vector_to_array(vector).alias("x"), *[F.col(c).cast("double").alias(c) for c in columns]))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(feature matrix, other columns) per block of at most BLOCK rows; columns without the array ``x`` come alone."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            rest = {c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names if c != "x"}
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield x, rest


def block_sums(rows: DataFrame, fn: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``fn(x, columns)`` over all blocks of rows, ``size`` numbers."""
    def whole(parts):
        acc = np.zeros(size)
        for x, rest in parts:
            acc += np.asarray(fn(x, rest), dtype=float).ravel()
        return acc
    return task_sums(rows, whole, size)


def task_sums(rows: DataFrame, fn: Callable[[Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]], np.ndarray], size: int) -> np.ndarray:
    """Sum over all tasks of what ``fn`` makes of a task's blocks, in the order of its rows; ``size`` numbers.

    The partial sums are cut into chunks, dealt out by chunk and added again in tasks, so the driver receives ``size``
    numbers, however many tasks there are.
    """
    def partial(batches):
        acc = np.asarray(fn(blocks(batches)), dtype=float).ravel()
        at = range(0, size, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(at))), pa.int32()), pa.array([acc[a:a + CHUNK].tobytes() for a in at], pa.binary())], ["chunk", "v"])

    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column("chunk").to_pylist(), batch.column("v")):
                numbers = np.frombuffer(v.as_buffer(), float)
                acc[c] = acc[c] + numbers if c in acc else numbers.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["chunk", "v"])

    schema = "chunk int, v binary"
    out = np.zeros(size)
    for r in rows.mapInArrow(partial, schema).repartition("chunk").mapInArrow(add, schema).collect():
        numbers = np.frombuffer(r["v"], float)
        out[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(numbers)] = numbers
    return out


def keyed_frame(rows: DataFrame, partial: Callable[[np.ndarray, dict[str, np.ndarray]], dict[int, np.ndarray]], combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
                finish: Callable[[int, np.ndarray], tuple], schema: str) -> DataFrame:
    """Per key, one array combined over all blocks of rows, and what ``finish(key, array)`` makes of it (a row of ``schema``).

    Tasks combine their own blocks first; then the arrays of a key meet in one task, as many as there were tasks.
    """
    def first(batches):
        acc: dict[int, np.ndarray] = {}
        for x, rest in blocks(batches):
            for k, v in partial(x, rest).items():
                acc[k] = combine(acc[k], v) if k in acc else v
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([np.ascontiguousarray(v, float).tobytes() for v in acc.values()], pa.binary())], ["key", "v"])

    def second(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("key").to_pylist(), batch.column("v")):
                v = np.frombuffer(v.as_buffer(), float)
                acc[k] = combine(acc[k], v) if k in acc else v
        found = [finish(k, v) for k, v in acc.items()]
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=arrow)

    kind = rows.sparkSession.createDataFrame([], schema).schema
    names, arrow = kind.names, to_arrow_schema(kind)
    return rows.mapInArrow(first, "key bigint, v binary").repartition("key").mapInArrow(second, kind)


def keyed(*args) -> list:
    """The rows of ``keyed_frame`` on the driver: what ``finish`` returns, one row per key."""
    return keyed_frame(*args).collect()
