"""Sums of arrays over all rows: one array per task, added up in a few tasks, the result on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PARTS = 16  # partial sums that reach the driver
_SCHEMA = "part int, lines int, numbers binary"


def _plus(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Sum of two matrices of as many lines; the shorter lines end in zeros."""
    if a is None:
        return b
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    out = a.copy()
    out[:, : b.shape[1]] += b
    return out


def _row(part: int, matrix: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([len(matrix)], pa.int32()), pa.array([matrix.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "lines", "numbers"])


def matrix_sum(rows: DataFrame, of_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: type = np.int64) -> np.ndarray | None:
    """The sum of the matrices that ``of_task`` makes of each task's batches; None without tasks.

    A matrix must fit a task and the driver ``PARTS`` times: its size is set by parameters or by
    the width of the data, never by their number.
    """

    def read(lines: int, numbers: bytes) -> np.ndarray:
        return np.frombuffer(numbers, kind).reshape(lines, -1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(TaskContext.get().partitionId() % PARTS, np.ascontiguousarray(of_task(batches), kind))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lines, numbers in zip(batch.column("lines").to_pylist(), batch.column("numbers"), strict=True):
                total = _plus(total, read(lines, numbers.as_py()))
        if total is not None:
            yield _row(0, total)

    total = None
    for r in rows.mapInArrow(make, _SCHEMA).repartition(PARTS, "part").mapInArrow(add, _SCHEMA).collect():
        total = _plus(total, read(r["lines"], bytes(r["numbers"])))
    return total
