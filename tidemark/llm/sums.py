"""Sums of arrays that tasks make, added up on the executors chunk by chunk."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Of what chunks() makes.
SCHEMA = "chunk int, part int, data binary"
#: Numbers of a chunk.
CHUNK = 1 << 18


def chunks(total: np.ndarray, parts: int = 8) -> pa.RecordBatch:
    """A task's array, cut into the chunks that summed() adds up; parts: sums to which the tasks are dealt first.

    Sent in single precision; whole numbers under 16 million stay exact, and so do
    their sums, which are in double.
    """
    flat = np.ascontiguousarray(total, np.float32).ravel()
    data = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
    part = TaskContext.get().partitionId() % parts
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(data), dtype=np.int32)), pa.array([part] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "part", "data"])


def summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of all tasks' arrays of that shape, from what chunks() made of them.

    Each group is one chunk of some of the tasks, so no task holds a whole array of
    every other task, and the driver gets each chunk a few times only.
    """

    def add(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("data")))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(int(np.prod(shape)))
    for r in parts.groupBy("chunk", "part").applyInArrow(add, "chunk int, data binary").toLocalIterator():
        data = np.frombuffer(r.data)
        total[r.chunk * CHUNK : r.chunk * CHUNK + len(data)] += data
    return total.reshape(shape)


def summed_rows(tasks: DataFrame, shape: tuple[int, ...], sums: int = 4) -> np.ndarray:
    """The sum of small arrays of that shape, one in each row of tasks(data binary).

    Rows are added as they stream by, in a few tasks, whatever their number.
    """

    def add(batches):
        total = np.zeros(int(np.prod(shape)))
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    got = tasks.repartition(sums).mapInArrow(add, "data binary").collect()
    return reduce(np.add, (np.frombuffer(r.data) for r in got)).reshape(shape)
