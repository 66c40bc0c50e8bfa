"""Sums of arrays per name, added up in tasks first so that a name with many rows is a few partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Names whose sums a task holds before it hands them on.
HELD_NAMES = 50_000


def list_column(values: np.ndarray) -> pa.Array:
    """One list of numbers per row of ``values``."""
    flat = np.ascontiguousarray(values, np.float64).reshape(len(values), -1)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))


def stacked(column: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class HeldSums:
    """Sums per name within a task; ``add`` yields a batch ``(name, sums)`` whenever too many are held."""

    def __init__(self, kind: pa.DataType, limit: int = HELD_NAMES):
        self.kind, self.limit, self.held = kind, limit, {}

    def _out(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(self.held), self.kind), list_column(np.stack(list(self.held.values())))], names=["name", "sums"])
        self.held = {}
        return batch

    def add(self, names: pa.Array, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        coded = names.dictionary_encode()
        total = np.zeros((len(coded.dictionary), values.shape[1]))
        np.add.at(total, coded.indices.to_numpy(), values)
        for name, own in zip(coded.dictionary.to_pylist(), total):
            self.held[name] = self.held[name] + own if name in self.held else own
        if len(self.held) > self.limit:
            yield self._out()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._out()


def summed(parts: DataFrame, size: int) -> DataFrame:
    """``(name, sums)`` of the partial sums of all tasks."""
    return parts.groupBy("name").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).alias("sums"))
