"""Completion of a table of distances by soft-thresholded singular values, fitted by alternating ridge.

The low-rank table ``A B'`` minimises half the squared error on the known cells plus ``penalty`` times the sum of its
singular values. That sum is the least of ``(|A|^2 + |B|^2) / 2`` over all ways to write the table as a product,
so each side is a ridge regression on the other, and no half round makes the objective worse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serospark.functions.hashing import unit_hash
from serospark.models.sums import HeldSums, list_column, stacked, summed
from serospark.plans.skew import LIMIT, lookup, sliced_join, stored_hot_keys
from serospark.session import cut_lineage, drop_table


@dataclass
class Completion:
    """Factors of both sides ``(name, f)``, the known cells ``(r, c, x)`` and the objective after each round."""

    rows: DataFrame
    columns: DataFrame
    known: DataFrame
    objective: list[float]
    limit: int

    def singular_values(self) -> np.ndarray:
        """Singular values of the low-rank table, largest first: roots of the product of the factors' Gram matrices."""
        first, second = (_gram(side) for side in (self.rows, self.columns))
        return np.sort(np.sqrt(np.maximum(np.linalg.eigvals(first @ second).real, 0)))[::-1]

    def fill(self, wanted: DataFrame, row: str = "a", column: str = "b") -> DataFrame:
        """``wanted`` with ``filled``: the known value of a cell, else that of the low-rank table; cells of unmeasured names drop."""
        out = lookup(wanted, self.rows.select(F.col("name").alias(row), F.col("f").alias("_fa")), row, "inner", self.limit)
        out = lookup(out, self.columns.select(F.col("name").alias(column), F.col("f").alias("_fb")), column, "inner", self.limit, wanted)
        out = lookup(out, self.known.select(F.col("r").alias(row), F.col("c").alias(column), "x"), [row, column], "left", self.limit, wanted)
        dot = F.aggregate(F.zip_with("_fa", "_fb", lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
        return out.withColumn("filled", F.coalesce("x", dot)).select(*wanted.columns, "filled")


def _gram(side: DataFrame) -> np.ndarray:
    size = len(side.first()["f"])
    products = side.agg(*[F.sum(F.get("f", F.lit(i)) * F.get("f", F.lit(j))) for i in range(size) for j in range(size)]).first()
    return np.array(products, float).reshape(size, size)


def _half(known: DataFrame, own: str, other: str, factors: DataFrame, rank: int, penalty: float, hot: DataFrame) -> DataFrame:
    """``(name, f, gain)`` of one side: its ridge solution given the other side's factors, and what that takes off the objective."""
    kind = dict(known.dtypes)[own]
    i, j = np.triu_indices(rank)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or HeldSums(batch.column(0).type)
            if batch.num_rows:
                f = stacked(batch.column(2))
                yield from held.add(batch.column(0), np.c_[f[:, i] * f[:, j], f * batch.column(1).to_numpy()[:, None]])
        if held:
            yield from held.rest()

    def solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = stacked(batch.column(1))
            system = np.zeros((len(sums), rank, rank))
            system[:, i, j] = system[:, j, i] = sums[:, :len(i)]
            system += penalty * np.eye(rank)
            right = sums[:, len(i):]
            f = np.linalg.solve(system, right[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(f), pa.array((right * f).sum(axis=1))], names=["name", "f", "gain"])

    joined = sliced_join(known, factors.select(F.col("name").alias(other), "f"), [other], "inner", hot).select(own, "x", "f")
    parts = joined.mapInArrow(products, f"name {kind}, sums array<double>")
    return cut_lineage(summed(parts, len(i) + rank).mapInArrow(solutions, f"name {kind}, f array<double>, gain double"), "factors")


def soft_impute(
    cells: DataFrame, rank: int = 10, penalty: float = 1.0, rounds: int = 100, tolerance: float = 1e-5, seed: int = 42,
    row: str = "a", column: str = "b", value: str = "dist", limit: int = LIMIT,
) -> Completion:
    """Fit ``(row, column, value)``; repeated cells count with their mean, null values and names are left out.

    ``rank`` is the most singular values kept; with enough of them the result is that of soft-thresholding the singular values
    of the filled table by ``penalty`` until it settles. Rounds end when one takes off less than ``tolerance`` of the
    objective. Names stay as they are, of any type. Sums of a name with very many cells are added up in tasks first.
    """
    known = cells.dropna(subset=[row, column, value]).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.avg(F.col(value).cast("double")).alias("x"))
    known = cut_lineage(known, "cells")
    squares, mean, n = known.agg(F.sum(F.col("x") * F.col("x")), F.avg(F.abs("x")), F.count("x")).first()
    scale = 2 * ((mean or 0.0) / rank) ** 0.5
    start = F.array(*[(unit_hash(F.col("name").cast("string"), F.lit(k), seed=seed) - 0.5) * scale + scale / 2 for k in range(rank)])
    columns = cut_lineage(known.select(F.col("c").alias("name")).distinct().select("name", start.alias("f"), F.lit(0.0).alias("gain")), "factors")
    hot = {side: stored_hot_keys(known, side, limit) for side in "rc"}
    rows, objective = None, []
    for _ in range(max(1, rounds)):
        made = _half(known, "r", "c", columns, rank, penalty, hot["c"])
        for old in (rows, columns):
            if old is not None:
                drop_table(old)
        rows, columns = made, _half(known, "c", "r", made, rank, penalty, hot["r"])
        size = rows.agg(F.sum(F.aggregate("f", F.lit(0.0), lambda acc, v: acc + v * v))).first()[0] or 0.0
        gain = columns.agg(F.sum("gain")).first()[0] or 0.0
        objective.append(((squares or 0.0) - gain + penalty * size) / 2)
        if len(objective) > 1 and objective[-2] - objective[-1] <= tolerance * objective[-2]:
            break
    return Completion(rows.select("name", "f"), columns.select("name", "f"), known, objective, limit)
