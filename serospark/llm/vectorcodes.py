"""Product codes of vectors on whole numbers: every part of a vector becomes the index of its codebook's nearest entry.

Nearest entries are found by slicing and intersecting. Per dimension of a part position the entries'
coordinates are sorted, and every rank carries the mask of all entries before it. A radius selects one
run of ranks per dimension; the exclusive or of the two masks at its ends is the set of entries inside
it, and the sets of all dimensions are ANDed. What is left lies in the box around the part. If the best of
these is no farther than the radius, nothing outside the box can beat it; else the radius grows to that
distance, or doubles where the box was empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from serospark.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Components beyond this would not leave room for squares and sums in 64 bits.
LARGEST = 1 << 27
_ROWS = 8192


class Coded(NamedTuple):
    """``rows (id, label, codes, error)`` and ``codebooks[part, entry, place]``."""

    rows: DataFrame
    codebooks: np.ndarray


class Slices:
    """The sorted coordinates and prefix masks of at most 64 entries, and the radius to begin with."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        bits = np.left_shift(np.uint64(1), np.arange(len(entries), dtype=np.uint64))
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[o, j] for j, o in enumerate(order.T)]
        self.masks = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[o])]) for o in order.T]
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        apart = np.sort(apart, axis=1)[:, min(1, len(entries) - 1)]
        self.radius = max(1, isqrt(int(np.median(apart))))

    def inside(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The mask of the entries in the box of each row's radius."""
        masks = np.full(len(parts), ~np.uint64(0))
        for j, (coordinates, prefix) in enumerate(zip(self.sorted, self.masks)):
            low = np.searchsorted(coordinates, parts[:, j] - radius, "left")
            high = np.searchsorted(coordinates, parts[:, j] + radius, "right")
            masks &= prefix[high] ^ prefix[low]
        return masks

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(indexes, squared distances)``; ties go to the lower index."""
        index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        rows, radius = np.arange(len(parts)), np.full(len(parts), self.radius)
        while len(rows):
            masks = self.inside(parts[rows], radius)
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            owner, entry = np.nonzero(bits)
            apart = ((parts[rows[owner]] - self.entries[entry]) ** 2).sum(axis=1)
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
            found = owner[begins]
            best = np.minimum.reduceat(apart, begins) if len(begins) else apart
            equal = np.flatnonzero(apart == np.repeat(best, np.diff(np.append(begins, len(owner)))))
            first = equal[np.append(True, owner[equal][1:] != owner[equal][:-1])] if len(equal) else equal
            index[rows[found]], distance[rows[found]] = entry[first], best
            settled = best <= radius[found] ** 2
            grown = 2 * radius
            grown[found] = [isqrt(int(b)) + 1 for b in best]
            open_rows = np.ones(len(rows), bool)
            open_rows[found[settled]] = False
            rows, radius = rows[open_rows], grown[open_rows]
        return index, distance


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.floor(SCALE * _matrix(batch.column(2)).astype(np.float64))
        if values.size and np.abs(values).max() > LARGEST:
            raise ValueError(f"components must stay within {LARGEST // SCALE} either way")
        flat = pa.array(values.astype(np.int32).ravel())
        size = values.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "label", "v"])


def _assign(codebooks: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(codes[row, part], squared distances[row, part])``."""
    parts, _, size = codebooks.shape
    codes, apart = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), np.int64)
    for p in range(parts):
        slices = Slices(codebooks[p])
        for at in range(0, len(vectors), _ROWS):
            own = vectors[at:at + _ROWS, p * size:(p + 1) * size].astype(np.int64)
            codes[at:at + _ROWS, p], apart[at:at + _ROWS, p] = slices.nearest(own)
    return codes, apart


def _sums(codebooks: np.ndarray):
    parts, entries, size = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0))
            if not len(vectors):
                continue
            cells = (_assign(codebooks, vectors)[0] + np.arange(parts) * entries).ravel()
            counts += np.bincount(cells, minlength=len(counts))
            np.add.at(sums, cells, vectors.astype(np.int64).reshape(-1, size))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cell", "n", "sums"])
    return run


def _codes(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes, apart = _assign(codebooks, _matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(apart.sum(axis=1))],
                names=["id", "label", "codes", "error"])
    return run


def encode(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> Coded:
    """Product codes of all vectors, with codebooks fitted on all of them.

    Rows whose vector is null, empty or holds a null or non-finite component are dropped, and so are
    vectors shorter than the longest kept one, whose length ``parts`` must divide. Components become
    ``floor(256 x)``. The codebook of a part position begins as that part of the first ``entries`` rows by id
    (null ids last, equal ids by vector); each round replaces every used entry by the floored mean of
    its parts. Rows may repeat and all are coded. No kept row gives no rows and empty codebooks. Only the three
    named columns are read. Sums of a round are added up per task, so what reaches the driver is ``parts x entries`` rows.
    """
    if not 1 <= entries <= 64:
        raise ValueError("a mask holds 1 to 64 entries")
    kinds = dict(vectors.dtypes)
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v")).filter(
        F.col(vector_column).isNotNull() & (F.size(vector_column) > 0) & finite)
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    if longest % parts:
        raise ValueError(f"{parts} parts do not divide {longest} components")
    kinds = f"id {kinds[id_column]}, label {kinds[label_column]}"
    whole = cut_lineage(kept.filter(F.size("v") == longest).mapInArrow(_whole, f"{kinds}, v array<int>"), "vectors")
    first = whole.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    size = longest // parts
    codebooks = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    if not len(first):
        return Coded(whole.select("id", "label", F.col("v").alias("codes"), F.lit(0).cast("long").alias("error")), codebooks)
    for _ in range(rounds):
        made = whole.select("v").mapInArrow(_sums(codebooks), "cell long, n long, sums array<long>")
        total = made.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(size)])
        for row in total.collect():  # at most parts x entries rows
            codebooks[divmod(row["cell"], len(first))] = [row[f"s{j}"] // row["n"] for j in range(size)]
    return Coded(whole.mapInArrow(_codes(codebooks), f"{kinds}, codes array<int>, error long"), codebooks)


def code_text(codes: Column) -> Column:
    """Two lowercase hex digits for each index."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def codebooks_digest(codebooks: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
