"""Best-fit packing of documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so everything that decides a packing is a histogram of
at most ``capacity`` counts, whatever the number of documents. The driver plans on it, in runs of
equal sequences; tasks number the pieces of each length and look their place up in the plan.

The plan is the linear grouping scheme: large lengths, in descending order, fall into groups of equal
cardinality and are rounded up to the largest of their group; configurations of these few sizes are
chosen by bounded subset sums; actual lengths take the slots; small lengths go best-fit into what is
left, or into new sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from serospark.llm.texts import portions
from serospark.llm.tokens import encoder
from serospark.session import cut_lineage

CAPACITY = 4096
# Bytes of text whose ids are held at once; a longer text is still one portion.
PORTION_BYTES = 1 << 22
# The scheme is planned with each number of groups and each share of the capacity up to which lengths
# are small; the plan with the fewest sequences is kept.
GROUPS = (16, 64, 256)
SMALL = (1 / 8, 1 / 4, 1 / 2)
END_ID = 1


class Run(NamedTuple):
    """``count`` sequences holding the same lengths in the same order."""

    count: int
    lengths: tuple[int, ...]


def _equal_groups(histogram: np.ndarray, small: int, groups: int) -> list[list[list[int]]]:
    """Large lengths in descending order, dealt into groups of equal cardinality as ``[length, count]`` lists."""
    large = [(n, int(c)) for n, c in enumerate(histogram) if n > small and c][::-1]
    total = sum(c for _, c in large)
    room = -(-total // groups) if total else 1
    out: list[list[list[int]]] = []
    left = 0
    for length, count in large:
        while count:
            if not left:
                out.append([])
                left = room
            taken = min(left, count)
            out[-1].append([length, taken])
            left, count = left - taken, count - taken
    return out


def _fill(sizes: list[int], counts: list[int], space: int) -> list[int]:
    """How many of each size fill ``space`` best, preferring large ones; sizes descend."""
    mask, reach = (1 << (space + 1)) - 1, [1]
    for size, count in zip(sizes[::-1], counts[::-1]):
        bits = step = reach[-1]
        for _ in range(min(count, space // size)):
            step = (step << size) & mask
            bits |= step
        reach.append(bits)
    target, picked = reach[-1].bit_length() - 1, []
    for size, count, before in zip(sizes, counts, reach[-2::-1]):
        n = min(count, target // size)
        while not before >> (target - n * size) & 1:
            n -= 1
        picked.append(n)
        target -= n * size
    return picked


def _configurations(groups: list[list[list[int]]], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """``(times, copies of each group)`` until every group is used up."""
    sizes, counts = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
    first = 0
    while True:
        while first < len(sizes) and not counts[first]:
            first += 1
        if first == len(sizes):
            return
        counts[first] -= 1
        copies = _fill(sizes, counts, capacity - sizes[first])
        counts[first] += 1
        copies[first] += 1
        times = min(c // n for c, n in zip(counts, copies) if n)
        counts = [c - n * times for c, n in zip(counts, copies)]
        yield times, copies


def _substituted(groups: list[list[list[int]]], capacity: int) -> Iterator[Run]:
    """Configurations with actual lengths in their slots."""
    for times, copies in _configurations(groups, capacity):
        slots = []
        for g, n in enumerate(copies):
            for _ in range(n):
                slot, need = [], times
                while need:
                    item = groups[g][0]
                    taken = min(need, item[1])
                    slot.append([item[0], taken])
                    item[1] -= taken
                    need -= taken
                    if not item[1]:
                        groups[g].pop(0)
                slots.append(slot)
        while times:
            run = min(s[0][1] for s in slots)
            yield Run(run, tuple(s[0][0] for s in slots))
            times -= run
            for s in slots:
                s[0][1] -= run
                if not s[0][1]:
                    s.pop(0)


class _Open:
    """Runs of sequences by free room, with best-fit search."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.runs = capacity, 0, [[] for _ in range(capacity + 1)]

    def add(self, run: Run) -> None:
        room = self.capacity - sum(run.lengths)
        self.runs[room].append(run)
        self.rooms |= 1 << room

    def tightest(self, length: int) -> Run | None:
        """Take out a run with the least room for ``length``."""
        fitting = self.rooms >> length
        if not fitting:
            return None
        room = length + (fitting & -fitting).bit_length() - 1
        run = self.runs[room].pop()
        if not self.runs[room]:
            self.rooms ^= 1 << room
        return run


def plan_runs(histogram: np.ndarray, capacity: int, groups: int, small: float) -> list[Run]:
    """Runs of sequences holding every length of the histogram (``histogram[n]`` pieces of ``n`` tokens)."""
    limit = int(capacity * small)
    held = _Open(capacity)
    for run in _substituted(_equal_groups(histogram, limit, groups), capacity):
        held.add(run)
    for length in range(limit, 0, -1):
        count = int(histogram[length])
        while count and (run := held.tightest(length)):
            taken = min(count, run.count)
            if taken < run.count:
                held.add(Run(run.count - taken, run.lengths))
            held.add(Run(taken, (*run.lengths, length)))
            count -= taken
        per = capacity // length
        if count >= per:
            held.add(Run(count // per, (length,) * per))
        if count % per:
            held.add(Run(1, (length,) * (count % per)))
    return [run for runs in held.runs for run in runs]


def best_plan(histogram: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: tuple[float, ...] = SMALL) -> list[Run]:
    """The plan with the fewest sequences over all settings."""
    plans = (plan_runs(histogram, capacity, g, s) for g in groups for s in small)
    return min(plans, key=lambda runs: sum(run.count for run in runs))


def plan_table(runs: list[Run]) -> dict[str, np.ndarray]:
    """Slots sorted by length and rank: pieces of ``length`` with a rank from ``rank`` on go to ``sequence + rank``, at ``offset``."""
    rows, rank, sequence = [], {}, 0
    for count, lengths in runs:
        offset = 0
        for length in lengths:
            begin = rank.get(length, 0)
            rows.append((length, begin, sequence - begin, offset))
            rank[length] = begin + count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def cut_pieces(path: str, capacity: int, end_id: int, portion_bytes: int = PORTION_BYTES):
    """Arrow batches of ``(doc_id, text)`` to pieces, numbered per length within the task.

    A batch may hold many megabytes of text, and ids with their places take several times that, so a batch is worked
    on in portions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
        for batch in (part for whole in batches for part in portions(whole, 1, portion_bytes)):
            ids, sizes = encoder(path).closed(batch.column(1), end_id)
            count = -(-sizes // capacity)  # pieces of each document
            owner = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            start = piece * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            begin = (np.cumsum(sizes) - sizes)[owner] + start
            raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
            crcs = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())]
            # Ranks go on per length: the place among equal lengths of the batch, after those seen before.
            order = np.argsort(length, kind="stable")
            firsts = np.searchsorted(length[order], length[order])
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - firsts
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                 pa.array(np.full(len(length), task, np.int32)), pa.array(rank)], names=names)
    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS,
         small: tuple[float, ...] = SMALL, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece of a document.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents
    over ``capacity`` tokens are cut into full pieces and a rest. Repeated rows are packed as often as
    they occur, pieces of equal length in any order; null ids are packed like others. An empty table
    has no sequences. Only ``doc_id`` and ``text`` are read.
    """
    spark = documents.sparkSession
    pieces = cut_lineage(documents.select("doc_id", "text").mapInArrow(
        cut_pieces(tokenizer, capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(plan_table(best_plan(histogram, capacity, groups, small)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        top = np.int64(1) << np.int64(45)  # ranks of a length stay below this
        keys = slots["length"] * top + slots["rank"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * top + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slots["sequence"][at] + rank), pa.array(slots["offset"][at])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
