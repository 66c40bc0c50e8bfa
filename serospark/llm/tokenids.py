"""Token-id files in Simple-8b: 64-bit words of a 4-bit selector and up to 60 ids of equal width.

A file set is a Parquet table of blocks. A block holds whole documents and is self-contained:

- ``part, block, start``: its place; ``start`` counts the ids of the part before it;
- ``doc_ids, lengths``: its documents in order and their numbers of ids;
- ``words``: the 64-bit words, little-endian; ``offsets``: the first word of each run of ``RUN`` ids,
  so that runs can be decoded alone; ``escapes``: where an escape selector stands, whose following
  word is a raw 64-bit id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from serospark.llm.tokens import encoder

# Fixed values of the code: (ids per word, bits per id), by selector from 1 on. Selector 0 is the escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
RUN = 16_384
BLOCK_IDS = 65_536
END_ID = 1

BLOCKS = ("part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, "
          "words binary, offsets array<int>, escapes array<int>")


_BITS_16 = np.array([max(1, n.bit_length()) for n in range(1 << 16)], np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1."""
    bits = _BITS_16[(ids & np.uint64(0xFFFF)).astype(np.uint16)]
    for part in (16, 32, 48):
        over = ids >= np.uint64(1 << part)
        if not over.any():
            break
        bits[over] = part + _BITS_16[((ids[over] >> np.uint64(part)) & np.uint64(0xFFFF)).astype(np.uint16)]
    return bits


def _groups(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and selector of each word of a run; the last word may be filled up with zeros."""
    n = len(bits)
    padded = np.concatenate([bits, np.ones(60, np.uint8)])
    selector = np.where(bits <= 60, len(SELECTORS), 0).astype(np.uint8)
    at = None  # where the sparser selector fits
    for s in range(len(SELECTORS) - 1, 0, -1):  # a denser word fits only where the sparser one does
        count, width = SELECTORS[s - 1]
        low = padded <= width
        if at is None or 4 * len(at) > n:
            fits = low[:n].copy()
            for k in range(1, count):
                fits &= low[k:n + k]
            at = np.flatnonzero(fits)
        else:
            for k in range(count):
                at = at[low[at + k]]
        if not len(at):
            break
        selector[at] = s
    step = np.array([1] + [c for c, _ in SELECTORS])[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    return starts, selector[starts]


def encode_run(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of at most ``RUN`` ids (unsigned 64-bit), and the positions of escapes among them."""
    starts, chosen = _groups(bit_lengths(ids))
    size = 1 + (chosen == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[rows] + 1] = ids[starts[rows]]
            continue
        count, width = SELECTORS[s - 1]
        value = np.full(len(rows), int(s) << 60, np.uint64)
        for k in range(count):
            value |= padded[starts[rows] + k] << np.uint64(k * width)
        words[place[rows]] = value
    return words, place[chosen == 0]


def encode_ids(ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """``(words, offsets, escapes)`` of any number of ids."""
    words, offsets, escapes, at = [], [], [], 0
    for i in range(0, len(ids), RUN):
        run, escaped = encode_run(ids[i:i + RUN].astype(np.uint64))
        offsets.append(at)
        escapes.extend((escaped + at).tolist())
        words.append(run)
        at += len(run)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)).astype("<u8").tobytes(), offsets, escapes


def decode_ids(words: bytes, offsets: list[int], escapes: list[int], n_ids: int) -> np.ndarray:
    """The ids of a block, all its words at once."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    coded = np.frombuffer(words, "<u8")
    selector = (coded >> np.uint64(60)).astype(np.int64)
    escaped = np.asarray(escapes, np.int64)
    count = np.array([1] + [c for c, _ in SELECTORS] + [0])[selector]
    count[escaped + 1] = 0
    selector[escaped + 1] = -1
    # The zeros that fill up the last word of a run are no ids: its count ends with the run.
    offsets = np.asarray(offsets, np.int64)
    ends = np.append(offsets[1:], len(coded))
    want = np.minimum(RUN, n_ids - RUN * np.arange(len(offsets)))
    last = np.where(np.isin(ends - 1, escaped + 1), ends - 2, ends - 1)
    total = np.add.reduceat(count, offsets)
    kept = count.copy()
    kept[last] -= total - want
    place = np.cumsum(kept) - kept
    out = np.zeros(n_ids + 60, np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == 0:
            out[place[rows]] = coded[rows + 1]
        elif s > 0:
            per, width = SELECTORS[s - 1]
            mask = np.uint64((1 << width) - 1)
            for k in range(per):
                live = rows[kept[rows] > k]
                out[place[live] + k] = (coded[live] >> np.uint64(k * width)) & mask
    return out[:n_ids]


def encode_partition(path: str, end_id: int):
    """Arrow batches of ``(doc_id, text)`` to rows of ``BLOCKS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        docs, sizes, ids, block, start = [], np.zeros(0, np.int64), np.zeros(0, np.uint32), 0, 0

        def flush(n: int) -> pa.RecordBatch:
            size = int(sizes[:n].sum())
            words, offsets, escapes = encode_ids(ids[:size])
            row = (part, block, start, size, docs[:n], sizes[:n].tolist(), words, offsets, escapes)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            own, counts = encoder(path).closed(batch.column(1), end_id)
            docs, sizes, ids = docs + batch.column(0).to_pylist(), np.concatenate([sizes, counts]), np.concatenate([ids, own])
            ends = np.cumsum(sizes)
            while len(ends) and ends[-1] >= BLOCK_IDS:
                n = int(np.searchsorted(ends, BLOCK_IDS)) + 1
                size = int(ends[n - 1])
                yield flush(n)
                start, block, docs, sizes, ids, ends = start + size, block + 1, docs[n:], sizes[n:], ids[size:], ends[n:] - size
        if docs:
            yield flush(len(docs))
    return run


def write_ids(documents: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode ``documents (doc_id, text)`` in ascending ``doc_id`` order into block files under ``path``.

    A null text is empty, a null id comes first, rows of equal id are ordered by text and all kept.
    Each document ends with ``end_id``. Documents are dealt by ranges of ids, so that part ``p``
    precedes part ``p + 1``; other columns are not read. An empty table writes no blocks.
    """
    spark = documents.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = documents.select("doc_id", "text").repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ranged.mapInArrow(encode_partition(tokenizer, end_id), BLOCKS).write.parquet(path)


def _decode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row["words"], row["offsets"], row["escapes"], row["n_ids"])
            lengths = np.array(row["lengths"], np.int64)
            begin = np.cumsum(lengths) - lengths
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lengths), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                 pa.array(begin + row["start"]), pa.array(lengths), pa.array(crcs, pa.int64())],
                names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from the files; ``start`` counts the ids of all documents before."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per written part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = blocks.mapInArrow(_decode_partition, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
