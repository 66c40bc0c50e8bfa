"""SimHash near-dedup: 64-bit fingerprints linked at a few differing bits by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of at most 23 bits. Two fingerprints that differ in at most
four bits split these errors over the segments, and by pigeonhole one of two cases holds:

- a segment is equal and another has at most two errors: key of the equal segment and a Golay key of
  the other;
- every segment has an error, so two have exactly one and the third at most two: halves of the first
  two are equal (one half each), and the third gives a Golay key.

Every fingerprint emits its keys of all these kinds, so every link meets under some key, where it is
verified by counting bits. A key with very many different fingerprints is not compared pair by pair:
its fingerprints meet others at the midpoints instead (all values at two bits or less).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from serospark.llm import golay
from serospark.llm.common import salted_lookup
from serospark.llm.components import components
from serospark.llm.texts import single_spaced
from serospark.session import cut_lineage

WORDS = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Different fingerprints under one key that are compared in memory; more meet at midpoints.
BUCKET = 2048
_SHINGLES = 1 << 16


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text (UTF-8, A-Z put in lower case), repeats included, in portions; none of a blank text."""
    spaced = single_spaced(text.lower())
    if not spaced:
        return
    gaps = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(spaced))
    last = max(0, len(starts) - words)
    starts, ends = starts[:last + 1], ends[-(last + 1):]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES):
        spans = zip(starts[at:at + _SHINGLES].tolist(), ends[at:at + _SHINGLES].tolist())
        yield np.array([digest(spaced[a:b], SEED) for a, b in spans], "<u8")


def majority(portions: Iterable[np.ndarray]) -> int:
    """The 64 bits that are set in over half of all hashes; zero if there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in portions:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text (UTF-8): a bit is 1 if over half the shingle hashes set it."""
    return majority(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py() or b"") for t in batch.column(batch.num_columns - 1).cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(documents: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, fp)``: the signed 64-bit fingerprint of ``text`` beside the named columns, row by row."""
    kinds = dict(documents.dtypes)
    return documents.select(*keys, "text").mapInArrow(_fingerprints, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fp long")


def fuzzy_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, owners)``: the link keys of unsigned fingerprints and the position each belongs to."""
    parts = [((values >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.keys(p) for p in parts]
    halves = [(p & 0x7FF, p >> 11) for p in parts]
    plain = [(np.int64(kind), parts[i], j) for kind, (i, j) in enumerate(permutations(range(3), 2))]
    for k, (x, y) in product(range(3), product(range(2), repeat=2)):
        i, j = (s for s in range(3) if s != k)
        plain.append((np.int64(len(plain)), halves[i][x] << 11 | halves[j][y], k))
    keys, owners, rows = [], [], np.arange(len(values))
    for kind, exact, fuzzy in plain:
        for code in near[fuzzy].T:
            live = code >= 0
            keys.append((kind << 40 | exact << 12 | code)[live])
            owners.append(rows[live])
    return np.concatenate(keys), np.concatenate(owners)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy()
        for at in range(0, len(values), 2000):
            own = values[at:at + 2000]
            keys, owners = fuzzy_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[owners])], names=["key", "fp"])


def forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints; no more edges than members."""
    left, edges = values.view(np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            close = np.bitwise_count(left ^ one) <= max_bits
            if close.any():
                found = left[close]
                edges.extend((int(np.int64(one)), v) for v in found.view(np.int64).tolist())
                front.extend(found)
                left = left[~close]
    return edges


def _link(max_bits: int, bucket: int):
    """Batches of ``(key, fp)`` sorted by both to ``(a, b, full)``: links, or members of an overfull key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, overfull = np.zeros(0, np.int64), None, False

        def out(pairs: list, full: np.ndarray) -> pa.RecordBatch:
            a, b = ([p[i] for p in pairs] for i in range(2))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array(a, np.int64), full])), pa.array(np.concatenate([np.array(b, np.int64), full])),
                 pa.array(np.arange(len(a) + len(full)) >= len(a))], names=["a", "b", "full"])

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            pairs, full = [], []
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(begins[1:], len(keys))
            if keys[0] == held_key:
                first, begins, ends = values[:ends[0]], begins[1:], ends[1:]
                if overfull:
                    full.append(first)
                else:
                    held = np.concatenate([held, first])
                    if len(held) > bucket:
                        full.append(held)
                        held, overfull = held[:0], True
            if len(begins):
                pairs.extend(forest(held, max_bits))
                # The last key may go on in the next batch.
                held, held_key, overfull = values[begins[-1]:], keys[-1], False
                sizes = ends[:-1] - begins[:-1]
                twos = begins[:-1][sizes == 2]
                close = twos[np.bitwise_count(values[twos].view(np.uint64) ^ values[twos + 1].view(np.uint64)) <= max_bits]
                pairs.extend(zip(values[close].tolist(), values[close + 1].tolist()))
                for begin, size in zip(begins[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                    if size > bucket:
                        full.append(values[begin:begin + size])
                    else:
                        pairs.extend(forest(values[begin:begin + size], max_bits))
                if len(held) > bucket:
                    full.append(held)
                    held, overfull = held[:0], True
            if pairs or full:
                yield out(pairs, np.concatenate(full) if full else np.zeros(0, np.int64))
        if rest := forest(held, max_bits):
            yield out(rest, np.zeros(0, np.int64))
    return run


def _midpoints(radius: int):
    masks = np.array([sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(64), r)], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays([pa.array(masks ^ value), pa.array(np.full(len(masks), value))], names=["key", "fp"])
    return run


def _dealt(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "fp")


def links(values: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` edges that connect the distinct fingerprints ``values (fp)`` as all links would.

    Only components are kept, not every link: under a key a spanning forest of its links is emitted.
    ``max_bits`` may be at most 4, which the keys are made for.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("max_bits must lie in 0..4")
    kinds = "a long, b long, full boolean"
    # A fingerprint has some hundred keys, so the narrow table is dealt over all cores before it grows.
    spread = values.select("fp").repartition(values.sparkSession.sparkContext.defaultParallelism, "fp")
    found = cut_lineage(_dealt(spread.mapInArrow(_emit_keys, "key long, fp long")).mapInArrow(_link(max_bits, bucket), kinds), "links")
    edges = found.filter("NOT full").select("a", "b")
    crowded = found.filter("full").select(F.col("a").alias("fp")).distinct()
    if not crowded.isEmpty():
        # Values within ``max_bits`` share a value at half of that, rounded up; it has at most 2081 around it.
        keyed = _dealt(crowded.mapInArrow(_midpoints(-(-max_bits // 2)), "key long, fp long"))
        edges = edges.union(keyed.mapInArrow(_link(max_bits, 1 << 12), kinds).select("a", "b"))
    return edges.distinct()


def classes(prints: DataFrame, id_column: str = "doc_id", max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``(fp, component_id)``: every distinct fingerprint with the smallest id reachable from it."""
    own = cut_lineage(prints.groupBy("fp").agg(F.min(id_column).alias("least")), "fingerprints")
    roots = components(links(own, max_bits, bucket)).select(F.col("node").alias("fp"), "root")
    rooted = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return salted_lookup(rooted, smallest, "root", ["fp"]).select("fp", "component_id")


def near_duplicates(documents: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``documents``.

    Texts whose fingerprints differ in at most ``max_bits`` bits are linked, and a component is
    everything reachable. Equal texts meet in one fingerprint. A null, empty or blank text has
    fingerprint 0 and is linked like any other. Rows may repeat; the component of rows with null ids
    only is null. An empty table has no rows. Only ``doc_id`` and ``text`` are read.
    """
    prints = cut_lineage(fingerprints(documents, "doc_id"), "prints")
    return salted_lookup(prints, classes(prints, "doc_id", max_bits, bucket), "fp", ["doc_id"])


def keep_one(documents: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``documents``, all columns, with one row of each component: that with the smallest ``(doc_id, text hash)``.

    Null ids come last. Of rows equal in id and text one stays.
    """
    rows = documents.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("row"), "text")
    prints = cut_lineage(fingerprints(rows.select("row.doc_id", "row.h", "text"), "doc_id", "h"), "prints")
    prints = prints.withColumn("who", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    kept = classes(prints, "who", max_bits, bucket).select(
        F.col("component_id.doc_id").alias("_id"), F.col("component_id.h").alias("_h")).distinct()
    text_hash = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    same = documents["doc_id"].eqNullSafe(kept["_id"]) & (text_hash == kept["_h"])
    return documents.join(kept, same).dropDuplicates(["_id", "_h"]).drop("_id", "_h")
