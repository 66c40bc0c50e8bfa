"""Cheapest repairs of conversations by Four-Russians block tables.

A repaired conversation reads ``(s?(ua)+)?`` in role initials, which four states recognise: nothing
yet, after the system row, after a user row, after an assistant row. The costs of finishing from each
state are a vector; taken less its least value it is one of a few dozen vectors. For every such vector
and every block of ``BLOCK`` row symbols the vector before the block is worked out once, so a
conversation is read backward with one lookup per block. The vectors at block ends are kept; blocks are
then expanded backward row by row, and the edits are read forward from them, the ASCII-least first among
equally cheap ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from serospark.llm.common import counted_lookup
from serospark.llm.workers import remembered

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLOCK = 4
WHITE = " \t\n\x0b\x0c\r"
# Row symbols: 0 none (fills up the first block), 1 a row that has to go, then two for each initial (whole, truncated).
GONE, INITIALS, SYMBOLS = 1, "sua", 10
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = "uuau"  # the initial that may be inserted in each state
_END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 20


class Tables(NamedTuple):
    """``vectors``; per (vector after, symbol) the ``step`` before and its ``lift``; the same per block; ``edits`` and next states."""

    vectors: list[tuple[int, ...]]
    step: list[list[int]]
    lift: list[list[int]]
    block_step: np.ndarray
    block_lift: np.ndarray
    edits: dict[tuple[int, int, int], tuple[str, int]]


def _choices(after: tuple[int, ...], symbol: int) -> list[list[tuple[int, str, int]]]:
    """Per state the edits of a row that insert nothing: ``(cost to finish, initial, state after)``."""
    if symbol == 0:
        return [[(after[q], "", q)] for q in range(4)]
    found = [[(DELETE + after[q], "D", q)] for q in range(4)]
    if symbol > GONE:
        own, cut = divmod(symbol - 2, 2)
        for q in range(4):
            kept = _NEXT.get((q, (INITIALS + "-")[own]))
            if kept is not None:
                found[q].append((TRUNCATED * cut + after[kept], "K", kept))
            turned = _NEXT[q, _WANTED[q]]
            found[q].append((REROLE + TRUNCATED * cut + after[turned], "R", turned))
    return found


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The costs to finish before a row; at most two rows are inserted in front of it."""
    plain = [min(c)[0] for c in _choices(after, symbol)]
    if symbol == 0:
        return tuple(plain)
    costs = []
    for q in range(4):
        one = _NEXT[q, _WANTED[q]]
        two = _NEXT[one, _WANTED[one]]
        costs.append(min(plain[q], INSERT + plain[one], 2 * INSERT + plain[two]))
    return tuple(costs)


def tables(block: int = BLOCK) -> Tables:
    """All vectors that can occur and the transitions of every block of ``block`` symbols, made once per worker."""
    return remembered(("repair", block), lambda: _tables(block))


def _tables(block: int) -> Tables:
    vectors, place = [_END], {_END: 0}
    step, lift, edits = [], [], {}
    for after in vectors:  # grows while it is read
        step.append([])
        lift.append([])
        for symbol in range(SYMBOLS):
            costs = _before(after, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in place:
                place[normal] = len(vectors)
                vectors.append(normal)
            step[-1].append(place[normal])
            lift[-1].append(least)
            plain = _choices(after, symbol)
            for start in range(4):
                text, q = "", start
                while symbol:
                    ends = {e: (c, n) for c, e, n in plain[q]}
                    inserted = _NEXT[q, _WANTED[q]]
                    ends["I"] = (INSERT + costs[inserted], inserted)
                    edit = min(e for e, (c, _) in ends.items() if c == costs[q])
                    text, q = text + edit, ends[edit][1]
                    if edit != "I":
                        break
                edits[place[after], symbol, start] = (text, q)
    one, up = np.array(step, np.int32), np.array(lift, np.int32)
    block_step, block_lift = one, up
    for _ in range(block - 1):  # one more symbol in front of all blocks so far
        block_lift = (block_lift[:, None, :] + up[block_step].transpose(0, 2, 1)).reshape(len(vectors), -1)
        block_step = one[block_step].transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, step, lift, block_step, block_lift, edits)


def cheapest(symbols: bytes, block: int = BLOCK) -> tuple[int, str]:
    """``(cost, edits)`` of the cheapest repair of a conversation given as row symbols."""
    if not symbols:
        return 0, ""
    known = tables(block)
    rows = np.frombuffer(bytes(-len(symbols) % block) + symbols, np.uint8).reshape(-1, block)
    codes = (rows @ (SYMBOLS ** np.arange(block - 1, -1, -1))).tolist()
    after, ends, cost = 0, [0] * len(codes), 0
    for b in range(len(codes) - 1, -1, -1):
        ends[b] = after
        cost += int(known.block_lift[after, codes[b]])
        after = int(known.block_step[after, codes[b]])
    text, state = [], 0
    for end, row in zip(ends, rows.tolist()):
        inner = [end]
        for symbol in row[:0:-1]:
            inner.append(known.step[inner[-1]][symbol])
        for symbol, following in zip(row, reversed(inner)):
            edit, state = known.edits[following, symbol, state]
            text.append(edit)
    text.append(("", "II", "I", "")[state])
    return cost + known.vectors[after][0], "".join(text)


# Conversations of at most so many rows are remembered, and how many of them.
SHORT, KEPT = 64, 1 << 16


_CHUNK = ("part int, seq int, first_turn long, last_turn long, least_turn long, most_turn long, turns long, "
          "blank long, duplicate long, truncated long, illegal long, first int, last int, symbols binary")
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order to one row per run of a conversation in a batch."""
    part, seq, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        conv = batch.column("conv_id")
        same_conv = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        no_turn = np.asarray(batch.column("turn").is_null())
        turn = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        initial = batch.column("initial").to_numpy()
        blank, cut, again = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "cut", "again"))
        new = np.append(True, same_conv[1:] != same_conv[:-1])
        alike = np.append(False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (turn[1:] == turn[:-1]) & (no_turn[1:] == no_turn[:-1])) & ~new
        row = (conv[0].as_py(), batch.column("turn")[0].as_py(), int(h1[0]), int(h2[0]))
        alike[0] = held == row
        held = (conv[n - 1].as_py(), batch.column("turn")[n - 1].as_py(), int(h1[-1]), int(h2[-1]))
        twice = ~blank & (again | alike)
        cut = cut & ~blank & ~twice
        symbols = np.where(blank | twice, GONE, 2 + 2 * initial.astype(np.int64) + cut).astype(np.uint8)
        wrong = np.append(False, ~_LEGAL[initial[:-1], initial[1:]]) & ~new
        fresh = ~no_turn & (new | np.append(True, (turn[1:] != turn[:-1]) | no_turn[:-1]))
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], n)
        add = lambda flags: np.add.reduceat(flags.astype(np.int64), begins)
        seen = add(~no_turn) > 0
        low = np.minimum.reduceat(np.where(no_turn, np.iinfo(np.int64).max, turn), begins)
        high = np.maximum.reduceat(np.where(no_turn, np.iinfo(np.int64).min, turn), begins)
        raw = symbols.tobytes()
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(begins)), pa.array(np.full(len(begins), part, np.int32)), pa.array((seq + np.arange(len(begins))).astype(np.int32)),
             pa.array(turn[begins], mask=no_turn[begins]), pa.array(turn[ends - 1], mask=no_turn[ends - 1]), pa.array(low, mask=~seen),
             pa.array(high, mask=~seen), pa.array(add(fresh)), pa.array(add(blank)), pa.array(add(twice)), pa.array(add(cut)), pa.array(add(wrong)),
             pa.array(initial[begins], pa.int32()), pa.array(initial[ends - 1], pa.int32()),
             pa.array([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())],
            names=["conv_id", *[c.split()[0] for c in _CHUNK.split(", ")]])
        seq += len(begins)


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each conversation, in order, to its counts, cost and edits."""
    names = [*[c.split()[0] for c in _STATS.split(", ")], "audit"]
    usual = remembered("repaired", dict)
    for batch in batches:
        found = []
        if len(usual) > KEPT:
            usual.clear()
        for chunks in batch.column(1).to_pylist():
            known = [c for c in chunks if c["least_turn"] is not None]
            turns = sum(c["turns"] for c in chunks)
            illegal = sum(c["illegal"] for c in chunks)
            for one, two in zip(chunks, chunks[1:]):
                turns -= two["first_turn"] is not None and one["last_turn"] == two["first_turn"]
                illegal += not _LEGAL[one["last"], two["first"]]
            gaps = max(c["most_turn"] for c in known) - min(c["least_turn"] for c in known) + 1 - turns if known else 0
            symbols = b"".join(c["symbols"] for c in chunks)
            best = usual.get(symbols) or cheapest(symbols)
            if len(symbols) <= SHORT:
                usual[symbols] = best
            found.append((gaps, *[sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated")], int(illegal), *best))
        columns = list(zip(*found)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, columns)]], names=["conv_id", *names])


_ROLES = {"u": b"user:", "a": b"assistant:"}


class _Repair:
    """Feeds the repaired rows of one conversation to a digest, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, 0, hashlib.sha256(), False

    def line(self, head: bytes, text: bytes = b"") -> None:
        self.digest.update((b"\n" if self.any else b"") + head + text)
        self.any = True

    def wanted(self) -> None:
        self.initial = _WANTED[self.state]
        self.state = _NEXT[self.state, self.initial]

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.wanted()
            self.line(_ROLES[self.initial])

    def row(self, role: str, text: bytes) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state, role[0]]
            self.line(role.encode() + b":", text)
        elif edit == "R":
            self.wanted()
            self.line(_ROLES[self.initial], text)

    def ended(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, each led by its audit, to the audits with the digest of the repaired rows."""
    kept = ["conv_id", *[c.split()[0] for c in _STATS.split(", ")], "audit"]
    one, head = None, None
    for batch in batches:
        heads, digests = [], []
        lead = batch.column("lead").to_pylist()
        roles, texts = batch.column("role").to_pylist(), batch.column("text").cast(pa.binary())
        for i, leads in enumerate(lead):
            if leads:
                if one is not None:
                    heads.append(head)
                    digests.append(one.ended())
                head = batch.slice(i, 1).select(kept)
                one = _Repair(head.column("audit")[0].as_py())
            else:
                one.row(roles[i], texts[i].as_py())
        if heads:
            yield _led(heads, digests)
    if one is not None:
        yield _led([head], [one.ended()])


def _led(heads: list[pa.RecordBatch], digests: list[str]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
    return whole.append_column("repaired_sha256", pa.array(digests))


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation of ``rows``.

    ``rows`` has ``conv_id, turn, role, text``; nulls of the last two are one space. Rows are taken by turn, nulls first;
    rows of equal turn by role, then by a hash of role and text, so equal rows are neighbours. A null ``conv_id`` is a
    conversation of its own. ``gaps`` ignores null turns and is 0 if all are null. An empty table has no rows, other columns are not read.

    Symbols and counts are worked out over ranges of rows, so a very long conversation is spread over tasks; per
    conversation its symbols, a byte a row, meet in one place as the audit does. Texts pass once through the
    digest, one row at a time.
    """
    kind = dict(rows.dtypes)["conv_id"]
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    end = F.rtrim(text, F.lit(WHITE))
    base = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    # The earliest turn of a repeated (role, text); a null turn is earlier than any other.
    same = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "h1", "h2")
    narrow = base.drop("text").withColumn("same", same)
    repeated = narrow.groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("earliest")).filter("n > 1").drop("n")
    placed = counted_lookup(narrow, repeated, "same")
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    again = F.col("turn").isNotNull() & F.coalesce(F.col("unnumbered") | (F.col("turn") > F.col("earliest")), F.lit(False))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.select("conv_id", "turn", "role", "h1", "h2", "blank", "cut", again.alias("again"), initial.cast("byte").alias("initial"))
    chunks = ranged.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("role").mapInArrow(_chunks, f"conv_id {kind}, {_CHUNK}")
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("chunks"))
    audits = whole.mapInArrow(_audits, f"conv_id {kind}, {_STATS}, audit string").withColumn("lead", F.lit(True))
    stream = audits.unionByName(base.select("conv_id", "turn", "role", "text", "h1", "h2", F.lit(False).alias("lead")), allowMissingColumns=True)
    ordered = stream.repartition(tasks, "conv_id").sortWithinPartitions(order[0], F.desc("lead"), *order[1:])
    return ordered.mapInArrow(_digests, f"conv_id {kind}, {_STATS}, audit string, repaired_sha256 string")
