"""Per-site features of a pair, computed on Arrow batches.

A pair has hundreds of sites and several values per site. Built-in array lambdas are interpreted
element by element; measured on the same pairs they cost several times the joins. Here one batch
is one numpy gather over all its sites. The results stay arrays on the pair row.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from serospark.functions.constants import AMINO_ACIDS, GROUPINGS

N = len(AMINO_ACIDS)
UNKNOWN = N  # code of gaps and unknown letters inside the lookup tables

_CODES = np.full(256, UNKNOWN, dtype=np.int64)
_CODES[np.frombuffer(AMINO_ACIDS.encode(), dtype=np.uint8)] = np.arange(N)
_CODE_BYTES = _CODES.astype(np.uint8).tobytes()


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text array; one byte is one site."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    letters = np.frombuffer(data, dtype=np.uint8)[ends[0]: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], letters


def _aligned(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, x = _letters(a)
    other, y = _letters(b)
    if not np.array_equal(offsets, other):
        raise ValueError("paired sequences differ in length; align them first")
    return offsets, x, y


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def padded_table(cells: Sequence[float], missing: float = 0.0) -> np.ndarray:
    """A 400-cell table with one more row and column for gaps and unknown letters."""
    table = np.full((N + 1, N + 1), missing, dtype=np.float64)
    table[:N, :N] = np.asarray(cells, dtype=np.float64).reshape(N, N)
    return table.ravel()


def _gather(a: pa.Array, b: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets, x, y = _aligned(a, b)
    return offsets, table[_CODES[x] * (N + 1) + _CODES[y]]


def table_values(a: Column, b: Column, cells: Sequence[float], unknown_is_null: bool = False) -> Column:
    """``ARRAY<DOUBLE>``: per site the cell of the two residues; gaps give 0, or null if asked."""
    table = padded_table(cells, np.nan if unknown_is_null else 0.0)

    @F.arrow_udf("array<double>")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, found = _gather(a, b, table)
        return _lists(offsets, pa.array(found, from_pandas=unknown_is_null))

    return values(a, b)


def tensor_values(a: Column, b: Column, tables: np.ndarray) -> Column:
    """``ARRAY<ARRAY<DOUBLE>>``: one array of site values per table."""
    padded = np.stack([padded_table(t) for t in tables])

    @F.arrow_udf("array<array<double>>")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, at = cell_places(a, b)
        lengths = np.diff(offsets)
        inner = np.concatenate([[0], np.cumsum(np.repeat(lengths, len(padded)))])
        flat = np.empty(inner[-1], dtype=np.float64)
        starts = offsets[:-1] * len(padded)
        # Position of site s of table p in row r: row start + p * row length + place in the row.
        place = np.arange(len(at)) - np.repeat(offsets[:-1], lengths)
        for p, table in enumerate(padded):
            flat[np.repeat(starts + p * lengths, lengths) + place] = table[at]
        rows = _lists(inner, pa.array(flat))
        return _lists(np.arange(len(lengths) + 1) * len(padded), rows)

    return values(a, b)


def differences(a: Column, b: Column) -> Column:
    """``ARRAY<INT>``: 1 where the letters differ; a gap against a residue differs."""
    @F.arrow_udf("array<int>")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, x, y = _aligned(a, b)
        return _lists(offsets, pa.array((x != y).astype(np.int32)))

    return values(a, b)


def class_differences(a: Column, b: Column, grouping: int | Sequence[str]) -> Column:
    """``ARRAY<INT>``: 1 where the residue classes differ; residues in no class form one class."""
    classes = GROUPINGS[grouping] if isinstance(grouping, int) else list(grouping)
    of = np.full(256, len(classes), dtype=np.int64)
    for i, letters in enumerate(classes):
        of[np.frombuffer(letters.encode(), dtype=np.uint8)] = i

    @F.arrow_udf("array<int>")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, x, y = _aligned(a, b)
        return _lists(offsets, pa.array((of[x] != of[y]).astype(np.int32)))

    return values(a, b)


def top_scale_gaps(a: Column, b: Column, scales: dict[str, Sequence[float]], k: int = 3) -> Column:
    """Struct with one double per scale: mean of the ``k`` largest gaps over mutated sites.

    Fewer mutations average over what there is, none gives 0. Unknown letters have scale value 0.
    """
    named = {name: np.append(np.asarray(v, dtype=np.float64), 0.0) for name, v in scales.items()}
    schema = ", ".join(f"{name}: double" for name in named)

    @F.arrow_udf(f"struct<{schema}>")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, x, y = _aligned(a, b)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[x != y]
        cx, cy = _CODES[x[x != y]], _CODES[y[x != y]]
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        out = []
        for scale in named.values():
            gap = np.abs(scale[cx] - scale[cy])
            order = np.lexsort((-gap, rows))
            rank = np.arange(len(rows)) - first[rows]
            top = np.where(rank < k, gap[order], 0.0)
            sums = np.bincount(rows, weights=top, minlength=len(counts)) if len(rows) else np.zeros(len(counts))
            out.append(pa.array(sums / np.maximum(np.minimum(counts, k), 1)))
        return pa.StructArray.from_arrays(out, names=list(named))

    return values(a, b)


def _cells(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of numbers as row and place of every entry, the numbers, and where an entry is null."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), lengths)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths), values, flat.is_null().to_numpy(zero_copy_only=False)


def _kept_lists(lengths: np.ndarray, values: pa.Array, absent: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values, mask=absent)


def _totals(lists: pa.Array, by_place: bool = False, absolute: bool = False) -> pa.Array:
    rows, place, values, null = _cells(lists)
    values = np.abs(values) if absolute else values * place if by_place else values
    sums = np.bincount(rows, weights=values, minlength=len(lists))
    unknown = np.bincount(rows, weights=null, minlength=len(lists)) > 0
    return pa.array(sums, mask=unknown | lists.is_null().to_numpy(zero_copy_only=False))


def array_total(values: Column, by_place: bool = False, absolute: bool = False) -> Column:
    """``DOUBLE``: sum of an array, of its entries times their zero-based place, or of their sizes; null if an entry is."""
    @F.arrow_udf("double")
    def total(lists: pa.Array) -> pa.Array:
        return _totals(lists, by_place, absolute)

    return total(values)


def array_totals(values: Column) -> Column:
    """``ARRAY<DOUBLE>``: the sum of every array of an array."""
    @F.arrow_udf("array<double>")
    def total(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return _kept_lists(lengths, _totals(lists.flatten()), lists.is_null())

    return total(values)


def imputed(values: Column, means: dict[int, float]) -> Column:
    """``ARRAY<DOUBLE>``: null entries at the mean of their place; places without a mean vanish."""
    known = np.zeros(max(means, default=-1) + 2, dtype=bool)
    known[list(means)] = True
    mean = np.zeros(len(known))
    mean[list(means)] = list(means.values())

    @F.arrow_udf("array<double>")
    def filled(lists: pa.Array) -> pa.Array:
        rows, place, own, null = _cells(lists)
        at = np.minimum(place, len(known) - 1)
        kept = known[at]
        return _kept_lists(np.bincount(rows[kept], minlength=len(lists)), pa.array(np.where(null, mean[at], own)[kept]), lists.is_null())

    return filled(values)


def residuals(main: Column, aux: Column, fits: dict[int, tuple[float, float]]) -> Column:
    """``ARRAY<DOUBLE>``: per place ``aux`` minus ``slope * main + intercept``; null where a number or the fit is missing."""
    slope, intercept, missing = (np.zeros(max(fits, default=-1) + 2) for _ in range(3))
    missing[:] = 1
    for site, (k, c) in fits.items():
        if k is not None and c is not None:
            slope[site], intercept[site], missing[site] = k, c, 0

    @F.arrow_udf("array<double>")
    def left(x: pa.Array, y: pa.Array) -> pa.Array:
        absent = pc.or_(x.is_null(), y.is_null())
        sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y)]
        # The shorter array counts as ended by nulls.
        lengths = np.where(absent.to_numpy(zero_copy_only=False), 0, np.maximum(*sizes))
        starts = np.cumsum(lengths) - lengths
        found, null = np.zeros((2, lengths.sum())), np.ones((2, lengths.sum()), dtype=bool)
        for i, column in enumerate((x, y)):
            rows, place, values, unknown = _cells(column)
            used = place < lengths[rows]
            to = (starts[rows] + place)[used]
            found[i, to], null[i, to] = values[used], unknown[used]
        at = np.minimum(np.arange(lengths.sum()) - np.repeat(starts, lengths), len(missing) - 1)
        values = found[1] - (slope[at] * found[0] + intercept[at])
        return _kept_lists(lengths, pa.array(values, mask=null.any(axis=0) | (missing[at] > 0)), absent)

    return left(main, aux)


def letter_codes(seq: Column) -> Column:
    """``ARRAY<INT>``: residue codes in alphabet order, -1 for gaps and unknown letters; an empty text holds one empty letter, code 0."""
    codes = np.where(_CODES == UNKNOWN, -1, _CODES).astype(np.int32)

    @F.arrow_udf("array<int>")
    def values(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if (sizes > 0).all() and pc.all(pc.string_is_ascii(texts)).as_py():
            offsets, letters = _letters(texts)
            return _lists(offsets, pa.array(codes[letters]))
        return pa.array([t if t is None else [AMINO_ACIDS.find(c) for c in t or [""]] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return values(seq)


def facing_codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The known codes of two arrays of codes that stand in the same place, over all rows; a longer array faces nothing at its end."""
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (a, b)]
    shared = np.minimum(*sizes)
    codes = []
    for column in (a, b):
        rows, place, values, null = _cells(column)
        codes.append(np.where(null, -1, values)[place < shared[rows]].astype(np.int64))
    known = (codes[0] >= 0) & (codes[1] >= 0)
    return codes[0][known], codes[1][known]


def edit_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two letter matrices of one width, by bit vectors: a column of all tables costs a few word operations (Myers 1999)."""
    rows, width = x.shape
    words, one, none = -(-width // 64), np.uint64(1), np.uint64(0)
    # For every letter of ``y`` the places of ``x`` that hold it, 64 to a word.
    found = np.flatnonzero(np.bincount(y.ravel(), minlength=256))
    number = np.zeros(256, dtype=np.intp)
    number[found] = np.arange(len(found)) * rows
    bits = np.zeros((len(found), rows, 8 * words), dtype=np.uint8)
    for i, letter in enumerate(found):
        bits[i, :, : -(-width // 8)] = np.packbits(x == letter, axis=1, bitorder="little")
    where = [np.ascontiguousarray(bits.view("<u8")[:, :, w]).ravel() for w in range(words)]
    up, down = [np.full(rows, ~none) for _ in range(words)], [np.zeros(rows, dtype=np.uint64) for _ in range(words)]
    for column in number[y.T] + np.arange(rows):
        carry, plus_in, minus_in = none, one, none
        for w in range(words):
            equal, p, m = where[w][column], up[w], down[w]
            part = (equal & p) + p
            total = part + carry if w else part
            across = (total ^ p) | equal
            plus, minus = m | ~(across | p), p & across
            right, below = (plus << one) | plus_in, (minus << one) | minus_in
            if w < words - 1:
                carry = ((part < p) | (total < part)).astype(np.uint64)
                plus_in, minus_in = plus >> np.uint64(63), minus >> np.uint64(63)
            side = equal | m
            up[w], down[w] = below | ~(side | right), right & side
    # Down the last column of the table every step is one up, one down or level.
    mask = [~none] * (words - 1) + [~none >> np.uint64(64 * words - width)]
    steps = (np.bitwise_count(u & k).astype(np.int32) - np.bitwise_count(d & k) for u, d, k in zip(up, down, mask))
    return width + sum(steps)


# Rows whose bit vectors are worked on together; they fit a cache.
BLOCK = 2048


def _padded(stretches: pa.Array, width: int) -> np.ndarray:
    """Texts of at most ``width`` letters as the rows of a matrix, gaps behind the shorter ones."""
    offsets, letters = _letters(stretches)
    lengths = np.diff(offsets)
    out = np.full((len(lengths), width), ord("-"), dtype=np.uint8)
    out[np.arange(width) < lengths[:, None]] = letters
    return out


def step_distances(stretches: Column, width: int) -> Column:
    """``ARRAY<INT>``: edit distance of each stretch of an array and the one after it, both padded with gaps to ``width``."""
    @F.arrow_udf("array<int>")
    def values(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        ends = np.cumsum(sizes)
        first = np.ones(len(flat), dtype=bool)
        first[ends[sizes > 0] - 1] = False
        starts = np.flatnonzero(first)
        # One more stretch than steps, so a block of consecutive stretches is padded once.
        found = [np.zeros(0, dtype=np.int32)]
        for at in range(0, len(flat) - 1, BLOCK):
            rows = _padded(flat.slice(at, BLOCK + 1), width)
            own = starts[np.searchsorted(starts, at):np.searchsorted(starts, at + BLOCK)] - at
            if len(own):
                found.append(edit_counts(rows[own], rows[own + 1]))
        return _kept_lists(np.maximum(sizes - 1, 0), pa.array(np.concatenate(found), pa.int32()), lists.is_null())

    return values(stretches)


# Letters in upper case, those that are no residue as gaps; everything else is left out.
_RESIDUES = bytes(ord("-") if chr(i).upper() in "BJOUZ" and chr(i).isalpha() and i < 128 else ord(chr(i).upper()) if i < 128 else i for i in range(256))
_NO_LETTERS = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))


def stretches(text: Column, width: int) -> Column:
    """``ARRAY<STRING>``: the letters of a text as residues, cut every ``width``; the last stretch may be shorter."""
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        kept = [b"" if t is None else t.translate(_RESIDUES, _NO_LETTERS) for t in texts.cast(pa.large_binary()).to_pylist()]
        lengths = np.array([len(k) for k in kept], dtype=np.int64)
        counts = -(-lengths // width)
        rows = np.repeat(np.arange(len(kept)), counts)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = (np.cumsum(lengths) - lengths)[rows] + np.minimum((place + 1) * width, lengths[rows])
        data = b"".join(kept)
        parts = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        return _kept_lists(counts, parts, texts.is_null())

    return cut(text)


def short_places(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, and for every site its entry in a padded table, in two bytes."""
    offsets, x, y = _aligned(a, b)
    places, other = (np.frombuffer(letters.tobytes().translate(_CODE_BYTES), dtype=np.uint8) for letters in (x, y))
    places = places.astype(np.int16)
    places *= N + 1
    places += other
    return offsets, places


def cell_places(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``short_places`` as whole numbers of full size."""
    offsets, places = short_places(a, b)
    return offsets, places.astype(np.int64)


def site_table_values(a: Column, b: Column, blocks: list[np.ndarray], sites: list[np.ndarray]) -> Column:
    """``ARRAY<DOUBLE>``: for each block the values of its sites, from one padded table per site.

    ``blocks[i]`` is (sites x padded cells); ``sites[i]`` lists the sites the block keeps. All
    sequences have the length of the tables.
    """
    width = len(blocks[0])

    @F.arrow_udf("array<double>")
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, at = cell_places(a, b)
        at = at.reshape(len(offsets) - 1, width)
        parts = [table[kept, at[:, kept]] for table, kept in zip(blocks, sites)]
        flat = np.concatenate(parts, axis=1)
        return _lists(np.arange(len(flat) + 1) * flat.shape[1], pa.array(flat.ravel()))

    return values(a, b)
