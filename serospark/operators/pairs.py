"""Pair tables: who is paired with whom, how far apart, and with which features.

The pairs of an analysis are those with a distance. They are read from the long distance table and
joined to the sequences of both ends, so the work is linear in that table; sequences are never
multiplied out against each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from serospark.functions import pairs as P
from serospark.functions import residues as R
from serospark.functions import sites as X
from serospark.functions.constants import AMINO_ACIDS, EPITOPES, KEY_SITES, SCALES
from serospark.functions.hashing import fold_of, unit_hash
from serospark.plans.skew import LIMIT, keep_both_ends, lookup, lookup_ends
from serospark.session import cut_lineage


def attach_sequences(pairs: DataFrame, seqs: DataFrame, columns: Sequence[str] = ("seq",), limit: int = LIMIT, stored: bool = False) -> DataFrame:
    """Add ``<column>_a`` and ``<column>_b`` from the table ``seqs`` (one row per ``name``); ``stored`` says that ``pairs`` is read from files."""
    out = lookup_ends(pairs, seqs, "name", {c: (f"{c}_a", f"{c}_b") for c in columns}, limit=limit, stored=stored)
    return out.select(*pairs.columns, *[f"{c}_{end}" for c in columns for end in "ab"])


def labelled_pairs(distances: DataFrame, seqs: DataFrame, order: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Unordered pairs with a known distance and both sequences: ``(a, b, dist, seq_a, seq_b)``.

    A symmetric table holds each pair twice; the row whose first name comes first is kept. "First"
    is by name, or by the column ``order`` of ``seqs`` where file order matters. The distances are written
    first: both joins count them and read them again.
    """
    if order is None:
        return attach_sequences(cut_lineage(distances.filter(F.col("a") < F.col("b")), "distances"), seqs, limit=limit, stored=True)
    both = attach_sequences(cut_lineage(distances, "distances"), seqs, ("seq", order), limit, stored=True)
    return both.filter(F.col(f"{order}_a") < F.col(f"{order}_b")).drop(f"{order}_a", f"{order}_b")


def attach_distance(pairs: DataFrame, distances: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Label ``(a, b)`` rows with ``dist``; pairs without a distance drop."""
    return lookup(pairs, distances.select("a", "b", "dist"), ["a", "b"], "inner", limit)


def split_pairs(df: DataFrame, frac: float = 0.2, seed: int = 42, keys: Sequence[str] = ("a", "b")) -> DataFrame:
    """Add ``is_test``: a fixed pseudo-random share ``frac`` of the rows, without a shuffle."""
    return df.withColumn("is_test", unit_hash(*[F.col(k) for k in keys], seed=seed) < frac)


def split_hash(keys: Sequence[str], seed: int) -> Column:
    """The 32-bit hash by which ``split_exact`` orders rows."""
    return (unit_hash(*[F.col(k) for k in keys], seed=seed) * float(1 << 32)).cast("long")


def split_exact(
    df: DataFrame, frac: float = 0.2, seed: int = 42, keys: Sequence[str] = ("a", "b"), at_least: int = 0, hashed_as: str | None = None,
) -> DataFrame:
    """Add ``is_test`` with exactly ``max(at_least, int(frac * N))`` test rows.

    A histogram over 65,536 hash ranges finds the range the cut falls into, a second one over as many
    parts of that range the part; the few rows of that part are ordered to find the last hash that is
    in. The split itself is one comparison per row. ``keys`` must identify a row. A column ``hashed_as`` of a stored
    table that holds their ``split_hash`` saves working it out in every pass.
    """
    ranges = 65_536
    values = [F.col(k) for k in keys]
    # The hash has 32 bits: the range is its upper half, the part its lower half.
    whole = F.col(hashed_as) if hashed_as else split_hash(keys, seed)
    hashed = df.select(whole.alias("h"), F.struct(*values).alias("key"))
    upper, lower = F.shiftright("h", 16), F.col("h").bitwiseAND(ranges - 1)

    def sizes(rows: DataFrame, half: Column) -> list[tuple[int, int]]:
        return sorted((r["at"], r["n"]) for r in rows.groupBy(half.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())

    def cut(counted: list[tuple[int, int]], left: int) -> tuple[int, int]:
        """The range in which ``left`` rows run out, and how many of its rows are still in."""
        for at, n in counted:
            if left < n:
                return at, left
            left -= n
        return ranges, 0

    counted = sizes(hashed, upper)
    first, left = cut(counted, max(at_least, int(frac * sum(n for _, n in counted))))
    second, left = cut(sizes(hashed.filter(upper == first), lower), left)
    stop = (first << 16) + second
    test = whole < stop
    if left:
        last = hashed.filter(F.col("h") == stop).orderBy("key").limit(left).collect()[-1]["key"]
        test = test | ((whole == stop) & (F.struct(*values) <= F.struct(*[F.lit(last[k]).alias(k) for k in keys])))
    return df.withColumn("is_test", test)


def split_names(df: DataFrame, frac: float = 0.2, seed: int = 42, name: str = "name") -> DataFrame:
    """Add ``is_test`` per name."""
    return split_pairs(df, frac, seed, [name])


def split_pairs_by_name(df: DataFrame, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part``: ``test`` if both names are test names, ``train`` if none is, else ``mixed``.

    The hash decides about a name anywhere, so no join against a list of names is needed.
    """
    a, b = unit_hash(F.col("a"), seed=seed) < frac, unit_hash(F.col("b"), seed=seed) < frac
    return df.withColumn("part", F.when(a & b, "test").when(a | b, "mixed").otherwise("train"))


def kfold(df: DataFrame, k: int = 10, seed: int = 42, keys: Sequence[str] = ("a", "b")) -> DataFrame:
    """Add ``fold`` 0..k-1. The hash has a salt of its own: folds do not follow a split of equal seed."""
    return df.withColumn("fold", fold_of(unit_hash(*[F.col(c) for c in keys], F.lit("fold"), seed=seed), k))


def validation_split(df: DataFrame, frac: float = 0.1, seed: int = 7, keys: Sequence[str] = ("a", "b"), hashed_as: str | None = None) -> DataFrame:
    """Add ``is_validation`` on ``max(1, int(frac * N))`` training rows."""
    return split_exact(df, frac, seed, keys, at_least=1, hashed_as=hashed_as).withColumnRenamed("is_test", "is_validation")


def encode_pairs(df: DataFrame) -> DataFrame:
    """Add residue codes ``codes_a`` and ``codes_b``."""
    return df.withColumn("codes_a", R.encode_residues(F.col("seq_a"))).withColumn("codes_b", R.encode_residues(F.col("seq_b")))


def code_meetings(coded: DataFrame) -> DataFrame:
    """``(x, y, n)``: how often two known residue codes face each other, in ``codes_a`` and ``codes_b``.

    Tasks count on their own rows first, so at most 400 numbers of a task are shuffled.
    """
    side = len(AMINO_ACIDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, dtype=np.int64)
        for batch in batches:
            x, y = X.facing_codes(*batch.columns)
            total += np.bincount(x * side + y, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"x": pa.array(found // side, pa.int32()), "y": pa.array(found % side, pa.int32()), "n": pa.array(total[found], pa.int64())})

    return coded.select("codes_a", "codes_b").mapInArrow(count, "x int, y int, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))


def difference_features(df: DataFrame) -> DataFrame:
    """Add ``diff`` (0/1 per site) and ``n_mutations``, the Hamming distance."""
    out = df.withColumn("diff", X.differences(F.col("seq_a"), F.col("seq_b")))
    return out.withColumn("n_mutations", F.aggregate("diff", F.lit(0), lambda acc, x: acc + x))


def grouping_features(df: DataFrame, grouping: int | Sequence[str], name: str = "group_diff") -> DataFrame:
    """Add 0/1 per site, 1 where the residue classes differ."""
    return df.withColumn(name, X.class_differences(F.col("seq_a"), F.col("seq_b"), grouping))


def mutation_features(
    df: DataFrame,
    key_sites: Sequence[int] = KEY_SITES,
    regions: dict[str, Sequence[int]] = EPITOPES,
    scales: dict[str, Sequence[float]] = SCALES,
    k: int = 3,
) -> DataFrame:
    """Add the summary features of a pair: count, motif, key-site and region flags, scale gaps."""
    a, b = F.col("seq_a"), F.col("seq_b")
    out = difference_features(df)
    out = out.withColumn("glycosylation_changed", P.glycosylation_changed(a, b))
    out = out.withColumn("key_site_changed", P.key_site_changed(a, b, key_sites))
    for name, flag in P.epitope_changed(a, b, regions).items():
        out = out.withColumn(f"epitope_{name}_changed", flag)
    out = out.withColumn("_gaps", X.top_scale_gaps(a, b, scales, k))
    return out.withColumns({f"{name}_diff": F.col(f"_gaps.{name}") for name in scales}).drop("_gaps")


SUMMARY_FEATURES = (
    ["n_mutations", "glycosylation_changed", "key_site_changed"]
    + [f"epitope_{name}_changed" for name in EPITOPES]
    + [f"{name}_diff" for name in SCALES]
)


def table_features(df: DataFrame, cells: Sequence[float], name: str, unknown_is_null: bool = False) -> DataFrame:
    """Add array ``name``: per site the cell of one 400-cell table; gaps give 0, or null if asked."""
    return df.withColumn(name, X.table_values(F.col("seq_a"), F.col("seq_b"), cells, unknown_is_null))


def tensor_features(df: DataFrame, tables: np.ndarray, name: str) -> DataFrame:
    """Add ``ARRAY<ARRAY<DOUBLE>>``: one array of site values per 400-cell table."""
    return df.withColumn(name, X.tensor_values(F.col("seq_a"), F.col("seq_b"), tables))


def site_cell_counts(df: DataFrame, width: int) -> np.ndarray:
    """(sites x padded cells): how many pairs face which two residues at a site.

    Every per-site statistic of any matrix (means, least-squares fits) follows from these counts,
    so a search over matrices reads the pairs once for all of them. Tasks count on their own rows
    first; the result has at most sites x 441 numbers however many pairs there are.
    """
    cells = (X.N + 1) ** 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * cells, dtype=np.int64)
        for batch in batches:
            _, at = X.cell_places(batch.column(0), batch.column(1))
            place = np.tile(np.arange(width), batch.num_rows)
            total += np.bincount(place * cells + at, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    parts = df.select("seq_a", "seq_b").mapInArrow(count, "place bigint, n bigint")
    out = np.zeros(width * cells)
    for row in parts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row["place"]] = row["n"]
    return out.reshape(width, cells)


def combined_features(df: DataFrame, scalar_cells: Sequence[float], matrix_cells: Sequence[float]) -> DataFrame:
    """Add ``x0`` (differences), ``x1`` (weighted scalars), ``x2`` (weighted matrices), ``features``.

    Both tables are weighted sums over their properties, collapsed to 400 cells beforehand, so a
    pair costs three gathers however many properties there are. Gaps give 0 in ``x1`` and ``x2``;
    in ``x0`` all gaps and unknown letters count as one letter.
    """
    out = df.withColumn("x0", X.class_differences(F.col("seq_a"), F.col("seq_b"), list(AMINO_ACIDS)).cast("array<double>"))
    out = table_features(out, scalar_cells, "x1")
    out = table_features(out, matrix_cells, "x2")
    return out.withColumn("features", F.concat("x0", "x1", "x2"))


def pair_distances(pairs: DataFrame, points: DataFrame, name: str = "dist", limit: int = LIMIT) -> DataFrame:
    """L2 distance of the listed pairs from ``points`` ``(name, point ARRAY)``."""
    both = attach_sequences(pairs, points, ("point",), limit)
    return both.withColumn(name, P.euclidean(F.col("point_a"), F.col("point_b"))).drop("point_a", "point_b")


def both_directions(distances: DataFrame, value: str = "dist") -> DataFrame:
    """Rows plus their mirror image."""
    mirrored = distances.select(F.col("b").alias("a"), F.col("a").alias("b"), value)
    return distances.select("a", "b", value).unionByName(mirrored)


def patch_distances(distances: DataFrame, predicted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Distances between predicted names, with predictions in place of truth in both directions.

    ``distances`` is symmetric; ``predicted`` is ``(a, b, prediction)`` with one row per pair.
    """
    names = predicted.select("a").union(predicted.select(F.col("b").alias("a")))
    cut = keep_both_ends(distances, names, "a", "b", limit)
    patched = lookup(cut, both_directions(predicted, "prediction"), ["a", "b"], "left", limit)
    return patched.withColumn("patched", F.coalesce("prediction", "dist")).drop("prediction")


def site_values(df: DataFrame, column: str, keys: Sequence[str] = ("a", "b")) -> DataFrame:
    """Long form ``(keys, site, value)``; only for aggregates over sites."""
    return df.select(*keys, F.posexplode(column).alias("site", "value"))
