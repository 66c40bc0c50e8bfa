"""Sequence curation: best records, representatives, variable sites.

Keep-first operators order by explicit columns, since a DataFrame has no file order. They pick the
winner with a ``min`` over a struct, which combines on the map side; a window would sort a whole
group (one strain, or one sequence shared by a third of all strains) in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from serospark.functions import residues as R
from serospark.plans.skew import LIMIT, keep_both_ends, keep_members, lookup, lookup_as


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key the row that is smallest in ``order``; remaining columns settle what is left."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[expr.alias(f"_o{i}") for i, expr in enumerate(order)], *rest)
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def keep_named(df: DataFrame, names: DataFrame, column: str = "name", limit: int = LIMIT) -> DataFrame:
    return keep_members(df, names, column, limit)


def best_record(df: DataFrame, order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """Per name: records without gap or ``X`` first, then the longest; the earliest wins ties."""
    seq = F.col("seq")
    rank = [(~R.is_clean(seq)).cast("int"), -R.clean_length(seq), *[F.col(c) for c in order]]
    return first_by(df, ["name"], rank)


def fewest_gaps(df: DataFrame, order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """Per name the record with the fewest ``-``; the earliest wins ties."""
    return first_by(df, ["name"], [R.gap_count(F.col("seq")), *[F.col(c) for c in order]])


def drop_gapped(df: DataFrame) -> DataFrame:
    """Records without ``-``; ``X`` stays."""
    return df.filter(~F.col("seq").contains("-"))


def gap_report(df: DataFrame) -> DataFrame:
    """How many records ``drop_gapped`` keeps and drops."""
    gapped = F.col("seq").contains("-")
    return df.agg(F.count_if(~gapped).alias("n_kept"), F.count_if(gapped).alias("n_dropped"))


def ha1_region(df: DataFrame, start: int = R.HA1_START, end: int = R.HA1_END) -> DataFrame:
    return df.withColumn("seq", R.slice_region(F.col("seq"), start, end))


def representatives(df: DataFrame, order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """``(seq, representative)``: per distinct sequence the name with the earliest year."""
    dated = df.withColumn("_year", R.year_of(F.col("name"))).filter(F.col("_year").isNotNull())
    best = first_by(dated, ["seq"], [F.col("_year"), *[F.col(c) for c in order]])
    return best.select("seq", F.col("name").alias("representative"))


def undated_names(df: DataFrame) -> DataFrame:
    """Records whose name carries no year; they cannot take part in ``representatives``."""
    return df.filter(R.year_of(F.col("name")).isNull())


def representative_map(
    df: DataFrame, order: Sequence[str] = ("file", "pos"), limit: int = LIMIT
) -> DataFrame:
    """``(name, representative)`` for every name; for a repeated name its last record counts."""
    reps = representatives(df, order)
    dated = df.filter(R.year_of(F.col("name")).isNotNull())
    last = dated.groupBy("name").agg(F.max_by("seq", F.struct(*order)).alias("seq"))
    return lookup(last, reps, "seq", "inner", limit).select("name", "representative")


def dedupe_sequences(df: DataFrame, order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """First record per distinct sequence in file order."""
    return first_by(df, ["seq"], [F.col(c) for c in order])


def first_n(df: DataFrame, n: int, order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """The first ``n`` records in file order."""
    return df.orderBy(*order).limit(n)


def common_names(seqs: DataFrame, distances: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Sequences and distance rows cut to the names both tables know."""
    known = distances.select(F.col("a").alias("name")).union(distances.select(F.col("b").alias("name")))
    kept = keep_members(seqs, known, "name", limit)
    names = kept.select("name")
    return kept, keep_both_ends(distances, names, "a", "b", limit)


def short_names(df: DataFrame, name_map: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``short_name`` from ``(full_name, short_name)``; unknown names get null."""
    return lookup_as(df, name_map, "name", "full_name", {"short_name": "short_name"}, "left", limit)


def site_residues(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``(site, residue, n)`` over all sequences, gaps left out; sites are zero-based."""
    cells = df.select(F.posexplode_outer(R.residues(F.col(seq))).alias("site", "residue"))
    return cells.filter(F.col("residue") != "-").groupBy("site", "residue").agg(F.count(F.lit(1)).alias("n"))


def variable_sites(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``(site, n_residues)`` of sites with more than one residue, gaps ignored.

    The exploded cells never leave their task: they collapse to at most letters x sites partial
    counts before the shuffle.
    """
    counted = site_residues(df, seq).groupBy("site").agg(F.count(F.lit(1)).alias("n_residues"))
    return counted.filter(F.col("n_residues") > 1)


def site_list(sites: DataFrame) -> Column:
    """The site column as one sorted array, usable as a constant in any expression."""
    return sites.select(F.sort_array(F.collect_list("site"))).scalar()


def project_variable_sites(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Cut every sequence to the variable sites of the whole table."""
    kept = R.project_sites(R.residues(F.col(seq)), F.col("_sites"))
    with_sites = df.withColumn("_sites", site_list(variable_sites(df, seq)))
    return with_sites.withColumn(seq, F.array_join(kept, "")).drop("_sites")


def encode_table(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn("codes", R.encode_residues(F.col(seq)))
