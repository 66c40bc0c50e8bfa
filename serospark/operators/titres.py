"""Assay curation: canonical pairs, censored means, log distances, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from serospark.functions import titres as T
from serospark.plans.skew import LIMIT, keep_both_ends, lookup_as, with_group_stats
from serospark.sources.tables import quoted

PAIR = ["virus_1", "virus_2"]


def canonical_pair(df: DataFrame, test: str = "test", ref: str = "ref", directed: bool = False) -> DataFrame:
    """Add ``virus_1``/``virus_2``: stripped names in code-point order.

    Which side was the test virus is lost on purpose; ``directed=True`` keeps it.
    """
    a, b = F.col(test), F.col(ref)
    if directed:
        return df.withColumn("virus_1", T.stripped(a)).withColumn("virus_2", T.stripped(b))
    return df.withColumn("virus_1", T.first_of_pair(a, b)).withColumn("virus_2", T.second_of_pair(a, b))


def titre_summary(df: DataFrame, keys: Sequence[str] = PAIR, titre: str = "titre") -> DataFrame:
    """One row per key with counts per titre kind and the censored mean.

    Any number wins over ``<n`` and ``*``; without numbers the smallest bound is kept; only ``*``
    stays ``*``. A group holding an illegal text has kind ``illegal`` and no titre. All partial
    states are numbers, so the aggregate combines on the map side and a hot pair costs one row
    per task.
    """
    kind = F.col("_kind")
    parsed = df.select(
        *keys, T.titre_kind(F.col(titre)).alias("_kind"), T.titre_number(F.col(titre)).alias("_value")
    )
    summary = parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(kind == T.NUMBER).alias("n_numeric"),
        F.count_if(kind == T.BELOW).alias("n_below"),
        F.count_if(kind == T.MISSING).alias("n_missing"),
        F.count_if((kind == T.BELOW) & F.col("_value").isNull()).alias("_bad_bounds"),
        F.avg(F.when(kind == T.NUMBER, F.col("_value"))).alias("mean_titre"),
        F.min(F.when(kind == T.BELOW, F.col("_value"))).alias("bound"),
    )
    legal = F.col("n_numeric") + F.col("n_below") + F.col("n_missing") == F.col("n_rows")
    group_kind = (
        F.when(~legal, T.ILLEGAL)
        .when(F.col("n_numeric") > 0, T.NUMBER)
        .when(F.col("_bad_bounds") > 0, T.ILLEGAL)
        .when(F.col("n_below") > 0, T.BELOW)
        .otherwise(T.MISSING)
    )
    return summary.withColumn("kind", group_kind).drop("_bad_bounds")


def render_titre(df: DataFrame, truncate: bool = True) -> DataFrame:
    """Add the text form ``titre`` to a ``titre_summary``; means lose their fraction by default."""
    mean = T.truncate_titre(F.col("mean_titre")) if truncate else F.col("mean_titre")
    return df.withColumn(
        "titre",
        F.when(F.col("kind") == T.NUMBER, mean.cast("string"))
        .when(F.col("kind") == T.BELOW, F.concat(F.lit("<"), F.col("bound").cast("string")))
        .when(F.col("kind") == T.MISSING, F.lit("*")),
    )


def censored_mean(df: DataFrame, keys: Sequence[str] = PAIR, titre: str = "titre", truncate: bool = True) -> DataFrame:
    """Legal groups of ``titre_summary`` with their text titre."""
    return render_titre(titre_summary(df, keys, titre).filter(F.col("kind") != T.ILLEGAL), truncate)


def quarantine(df: DataFrame, keys: Sequence[str] = PAIR, titre: str = "titre") -> DataFrame:
    """Groups left out of ``censored_mean`` because they hold an illegal titre."""
    return titre_summary(df, keys, titre).filter(F.col("kind") == T.ILLEGAL)


def drop_self_pairs(df: DataFrame, a: str = "virus_1", b: str = "virus_2") -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def merge_reports(assay: DataFrame, truncate: bool = True) -> DataFrame:
    """First pass: all reports to one titre per canonical pair. Self pairs stay."""
    return censored_mean(canonical_pair(assay), truncate=truncate)


def collapse_to_representatives(
    pairs: DataFrame, name_map: DataFrame, truncate: bool = True, limit: int = LIMIT
) -> DataFrame:
    """Second pass: both ends to their representative, mean again, self pairs dropped.

    Names missing from ``name_map`` (``name``, ``representative``) drop their pairs.
    """
    mapped = remap_pairs(pairs, name_map, "virus_1", "virus_2", limit=limit)
    again = canonical_pair(mapped.select(F.col("virus_1").alias("test"), F.col("virus_2").alias("ref"), "titre"))
    return drop_self_pairs(censored_mean(again, truncate=truncate))


def titre_distance(df: DataFrame, titre: str = "titre") -> DataFrame:
    """``max(log2 titre) - log2 titre`` against the global maximum, one scalar for the whole plan."""
    logged = df.withColumn("log2_titre", F.log2(T.titre_value(F.col(titre))))
    top = logged.select(F.max("log2_titre")).scalar()
    return logged.withColumn("distance", top - F.col("log2_titre"))


def column_basis_distance(
    df: DataFrame, ref: str = "ref", titre: str = "titre", limit: int = LIMIT
) -> DataFrame:
    """Per serum: highest ``log2(titre/10)`` minus ``log2(titre/10)``; ``<n`` reads as n, flagged.

    Unmeasured cells are dropped. The column maximum is a map-side combined aggregate joined back,
    so a serum with a large share of the table does not end in one task.
    """
    cells = (
        df.withColumn("_kind", T.titre_kind(F.col(titre)))
        .filter(F.col("_kind").isin(T.NUMBER, T.BELOW))
        .withColumn("censored", F.col("_kind") == T.BELOW)
        .withColumn("log_titre", F.log2(T.titre_number(F.col(titre)) / F.lit(10.0)))
        .drop("_kind")
    )
    based = with_group_stats(cells, [ref], {"column_basis": F.max("log_titre")}, limit)
    return based.withColumn("distance", F.col("column_basis") - F.col("log_titre"))


def duplicate_cells(df: DataFrame, row: str = "virus_1", column: str = "virus_2") -> DataFrame:
    """Cells that occur more than once; a matrix may only be built where this is empty."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def to_matrix(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    row: str = "virus_1",
    column: str = "virus_2",
    titre: str = "titre",
    max_columns: int = 10_000,
) -> DataFrame:
    """Wide titre matrix with ``*`` in the gaps, for the sink only; duplicate cells raise.

    Column names are read from the data when not given; more than ``max_columns`` raise, since a
    wider matrix belongs in long form.
    """
    if columns is None:
        found = df.select(column).distinct().orderBy(column).limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"more than {max_columns} matrix columns; keep the long form")
        columns = [r[0] for r in found]
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate matrix cell"))).otherwise(F.max(titre))
    cells = df.groupBy(row, column).agg(single.cast("string").alias("_titre"))
    wide = cells.groupBy(row).pivot(column, list(columns)).agg(F.max("_titre"))
    return wide.select(row, *[F.coalesce(quoted(c), F.lit("*")).alias(c) for c in columns])


def numeric_edges(df: DataFrame, a: str = "virus_1", b: str = "virus_2", titre: str = "titre") -> DataFrame:
    """Numeric cells as undirected edges ``(a, b)``; rows and columns share one namespace."""
    return df.filter(T.titre_kind(F.col(titre)) == T.NUMBER).select(F.col(a).alias("a"), F.col(b).alias("b"))


def semi_filter_pairs(
    df: DataFrame, names: DataFrame, a: str = "virus_1", b: str = "virus_2", limit: int = LIMIT
) -> DataFrame:
    """Rows whose both ends are in the single-column table ``names``."""
    return keep_both_ends(df, names, a, b, limit)


def remap_pairs(
    df: DataFrame,
    name_map: DataFrame,
    a: str = "virus_1",
    b: str = "virus_2",
    limit: int = LIMIT,
) -> DataFrame:
    """Replace both ends by their representative; unmapped names drop the row."""
    columns = df.columns
    out = df
    for end in (a, b):
        out = lookup_as(out, name_map, end, "name", {"representative": "_rep"}, limit=limit, counted=df)
        out = out.withColumn(end, F.col("_rep")).drop("_rep")
    return out.select(*columns)


def involved_names(df: DataFrame, a: str = "virus_1", b: str = "virus_2") -> DataFrame:
    """Distinct names on either side."""
    return df.select(F.col(a).alias("name")).union(df.select(F.col(b).alias("name"))).distinct()
