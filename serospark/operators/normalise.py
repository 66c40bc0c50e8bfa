"""Scaling, imputing, decorrelating and ranking of residue properties and features.

Property tables carry one row per property: ``(prop, ord, vals)`` with twenty numbers in alphabet
order, or ``(prop, ord, cells)`` with 400 numbers, row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from serospark.functions.constants import AMINO_ACIDS
from serospark.functions.pairs import total
from serospark.functions.residues import let
from serospark.functions.sites import imputed, residuals
from serospark.plans.skew import LIMIT, lookup, with_group_stats
from serospark.session import cut_lineage

N = len(AMINO_ACIDS)
# A set of property tables is turned into one constant; this many fit easily (5,000 x 400 doubles = 16 MB).
MAX_TABLES = 5_000


def scale_rows(scales: dict[str, Sequence[float]], spark) -> DataFrame:
    """Literal scales as a property table."""
    rows = [(name, i, [float(v) for v in values]) for i, (name, values) in enumerate(scales.items())]
    return spark.createDataFrame(rows, "prop string, ord bigint, vals array<double>")


def vals_to_long(props: DataFrame) -> DataFrame:
    letters = F.lit(list(AMINO_ACIDS))
    return props.select("prop", "ord", F.explode(F.arrays_zip(letters.alias("aa"), F.col("vals").alias("value"))).alias("_c")).select(
        "prop", "ord", F.col("_c.aa").alias("aa"), F.col("_c.value").alias("value"))


def cells_to_long(mats: DataFrame) -> DataFrame:
    at = F.lit(list(AMINO_ACIDS))
    cell = mats.select("prop", "ord", F.posexplode("cells").alias("_i", "value"))
    return cell.select(
        "prop", "ord",
        F.element_at(at, (F.col("_i") / N).cast("int") + 1).alias("aa_i"),
        F.element_at(at, F.col("_i") % N + 1).alias("aa_j"),
        "value",
    )


def long_to_cells(long: DataFrame, default: float | None = 0.0) -> DataFrame:
    """``(prop, ord, aa_i, aa_j, value)`` to 400-cell arrays; absent cells get ``default``."""
    place = (F.instr(F.lit(AMINO_ACIDS), F.col("aa_i")) - 1) * N + F.instr(F.lit(AMINO_ACIDS), F.col("aa_j")) - 1
    known = (F.instr(F.lit(AMINO_ACIDS), F.col("aa_i")) > 0) & (F.instr(F.lit(AMINO_ACIDS), F.col("aa_j")) > 0)
    found = long.filter(known).groupBy("prop", "ord").agg(
        F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col("value").alias("v")))).alias("_m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(N * N - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(default).cast("double")))
    return found.select("prop", "ord", cells.alias("cells"))


def zscore_vals(props: DataFrame) -> DataFrame:
    """``(v - mean) / population std`` over the twenty letters, inside each row; null if constant."""
    mean = total(F.col("vals")) / F.size("vals")
    with_mean = props.withColumn("_mean", mean)
    var = F.aggregate("vals", F.lit(0.0), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean"))) / F.size("vals")
    with_std = with_mean.withColumn("_std", F.sqrt(var))
    scaled = F.transform("vals", lambda v: F.try_divide(v - F.col("_mean"), F.col("_std")))
    return with_std.withColumn("vals", scaled).drop("_mean", "_std")


def range_scale_cells(mats: DataFrame) -> DataFrame:
    """``v / (max - min)`` without a shift, 0 where the range is 0."""
    span = F.array_max("cells") - F.array_min("cells")
    scaled = let(span, lambda s: F.transform(F.col("cells"), lambda v: F.when(s > 0, v / s).otherwise(F.lit(0.0))))
    return mats.withColumn("cells", scaled)


def zscore_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "zscore", limit: int = LIMIT) -> DataFrame:
    """Z-score of a long column within groups of any size."""
    stats = with_group_stats(df, keys, {"_mean": F.avg(value), "_std": F.stddev_pop(value)}, limit)
    return stats.withColumn(out, F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def range_scale_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "scaled", limit: int = LIMIT) -> DataFrame:
    """``v / (max - min)`` of a long column within groups of any size, 0 where the range is 0."""
    stats = with_group_stats(df, keys, {"_span": F.max(value) - F.min(value)}, limit)
    scaled = F.when(F.col("_span") > 0, F.col(value) / F.col("_span")).otherwise(F.lit(0.0))
    return stats.withColumn(out, scaled).drop("_span")


def constant_diagonal(mats: DataFrame) -> DataFrame:
    """Matrices whose diagonal is one value, with that value subtracted from every cell."""
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.element_at(F.col("cells"), i * (N + 1) + 1))
    first = F.element_at("cells", 1)
    kept = mats.filter((F.array_min(diagonal) == first) & (F.array_max(diagonal) == first))
    return kept.withColumn("cells", let(first, lambda d: F.transform(F.col("cells"), lambda v: v - d)))


def symmetrise(lower: DataFrame) -> DataFrame:
    """Lower triangle in long form to the full matrix."""
    swapped = lower.filter(F.col("aa_i") != F.col("aa_j")).select("prop", "ord", F.col("aa_j").alias("aa_i"), F.col("aa_i").alias("aa_j"), "value")
    return lower.select("prop", "ord", "aa_i", "aa_j", "value").unionByName(swapped)


def similarity_to_distance(mats: DataFrame) -> DataFrame:
    """``D = A_ii + A_jj - 2 A_ij`` per matrix row."""
    def cell(i: Column) -> Column:
        row, col = (i / N).cast("int"), i % N
        c = F.col("cells")
        return F.element_at(c, row * (N + 1) + 1) + F.element_at(c, col * (N + 1) + 1) - F.lit(2.0) * F.element_at(c, i + 1)

    return mats.withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(N * N - 1)), cell))


def difference_cells(props: DataFrame) -> DataFrame:
    """400-cell table ``abs(v_i - v_j)`` of each scalar property."""
    def cell(i: Column) -> Column:
        v = F.col("vals")
        return F.abs(F.element_at(v, (i / N).cast("int") + 1) - F.element_at(v, i % N + 1))

    return props.select("prop", "ord", F.transform(F.sequence(F.lit(0), F.lit(N * N - 1)), cell).alias("cells"))


def table_set(mats: DataFrame, order: str = "ord") -> np.ndarray:
    """All matrices as one array (tables x 400), ordered; more than ``MAX_TABLES`` raise."""
    rows = mats.select(order, "cells").orderBy(order).limit(MAX_TABLES + 1).collect()
    if len(rows) > MAX_TABLES:
        raise ValueError(f"more than {MAX_TABLES} property tables")
    return np.array([r["cells"] for r in rows], dtype=float).reshape(len(rows), N * N)


def weighted_table(mats: DataFrame, weights: DataFrame) -> np.ndarray:
    """One 400-cell table: the sum of weight x matrix, weights joined by property name."""
    chosen = mats.join(weights.select(F.col("prop_name").alias("prop"), "weight"), "prop")
    cells = chosen.select("weight", F.posexplode("cells").alias("_i", "_v"))
    summed = cells.groupBy("_i").agg(F.sum(F.col("weight") * F.col("_v")).alias("_v"))
    table = np.zeros(N * N)
    for row in summed.collect():  # at most 400 rows
        table[row["_i"]] = row["_v"]
    return table


def drop_correlated(props: DataFrame, threshold: float, block: int = 128) -> DataFrame:
    """Greedy selection in ``ord`` order: a kept property removes later ones with abs(corr) > threshold.

    Works block by block: the first ``block`` undecided properties are settled among themselves
    from their twenty numbers each, then every later property is tested against the ones just
    kept in one narrow pass. The correlation of a constant property is undefined and removes nothing.
    """
    def centred(vectors: np.ndarray) -> np.ndarray:
        dev = vectors - vectors.mean(axis=1, keepdims=True)
        norm = np.sqrt((dev * dev).sum(axis=1, keepdims=True))
        return np.divide(dev, norm, out=np.full_like(dev, np.nan), where=norm > 0)

    spark = props.sparkSession
    unit = let(total(F.col("vals")) / F.size("vals"), lambda m: F.transform(F.col("vals"), lambda v: v - m))
    norm = let(F.aggregate("_dev", F.lit(0.0), lambda acc, v: acc + v * v), lambda s: F.sqrt(s))
    pending = props.withColumn("_dev", unit).withColumn("_norm", norm).withColumn(
        "_unit", F.transform("_dev", lambda v: F.try_divide(v, F.col("_norm")))).select("ord", "prop", "vals", "_unit")
    kept_ords: list[int] = []
    while True:
        head = pending.orderBy("ord").limit(block).collect()
        if not head:
            break
        units = centred(np.array([r["vals"] for r in head], dtype=float))
        alive = np.ones(len(head), dtype=bool)
        for i in range(len(head)):
            if alive[i]:
                alive[i + 1:] &= ~(np.abs(units[i + 1:] @ units[i]) > threshold)
        fresh = [u for i, u in enumerate(units) if alive[i] and not np.isnan(u).any()]
        kept_ords += [r["ord"] for i, r in enumerate(head) if alive[i]]
        pending = pending.filter(F.col("ord") > head[-1]["ord"])
        if fresh:
            against = F.lit([[float(v) for v in u] for u in fresh])
            near = F.exists(against, lambda u: F.coalesce(
                F.abs(F.aggregate(F.zip_with(u, F.col("_unit"), lambda p, q: p * q), F.lit(0.0), lambda acc, x: acc + x)) > threshold,
                F.lit(False)))
            pending = pending.filter(~near)
    chosen = spark.createDataFrame([(int(o),) for o in kept_ords], "ord bigint")
    return props.join(chosen, "ord", "left_semi")


def fit_target_scaler(df: DataFrame, label: str = "dist") -> dict[str, float]:
    """Mean and population standard deviation of the training label."""
    row = df.agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("std")).first()
    return {"mean": row["mean"], "std": row["std"]}


def apply_target_scaler(df: DataFrame, scaler: dict[str, float], label: str = "dist") -> DataFrame:
    return df.withColumn(label, (F.col(label) - scaler["mean"]) / scaler["std"])


def invert_target_scaler(df: DataFrame, scaler: dict[str, float], column: str = "prediction") -> DataFrame:
    return df.withColumn(column, F.col(column) * scaler["std"] + scaler["mean"])


def fit_standard_scaler(df: DataFrame, column: str) -> dict[str, list[float]]:
    """Mean and population standard deviation of every place of an array column; constants get 1."""
    cells = df.select(F.posexplode(column).alias("site", "value"))
    rows = cells.groupBy("site").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).orderBy("site").collect()
    return {"mean": [r["mean"] for r in rows], "std": [r["std"] or 1.0 for r in rows]}


def apply_standard_scaler(df: DataFrame, scaler: dict[str, list[float]], column: str) -> DataFrame:
    mean, std = F.lit(scaler["mean"]), F.lit(scaler["std"])
    scaled = F.transform(F.col(column), lambda v, i: (v - F.element_at(mean, i + 1)) / F.element_at(std, i + 1))
    return df.withColumn(column, scaled)


def site_means(df: DataFrame, column: str) -> DataFrame:
    """``(site, mean)`` over the non-null entries of an array column."""
    # Outer explodes keep an array that is costly to make from being made a second time as a test.
    cells = df.select(F.posexplode_outer(column).alias("site", "value")).filter("site IS NOT NULL")
    return cells.groupBy("site").agg(F.avg("value").alias("mean"))


def mean_impute(df: DataFrame, column: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill null array entries with the site mean of ``fitted_on`` (default ``df``).

    Sites without any value vanish from the array, in both tables, as they would in a column imputer.
    An input that is fitted on itself is written out, so it is worked out once.
    """
    if fitted_on is None:
        df = fitted_on = cut_lineage(df, "input")
    means = site_means(fitted_on, column).filter(F.col("mean").isNotNull())
    # Sites are bounded by the sequence length.
    return df.withColumn(column, imputed(F.col(column), {r["site"]: r["mean"] for r in means.collect()}))


def residual_fit(df: DataFrame, main: str, aux: str) -> DataFrame:
    """``(site, slope, intercept)`` of the least-squares fit of ``aux`` on ``main`` per site.

    A site where ``main`` is constant has slope 0 and the mean as intercept.
    """
    zipped = F.arrays_zip(F.col(main).alias("x"), F.col(aux).alias("y"))
    cells = df.select(F.posexplode_outer(zipped).alias("site", "c")).filter("site IS NOT NULL").select("site", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    fit = cells.groupBy("site").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("y").alias("_mean"))
    flat = F.col("slope").isNull() | F.isnan("slope")
    return fit.select(
        "site",
        F.when(flat, F.lit(0.0)).otherwise(F.col("slope")).alias("slope"),
        F.when(flat, F.col("_mean")).otherwise(F.col("intercept")).alias("intercept"),
    )


def residualise(df: DataFrame, main: str, aux: str, out: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Add ``out``: per site ``aux`` minus its fit on ``main``; the fit comes from ``fitted_on``."""
    if fitted_on is None:
        df = fitted_on = cut_lineage(df, "input")
    fit = residual_fit(fitted_on, main, aux)
    return df.withColumn(out, residuals(F.col(main), F.col(aux), {r["site"]: (r["slope"], r["intercept"]) for r in fit.collect()}))


def fuse_weights(head_logits: DataFrame, prop_logits: DataFrame) -> DataFrame:
    """``(prop_name, weight)``: softmax over properties in each head, over heads, weighted sum.

    Both tables are bounded by heads x properties.
    """
    per_head = Window.partitionBy("head")
    top = F.max("logit").over(per_head)
    weighed = prop_logits.withColumn("_e", F.exp(F.col("logit") - top))
    weighed = weighed.withColumn("_w", F.col("_e") / F.sum("_e").over(per_head))
    peak = head_logits.select(F.max("logit")).scalar()
    heads = head_logits.withColumn("_h", F.exp(F.col("logit") - peak))
    norm = heads.select(F.sum("_h")).scalar()
    heads = heads.select("head", (F.col("_h") / norm).alias("_share"))
    fused = weighed.join(heads, "head").groupBy("prop_name").agg(F.sum(F.col("_w") * F.col("_share")).alias("weight"))
    return fused.orderBy(F.desc("weight"), "prop_name")


def top_n(df: DataFrame, n: int, by: str = "weight", name: str = "prop_name", ascending: bool = False) -> DataFrame:
    """The first ``n`` rows by ``by``; names settle ties."""
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), name).limit(n)


def select_by_names(props: DataFrame, ranked: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Properties named in ``ranked`` (``prop_name, weight``); the weight travels with the name."""
    return lookup(props, ranked.select(F.col("prop_name").alias("prop"), "weight"), "prop", "inner", limit)
