"""Joins and group statistics that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from serospark.session import cut_lineage

# Rows of a key that stand in one slice, and the share of all rows (one in so many) that may at any size.
LIMIT, SHARE = 20_000, 100_000
# Hash ranges in which the keys of a stored table are counted; more than ``SHARE``, so that a range of average size is never too full.
RANGES = 1 << 18


def hot_keys(counts: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``(*keys, _slices)`` of the keys whose rows ``_n`` need more than one slice.

    A key has more than ``limit`` rows and more than one in ``SHARE`` of all rows, so there are fewer than ``SHARE``
    such keys in a table of any size. That bound is what allows to broadcast them.
    """
    total = counts.agg(F.sum("_n").alias("total")).scalar()
    rows = F.greatest(F.lit(limit).cast("double"), total / SHARE)
    hot = counts.filter(F.col("_n") > rows).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_slices"))
    return F.broadcast(hot)


def stored_hot_keys(df: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """``hot_keys`` of one column, worked out once for the joins of a loop."""
    counts = df.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(cut_lineage(hot_keys(counts, [key], limit), "hot"))


def crowded_keys(stored: DataFrame, key: str, limit: int = LIMIT) -> DataFrame | None:
    """``hot_keys`` of one column of a stored table, or None where no key is hot.

    Rows are counted by hash range, combined in tasks first, so what is shuffled doesn't grow with the number of keys. A hot key
    fills its range beyond the bound by itself; only the keys of such ranges are counted one by one.
    """
    known = stored.select(key).dropna().withColumn("_range", F.pmod(F.xxhash64(key), F.lit(RANGES)))
    sizes = known.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    most, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    rows = max(float(limit), (total or 0) / SHARE)
    if (most or 0) <= rows:
        return None
    full = sizes.filter(F.col("_n") > rows).select("_range")
    counts = known.join(F.broadcast(full), "_range", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(counts.filter(F.col("_n") > rows).select(key, F.ceil(F.col("_n") / rows).cast("int").alias("_slices")))


def _dealt(left: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with ``_slice``: 0, or the slice of a row of a hot key.

    Rows go by their values and the task they come from, so equal rows spread and a retried task repeats its slices.
    """
    hashed = [F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    place = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.col("_slices")).cast("int")
    return left.join(hot, list(keys), "left").withColumn("_slice", F.when(F.col("_slices").isNull(), 0).otherwise(place)).drop("_slices")


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "inner", limit: int = LIMIT, counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, where ``right`` has one row per key.

    The rows of every key on the left are counted, combined before the shuffle. A key with more than ``limit`` rows
    (and more than one in ``SHARE`` of all) is dealt over as many slices as it needs, and its row on the right is repeated once per
    slice; any other key stays whole and its row on the right stands once. So a key that holds a third of the rows
    becomes equal parts of bounded size, and nothing is copied for the rest. A right side that the optimizer's own size check
    finds small is broadcast. A null key matches nothing. ``counted`` names a cheaper table to count instead: one
    with at least the rows of ``left`` for each key, such as the table it was joined from.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = (left if counted is None else counted).select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sliced_join(left, right, keys, how, hot_keys(counts.dropna(subset=keys), keys, limit))


def sliced_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame | None) -> DataFrame:
    """``lookup`` with the ``hot_keys`` known beforehand, or None where ``right`` is known to be small and is broadcast."""
    if hot is None:
        return left.join(F.broadcast(right), keys, how)
    copies = right.join(hot, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
    return _dealt(left, hot, keys).join(copies, [*keys, "_slice"], how).drop("_slice")


def lookup_as(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    values: dict[str, str],
    how: str = "inner",
    limit: int = LIMIT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``lookup`` on differently named keys; ``values`` maps right columns to new names."""
    renamed = right.select(
        F.col(right_key).alias(left_key), *[F.col(old).alias(new) for old, new in values.items()]
    )
    return lookup(left, renamed, left_key, how, limit, counted)


def lookup_ends(
    edges: DataFrame, right: DataFrame, key: str, values: dict[str, tuple[str, str]], ends: tuple[str, str] = ("a", "b"), how: str = "inner", limit: int = LIMIT,
    stored: bool = False,
) -> DataFrame:
    """``lookup_as`` for both ends of an edge table; ``values`` maps right columns to their names at either end.

    The keys of a ``stored`` table are counted beforehand. Where none is hot, both ends are joined to the same table as it is, which
    is then worked out and shuffled once for both.
    """
    out = edges
    for i, end in enumerate(ends):
        named = {c: names[i] for c, names in values.items()}
        if not stored:
            out = lookup_as(out, right, end, key, named, how, limit, edges)
            continue
        renamed = right.select(F.col(key).alias(end), *[F.col(old).alias(new) for old, new in named.items()])
        hot = crowded_keys(edges, end, limit)
        out = out.join(renamed, end, how) if hot is None else sliced_join(out, renamed, [end], how, hot)
    return out


def keep_members(df: DataFrame, members: DataFrame, column: str, limit: int = LIMIT, counted: DataFrame | None = None) -> DataFrame:
    """Rows whose ``column`` occurs in the single-column table ``members`` (made distinct here)."""
    distinct = members.select(F.col(members.columns[0]).alias(column)).distinct()
    return lookup(df, distinct, column, "inner", limit, counted).select(*df.columns)


def keep_both_ends(df: DataFrame, members: DataFrame, a: str, b: str, limit: int = LIMIT) -> DataFrame:
    """Rows whose two ends both occur in ``members``."""
    return keep_members(keep_members(df, members, a, limit), members, b, limit, df)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input whose rows cost more than their transport over all cores, in as many tasks as a shuffle has."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: dict[str, Column], limit: int = LIMIT
) -> DataFrame:
    """Add per-group aggregates to every row.

    A window over the group would sort a whole group in one task; here the aggregate is combined
    on the map side and joined back with ``lookup``. The same aggregate counts the rows of each group.
    """
    keys = list(keys)
    table = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[expr.alias(name) for name, expr in stats.items()])
    return sliced_join(df, table.drop("_n"), keys, "inner", hot_keys(table.select(*keys, "_n").dropna(subset=keys), keys, limit))


def ordered_ids(names: DataFrame) -> DataFrame:
    """``(name, id)`` for the distinct names of a one-column table; ids ascend with the names.

    Names are dealt by ranges and numbered within their task, so no task sees them all. The table is
    written out, so a retry cannot number anew.
    """
    name = names.columns[0]
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = names.distinct().repartitionByRange(tasks, name).sortWithinPartitions(name)
    return cut_lineage(ranged.select(name, F.monotonically_increasing_id().alias("id")), "ids")


def dense_ids(names: DataFrame, label: str = "id") -> DataFrame:
    """``(name, label)`` with ids 0..n-1: the ids of every task, moved up by the number of names before it."""
    ids = ordered_ids(names)
    task, own = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = ids.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))  # a row per task
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = ids.withColumn("task", task).join(F.broadcast(sizes.select("task", before.alias("before"))), "task")
    return moved.select(names.columns[0], (F.col("before") + own).alias(label))
