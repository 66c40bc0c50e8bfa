"""Expressions and joins shared by the operators of this package."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

SLICES = 16


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], slices: int = SLICES) -> DataFrame:
    """Left join of ``left`` to ``right``, which has one row per ``key``.

    Every key of ``left`` is dealt over the same number of slices by the hash of ``spread_by``, and
    ``right`` is repeated once per slice, so a key that holds a third of the rows still becomes
    ``slices`` equal parts. Nothing depends on counting keys first. A null key matches nothing and
    is spread the same way. Sizes estimated from files say little about such tables, so the copies
    are merged, not broadcast.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(slices)).cast("int")
    copies = right.withColumn("_slice", F.explode(F.array(*[F.lit(i) for i in range(slices)])))
    return left.withColumn("_slice", salt).join(copies.hint("merge"), [key, "_slice"], "left").drop("_slice")


# A key with more rows than this, and than a ten-thousandth of all rows, is dealt over slices.
HOT_ROWS, HOT_SHARE = 20_000, 10_000


def counted_lookup(left: DataFrame, right: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame:
    """Left join of ``left`` to ``right``, which has one row per ``key``, with slices only where a key needs them.

    The rows of every key of ``left`` are counted (combined before the shuffle). A key with more than ``limit``
    rows and more than a ten-thousandth of all rows has a slice for every such number, its row of ``right`` is
    repeated as often, and its rows are dealt over the slices by task and place, equal rows too. There are fewer than
    10,000 such keys, however large the table, which bounds what is broadcast. Any other key stays whole and its
    row of ``right`` stands once. A null key matches nothing and is dealt like any other.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    most = F.greatest(F.lit(limit).cast("double"), counts.agg((F.sum("_n") / HOT_SHARE).alias("most")).scalar())
    hot = counts.filter(F.col("_n") > most).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / most).cast("int").alias("_slices"))
    hot = F.broadcast(hot)
    place = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.col("_slices")).cast("int")
    dealt = left.join(hot, left[key].eqNullSafe(hot["_hot"]), "left").withColumn("_slice", F.coalesce(place, F.lit(0))).drop("_hot", "_slices")
    copied = right.join(hot, right[key] == hot["_hot"], "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))).drop("_hot", "_slices")
    return dealt.join(copied.hint("merge"), [key, "_slice"], "left").drop("_slice")
