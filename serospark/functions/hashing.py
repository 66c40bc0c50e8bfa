"""A portable pseudo-random number per row, repeatable outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_hash(*parts: Column, seed: int = 42) -> Column:
    """Number in [0, 1) from the first 32 bits of the md5 of the parts and the seed."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fold_of(u: Column, k: int) -> Column:
    """Fold 0..k-1 of a ``unit_hash``."""
    return F.floor(u * k).cast("int")
