"""Expressions on the two aligned sequences of a pair, and on the two points of a pair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from serospark.functions.constants import EPITOPES, KEY_SITES
from serospark.functions.residues import motif_mask


def total(values: Column) -> Column:
    """Sum of an array as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def glycosylation_changed(a: Column, b: Column) -> Column:
    """1 if the motif positions of two sequence texts differ."""
    return (motif_mask(a) != motif_mask(b)).cast("int")


def any_site_changed(a: Column, b: Column, sites: Sequence[int]) -> Column:
    """1 if any of the 1-based sites differs; sites past the end are skipped."""
    def differs(site: int) -> Column:
        x, y = F.substring(a, site, 1), F.substring(b, site, 1)
        return (F.length(a) >= site) & (x != y)

    return reduce(lambda p, q: p | q, [differs(s) for s in sites]).cast("int")


def key_site_changed(a: Column, b: Column, sites: Sequence[int] = KEY_SITES) -> Column:
    return any_site_changed(a, b, sites)


def epitope_changed(a: Column, b: Column, regions: dict[str, Sequence[int]] = EPITOPES) -> dict[str, Column]:
    """One 0/1 flag per named region."""
    return {name: any_site_changed(a, b, sites) for name, sites in regions.items()}


def euclidean(x: Column, y: Column) -> Column:
    """L2 distance of two coordinate arrays."""
    return F.sqrt(total(F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))))
