"""Expressions on one aligned sequence or one strain name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from serospark.functions.constants import HA1_END, HA1_START
from serospark.functions.sites import letter_codes


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often a lambda reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def residues(seq: Column) -> Column:
    """Sequence text as an array of one-letter strings."""
    return F.split(seq, "")


def encode_residues(seq: Column) -> Column:
    """Residue codes 0..19 in alphabet order, -1 for gaps and unknown letters."""
    return letter_codes(seq)


def slice_region(seq: Column, start: int = HA1_START, end: int = HA1_END) -> Column:
    """Half-open, zero-based slice."""
    return F.substring(seq, start + 1, end - start)


def gap_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("-"), F.lit("")))


def clean_length(seq: Column) -> Column:
    """Length without ``-`` and ``X``."""
    return F.length(F.translate(seq, "-X", ""))


def is_clean(seq: Column) -> Column:
    """No ``-`` and no ``X``."""
    return ~seq.rlike("[-X]")


def motif_mask(seq: Column) -> Column:
    """``1`` where ``N``, not ``P``, then ``S`` or ``T`` starts, else ``0``; overlaps count."""
    return F.regexp_replace(F.regexp_replace(seq, "N(?=[^P][ST])", "1"), "[^1]", "0")


def glycosylation_sites(seq: Column) -> Column:
    """1-based starts of the motif."""
    return F.transform(
        F.filter(F.transform(F.split(motif_mask(seq), ""), lambda c, i: F.when(c == "1", i + 1)), lambda i: i.isNotNull()),
        lambda i: i.cast("int"))


def year_of(name: Column) -> Column:
    """Year after the last slash: four (or three) digits read with their century rule, else null.

    Exactly four digits are the year; fewer are appended to ``20``.
    """
    digits = F.regexp_extract(name, r"/(\d{2,4})$", 1)
    return (
        F.when(F.length(digits) == 4, digits)
        .when(F.length(digits) > 0, F.concat(F.lit("20"), digits))
        .cast("int")
    )


def name_from_pipe_header(header: Column) -> Column:
    """Text before the first ``|``."""
    return F.trim(F.substring_index(header, "|", 1))


def name_from_space_header(header: Column) -> Column:
    """Second word, joined with the third when it holds fewer than two slashes."""
    words = F.filter(F.split(header, r"\s+"), lambda w: w != "")
    second = F.try_element_at(words, F.lit(2))
    slashes = F.size(F.split(second, "/")) - 1
    return F.when(slashes < 2, F.concat_ws(" ", second, F.try_element_at(words, F.lit(3)))).otherwise(second)


def project_sites(chars: Column, sites: Column) -> Column:
    """Keep the zero-based ``sites`` of an array, in the order of ``sites``."""
    return let(chars, lambda letters: F.transform(sites, lambda s: F.element_at(letters, s.cast("int") + 1)))
