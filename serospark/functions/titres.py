"""Titre expressions. A titre is a number, ``<n`` (below detection) or ``*`` (not measured)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER, BELOW, MISSING, ILLEGAL = "number", "below", "missing", "illegal"


# White space as a Unicode string method strips it.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    """``text`` without white space at both ends, tabs and no-break spaces included."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def titre_kind(titre: Column) -> Column:
    """Class of a titre text: digits only, ``*``, ``<`` followed by a digit, else illegal."""
    text = stripped(titre)
    return (
        F.when(text.isNull(), ILLEGAL)
        .when(text.rlike("^[0-9]+$"), NUMBER)
        .when(text == "*", MISSING)
        .when(text.rlike("^<[0-9]"), BELOW)
        .otherwise(ILLEGAL)
    )


def titre_number(titre: Column) -> Column:
    """The integer in a number or ``<n`` text, null where there is none."""
    return F.regexp_replace(stripped(titre), "^<", "").try_cast("bigint")


def titre_value(titre: Column) -> Column:
    """Numeric reading of a titre: ``<n`` is n/2, ``*`` is null, anything else its number."""
    text = stripped(titre)
    return (
        F.when(text.contains("<"), F.regexp_replace(text, "<", "").try_cast("double") / 2)
        .when(text.contains("*"), F.lit(None).cast("double"))
        .otherwise(text.try_cast("double"))
    )


def first_of_pair(a: Column, b: Column) -> Column:
    return F.least(stripped(a), stripped(b))


def second_of_pair(a: Column, b: Column) -> Column:
    return F.greatest(stripped(a), stripped(b))


def truncate_titre(mean: Column) -> Column:
    """Integer part of a mean titre, toward zero."""
    return mean.cast("bigint")
