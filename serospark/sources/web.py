"""Report links in web pages and report periods in file names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from serospark.functions.constants import MONTH_THEN_YEAR, YEAR_THEN_MONTH
from serospark.functions.markup import OPEN, attributes, tokens

def folded_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps, however many there are."""
    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(page, r"^[^:]+://[^/]*(/.*/|/)", 1), F.lit("")), F.lit("/")))
    joined = (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(/[^?#]*)(.*)$"
    start, path, rest = (F.regexp_extract(joined, whole, g) for g in (1, 2, 3))
    return F.when(joined.rlike(whole), F.concat(start, folded_path(path), rest)).otherwise(joined)


def _anchors(suffix: str):
    """Batches of ``(url, html)`` to ``(url, position, href)`` of the anchors whose target ends in ``suffix``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, positions, targets = [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                position = 0
                for kind, name, rest in tokens(html or ""):
                    if kind != OPEN or name != "a" or (href := attributes(rest).get("href")) is None:
                        continue
                    href = href.strip(" \t\n\r\f")
                    if href.endswith(suffix):
                        owners.append(i)
                        positions.append(position)
                        targets.append(href)
                    position += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(positions, pa.int32()), pa.array(targets, pa.string())], names=["url", "position", "href"])
    return run


def extract_links(pages: DataFrame, suffix: str = ".pdf", html: str = "html", url: str = "url") -> DataFrame:
    """``(url, position, link)``: anchors whose target ends in ``suffix``, resolved against the page.

    Pages are read by an HTML tokeniser: what stands in comments, scripts and attributes is no anchor, targets are
    quoted in either way or not at all, and all character references are read. Positions count all anchors with a target.
    """
    found = pages.select(F.col(url).alias("url"), html).mapInArrow(_anchors(suffix), "url string, position int, href string")
    return found.select(F.col("url").alias(url), "position", resolve_url(F.col("url"), F.col("href")).alias("link"))


def report_period(name: Column) -> Column:
    """``yyyy-mon`` from a file name, null if there is none.

    A month followed within five non-digits by a year is tried first, then a year followed within
    five non-letters by a month.
    """
    lower = F.lower(name)

    def pick(pattern: str, year: int, month: int) -> Column:
        return F.when(lower.rlike(pattern), F.concat_ws("-", F.regexp_extract(lower, pattern, year), F.substring(F.regexp_extract(lower, pattern, month), 1, 3)))

    return F.coalesce(pick(MONTH_THEN_YEAR, 2, 1), pick(YEAR_THEN_MONTH, 1, 2))
