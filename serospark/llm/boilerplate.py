"""Main texts of pages by the suffix array of each host.

The token streams of a host's pages stand one after another: the words of all blocks outside articles, with a
mark at every end of a stretch. The array is kept in order of host and first ``LENGTH`` tokens only,
which is as deep as it is read: suffixes with that prefix in common are neighbours, and where two of them
come from different pages, a long substring repeats. It is cut by prefixes, so no host stands in one task. Blocks
that such substrings cover are boilerplate, unique runs stay.

Markup goes before repetition. What stands in an article is never boilerplate, however often it is copied, and
isn't in the streams; what stands in menus, footers, adverts and the like never is text, though its words count as
repeats. Blocks of neither kind are judged by the array. A page without an article whose blocks
are covered all together is a copy of another page and keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from serospark.functions.markup import CLOSE, OPEN, TEXT, VOID, attributes, plain, tokens
from serospark.llm.common import counted_lookup
from serospark.llm.urlfilter import host_of

# Tokens of the shortest substring that counts, and the share of a block's words that has to be covered.
LENGTH, COVERED = 5, 0.5
CHROME, NEUTRAL, ARTICLE = range(3)

_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template tfoot th thead title tr ul textarea script style iframe object svg canvas audio video".split())
_TAGS = frozenset(
    "nav footer aside form dialog menu button select head script style noscript template iframe object svg canvas audio video textarea title "
    "search xmp noembed noframes datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Parts of class names and ids that mark what isn't the article; the parts of a name stand between other characters than letters.
_PARTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byads comment comments commentlist consent cookie "
    "cookies copyright cta disqus footer gdpr header legal login masthead menu menus modal nav navbar navigation navi newsletter notice notices "
    "notification overlay pager pagination popup privacy promo promotion related replies reply respond search share sharing sidebar sidebars signup "
    "skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
_OWN = frozenset("article main".split())
_NAMED = frozenset("articlebody article entry post story".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _named(marks: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(marks)} | set(marks.lower().split())


def _zone(name: str, rest: str, zone: int, by: str) -> int:
    """The zone inside an element that stands in ``zone``, which the element ``by`` opened."""
    if name in _OWN and (zone != CHROME or by in ("form", "header")):
        if zone == ARTICLE and name == "article" and rest and _named(attributes(rest).get("class", "")) & {"comment", "reply", "comments"}:
            return CHROME
        return ARTICLE
    if zone == CHROME or name in _TAGS or (name == "header" and zone != ARTICLE):
        return CHROME
    lower = rest.lower()
    if "class" in lower or "id" in lower or "role" in lower:
        marks = attributes(rest)
        role = marks.get("role", "").strip().lower()
        if role in _ROLES:
            return CHROME
        if role in _OWN:
            return ARTICLE
        if name not in ("html", "body", "h1"):
            words = _named(marks.get("class", "") + " " + marks.get("id", ""))
            if words & _PARTS:
                return CHROME
            if words & _NAMED:
                return ARTICLE
    return zone


def blocks(html: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of the blocks of a page in order, white space single."""
    found, held = [], []
    zone, by = NEUTRAL, ""
    stack: list[tuple[str, int, str]] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            found.append((zone, text))
        held.clear()

    for kind, name, rest in tokens(html):
        if kind == TEXT:
            if not name:
                held.append(plain(rest))
        elif kind == OPEN:
            if name in VOID:
                if name in _BLOCKS:
                    held.append("\n")
                continue
            block = name in _BLOCKS
            if block:
                if stack and stack[-1][0] == "p":  # a paragraph ends where another block begins
                    flush()
                    _, zone, by = stack.pop()
                if name == "li" and any(t == "li" for t, _, _ in stack):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in ("ul", "ol", "menu"):
                            break
                        if stack[depth][0] == "li":
                            flush()
                            _, zone, by = stack[depth]
                            del stack[depth:]
                            break
                if name == "body":
                    flush()
                    stack, zone, by = [], NEUTRAL, ""
            inner = _zone(name, rest, zone, by) if block or rest else zone
            if block or inner != zone:
                flush()
                stack.append((name, zone, by))
                if inner != zone:
                    zone, by = inner, name
        elif kind == CLOSE:
            if name in _BLOCKS:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    flush()
                    _, zone, by = stack[depth]
                    del stack[depth:]
                    break
    flush()
    return found


def prefixes(page: list[tuple[int, str]], host: str, length: int = LENGTH) -> list[tuple[np.ndarray, int, int]]:
    """Per stretch of blocks outside articles: the hashes of the first ``length`` tokens of its suffixes, and its blocks ``[a, b)``.

    A stretch has a mark before its first and after its last word; one with fewer than ``length`` tokens is one suffix.
    """
    found, at, digest = [], 0, xxhash.xxh64_intdigest
    while at < len(page):
        if page[at][0] == ARTICLE:
            at += 1
            continue
        end = at
        while end < len(page) and page[end][0] != ARTICLE:
            end += 1
        words = ["\x02", *(w for _, text in page[at:end] for w in text.split(" ")), "\x03"]
        last = max(1, len(words) - length + 1)
        made = (digest(" ".join([host, *words[i:i + length]]).encode("utf-8", "surrogatepass")) for i in range(last))
        found.append((np.fromiter(made, np.uint64, last).view(np.int64), at, end))
        at = end
    return found


def _suffixes(only_neutral: bool, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns)):
                read = blocks(html or "")
                if only_neutral and all(zone != NEUTRAL for zone, _ in read):
                    continue
                own = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _, _ in prefixes(read, host, length))]))
                keys.append(own)
                owners.append(np.full(len(own), page, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "page"])
    return run


def main_text(page: list[tuple[int, str]], host: str, repeated: np.ndarray, length: int = LENGTH, covered: float = COVERED) -> tuple[str, int]:
    """``(text, words covered by repeats)`` of a page's blocks, given the repeated prefixes among its own."""
    keep = [zone == ARTICLE for zone, _ in page]
    n_covered = 0
    for keys, begin, end in prefixes(page, host, length) if len(repeated) else ():
        marks = np.zeros(len(keys) + length, np.int64)
        hits = np.flatnonzero(np.isin(keys, repeated))
        np.add.at(marks, hits, 1)
        np.add.at(marks, hits + length, -1)
        over = np.cumsum(marks) > 0
        at = 1
        for i in range(begin, end):
            size = page[i][1].count(" ") + 1
            own = int(over[at:at + size].sum())
            n_covered += own
            keep[i] = page[i][0] == NEUTRAL and own < covered * size
            at += size
    if not len(repeated):
        keep = [zone != CHROME for zone, _ in page]
    if not any(keep):
        keep = [zone == NEUTRAL for zone, _ in page]
    return " ".join(text for (_, text), k in zip(page, keep) if k), n_covered


def _texts(columns: int, length: int, covered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for host, html, repeated in zip(*(c.to_pylist() for c in batch.columns[columns:])):
                text, n = main_text(blocks(html or ""), host, np.array(repeated or [], np.int64), length, covered)
                texts.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                names=[*batch.schema.names[:columns], "text", "n_repeated"])
    return run


def extract(pages: DataFrame, length: int = LENGTH, covered: float = COVERED) -> DataFrame:
    """``(page_id, url, text, n_repeated)``, a row per row of ``pages``: the main text and the words outside articles that repeat.

    Pages of a host count as different if their html differs, so exact copies don't make each other
    boilerplate. A null page has the empty text, a null url or one without ``://`` the empty host. Rows and ids may repeat;
    an empty table has no rows; other columns are not read. White space is what Unicode takes for it.
    """
    kinds = dict(pages.dtypes)
    hosted = pages.select("page_id", "url", host_of("url").alias("host"), "html")
    rows = hosted.withColumn("page", F.xxhash64("host", "html"))
    read = rows.select("page", "host", "html")
    kind = "key long, page long"
    array = read.mapInArrow(_suffixes(False, length), kind)
    repeated = array.groupBy("key").agg(F.min("page").alias("least"), F.max("page").alias("most")).filter("least <> most").select("key")
    asked = read.mapInArrow(_suffixes(True, length), kind)
    lists = counted_lookup(asked, repeated.withColumn("hit", F.lit(True)), "key").filter("hit").groupBy("page").agg(F.collect_set("key").alias("keys"))
    made = counted_lookup(rows, lists, "page").select("page_id", "url", "host", "html", "keys")
    return made.mapInArrow(_texts(2, length, covered), f"page_id {kinds['page_id']}, url string, text string, n_repeated long")
