"""An HTML tokeniser: tags, texts and comments of a page as they stand, with attributes and character references on demand."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

TEXT, OPEN, CLOSE, COMMENT = range(4)

# Elements whose content is text up to their own end tag, whatever tags it seems to hold; in the last two references count.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?"""
_MARK = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[\s/=]++|{_ATTRIBUTE})*+)>|</?[A-Za-z](?:[^>])*+>?|<[!?/][^>]*+>?""", re.S)
_PAIR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?)?""")
_REFERENCE = re.compile(r"&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+);?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")


def tokens(html: str) -> Iterator[tuple[int, str, str]]:
    """``(kind, name, rest)``: tag names in lower case with their attribute text, texts and comments with theirs in ``rest``.

    Texts keep their character references. Declarations and broken tags give nothing; comments without an
    end reach to the end of the page. The content of raw elements is one text.
    """
    at, n = 0, len(html)
    while at < n:
        found = _MARK.search(html, at)
        if found is None:
            yield TEXT, "", html[at:]
            return
        if found.start() > at:
            yield TEXT, "", html[at:found.start()]
        at = found.end()
        name = found["name"]
        if name is None:
            if found[0].startswith("<!--"):
                yield COMMENT, "", found[0]
            continue
        name = name.lower()
        if found["end"]:
            yield CLOSE, name, ""
            continue
        yield OPEN, name, found["rest"]
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield TEXT, name, html[at:stop]
            at = stop


def _attribute_reference(found: re.Match) -> str:
    """References in attributes: a name without a semicolon counts only if it is whole."""
    reference = found[0]
    if reference[1] == "#" or reference.endswith(";"):
        return unescape(reference)
    return html5.get(reference[1:], reference)


def attributes(rest: str) -> dict[str, str]:
    """Names in lower case to values with references resolved; the first of a repeated name counts, no value is empty."""
    found: dict[str, str] = {}
    for name, double, single, bare in _PAIR.findall(rest):
        value = double or single or bare
        found.setdefault(name.lower(), _REFERENCE.sub(_attribute_reference, value) if "&" in value else value)
    return found


def plain(text: str) -> str:
    """``text`` with its character references resolved."""
    return unescape(text) if "&" in text else text
