"""Personal data: exact forms as seeds, and bootstrapped contextual extraction of identifiers beyond them.

1. One pass over the texts marks the base forms (email, ip, card, phone), other identifier-like words,
   runs of digit groups and spelt-out addresses, each with the lexical patterns around the whole of it:
   the two words before, the two after, one of each.
2. Patterns and instances are a bipartite graph. Base instances believe in their kind; in rounds, a
   pattern's score for a kind is the smoothed share of belief among its instances, and an unlabelled
   instance's belief is that of its best patterns.
3. Identifiers under a pattern with a high score are spans of its kind. Base spans always stay. Of a
   run or address and the words in it the former goes first.

Only marks, which are few bytes per document, are shuffled; texts are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from serospark.llm.common import salted_lookup
from serospark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")


class Bootstrap(NamedTuple):
    """``support``: different instances a pattern needs; ``smoothing`` is added to their number."""

    rounds: int = 3
    support: int = 4
    smoothing: float = 1.0
    accept: float = 0.8
    shortest: int = 6
    longest: int = 64


# The fixed forms of the task, anchored so that no start inside a run is tried again: a later start in
# the same run meets the same continuation.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_DIGIT = re.compile(r"[0-9]")
# Digit groups with a separator between neighbours on one line; possessive, so that a long run is read once.
_GAP = r"[\x20\t\xa0\u2009\u202f]"
_GROUPED = re.compile(rf"(?<![0-9])\+?\(?(?<![0-9])[0-9]++(?:(?:{_GAP}?[-/\u2010-\u2013]{_GAP}?|\.|{_GAP}?\(|\){_GAP}?[-./]?{_GAP}?|{_GAP}{{1,2}}\(?)[0-9]++)+")
# What follows the name in ``name at host dot com``, ``name (at) host.com`` and the like.
_SPELT = re.compile(
    r"(?:[\x20\t]+at[\x20\t]+[a-z0-9-]{1,63}(?:[\x20\t]+dot[\x20\t]+|[\x20\t]?[(\[{]dot[)\]}][\x20\t]?)[a-z0-9-]{1,63}"
    r"|[\x20\t]?[(\[{]at[)\]}][\x20\t]?[a-z0-9-]{1,63}(?:[\x20\t]+dot[\x20\t]+|[\x20\t]?[(\[{]dot[)\]}][\x20\t]?|\.)[a-z0-9-]{1,63})"
    r"(?:(?:[\x20\t]+dot[\x20\t]+|[\x20\t]?[(\[{]dot[)\]}][\x20\t]?|\.)[a-z0-9-]{1,63})*", re.IGNORECASE | re.ASCII)
_AT = re.compile(r"[\x20\t(\[{]at[\x20\t)\]}]", re.IGNORECASE)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(_DIGIT.findall(found))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        match = _PHONE.match(text, at)
        if match and 9 <= len(_digits(match[0])) <= 15:
            yield match.span()
        at = text.find("+", match.end() if match else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base forms, sorted; per kind leftmost without overlap."""
    found = [(*span, 0) for span in _emails(text)] if "@" in text else []
    if "+" in text:
        found += [(*span, 3) for span in _phones(text)]
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
                found.append((*match.span(), 1))
        for match in _CARD.finditer(text):
            if match.end() - match.start() >= 12 and 12 <= len(digits := _digits(match[0])) <= 19 and _luhn(digits):
                found.append((*match.span(), 2))
    return sorted(found, key=lambda s: (s[0], s[2]))


def _wholes(text: str, base: list[tuple[int, int, int]], how: Bootstrap) -> list[tuple[int, int]]:
    """Runs of digit groups and spelt-out addresses of fitting length between base spans, sorted, without overlap.

    A run is as long as possible, to the ends of the words it begins and ends in, with a plus or bracket before it.
    """
    found, low = [], 0
    spelt = _AT.search(text) is not None
    for start, stop, _ in [*sorted(base), (len(text), len(text), 0)]:
        if start > low:
            for match in _GROUPED.finditer(text, low, start):
                s, e = match.span()
                if e - s <= how.longest and len(_digits(match[0])) >= how.shortest:
                    while s > low and text[s].isdigit() and text[s - 1].isalnum() and e - s <= how.longest:
                        s -= 1
                    while e < start and text[e].isalnum() and e - s <= how.longest:
                        e += 1
                    found.append((s, e))
            for match in _SPELT.finditer(text, low, start) if spelt else ():
                s, e = match.span()
                while s > low and text[s - 1] in _LOCAL and e - s <= how.longest:
                    s -= 1
                if s < match.start():
                    found.append((s, e))
        low = max(low, stop)
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            s, last = out.pop()
            e = max(e, last)
        out.append((s, e))
    return [(s, e) for s, e in out if how.shortest <= e - s <= how.longest]


def _identifiers(text: str, base: list[tuple[int, int, int]], how: Bootstrap) -> Iterator[tuple[int, int, int, bool]]:
    """``(start, end, group, whole)`` of identifiers of fitting length that touch no base span.

    They are the ``_wholes`` and the words with a digit or ``@``, without marks at their ends. A word that
    touches one of the former has its start as group and isn't whole; all others are groups of their own.
    """
    wholes = _wholes(text, base, how)
    yield from ((s, e, s, True) for s, e in wholes)
    taken, hint, done = sorted((s, e) for s, e, _ in base), _HINT.search(text), 0
    place = near = 0
    while hint:
        start = hint.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end = _REST.match(text, hint.start()).end()
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while place < len(taken) and taken[place][1] <= start:
            place += 1
        while near < len(wholes) and wholes[near][1] <= start:
            near += 1
        if how.shortest <= end - start <= how.longest and not any(s < end and start < e for s, e in taken[place:place + 8]):
            inside = near < len(wholes) and wholes[near][0] < end
            if not inside:
                yield start, end, start, True
            elif (start, end) != wholes[near]:
                yield start, end, wholes[near][0], False
        hint = _HINT.search(text, done)


def _word(text: str) -> str:
    return _DIGIT.sub("0", text.lower())[:40]


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: up to 100 characters on each side are enough for two words."""
    left = [_word(w) for w in text[max(0, start - 100):start].split()[-2:]]
    right = [_word(w) for w in text[end:end + 100].split()[:3]]
    if end < len(text) and not text[end].isspace() and right:
        right = right[1:]  # the rest of the word itself
    found = []
    if len(left) == 2:
        found.append(f"{left[0]} {left[1]} _")
    if len(right) >= 2:
        found.append(f"_ {right[0]} {right[1]}")
    if left and right:
        found.append(f"{left[-1]} _ {right[0]}")
    return found


_SPAN = "struct<start:int,stop:int,kind:int>"
_MARK = "struct<start:int,stop:int,kind:int,instance:string,patterns:array<string>,group:int,whole:boolean>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32())])
_MARK_TYPE = pa.struct([*_SPAN_TYPE, ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("group", pa.int32()), ("whole", pa.bool_())])


def _mark(columns: int, how: Bootstrap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, marks = [], []
            for value in batch.column(columns):
                text = value.as_py() or ""
                base = base_spans(text)
                others = [(s, e, None, group, whole) for s, e, group, whole in _identifiers(text, base, how)]
                bases.append([{"start": s, "stop": e, "kind": k} for s, e, k in base])
                marks.append([
                    {"start": s, "stop": e, "kind": k, "instance": text[s:e].lower()[:200], "patterns": _patterns(text, s, e), "group": group, "whole": whole}
                    for s, e, k, group, whole in [*((s, e, k, s, True) for s, e, k in base), *others]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(bases, pa.list_(_SPAN_TYPE)), pa.array(marks, pa.list_(_MARK_TYPE))],
                names=[*batch.schema.names[:columns], "base", "marks"])
    return run


def mark_texts(documents: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``(row, doc_id, hash, base, marks)``: a written table with the marks of every row of ``documents``."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    kind = dict(documents.dtypes)["doc_id"]
    return cut_lineage(rows.mapInArrow(_mark(3, how), f"row long, doc_id {kind}, hash long, base array<{_SPAN}>, marks array<{_MARK}>"), "marks")


def score_patterns(marks: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``(pattern, kind, score)`` of the accepted patterns; the best kind of each."""
    listed = marks.select(F.explode("marks").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    seeds = listed.filter("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind"))
    pairs = listed.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))
    sizes = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("seeded"))
    # A pattern with fewer instances can never be accepted, so it carries no belief either.
    graph = cut_lineage(salted_lookup(pairs.select("pattern", "instance"), sizes.filter(F.col("n") >= how.support).select("pattern", "n"),
                                      "pattern", ["instance"]).filter("n IS NOT NULL"), "graph")
    beliefs = cut_lineage(seeds.select("instance", F.array(F.struct("kind", F.lit(1.0).alias("belief"))).alias("believed")), "beliefs")
    known = beliefs
    scores = None
    for _ in range(how.rounds):
        felt = salted_lookup(graph, beliefs, "instance", ["pattern"]).select("pattern", "n", F.inline("believed"))
        summed = felt.groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.max("n").alias("n"))
        rated = summed.select("pattern", F.struct((F.col("belief") / (F.col("n") + how.smoothing)).alias("score"), "kind").alias("rated"))
        scores = cut_lineage(rated.groupBy("pattern").agg(F.max("rated").alias("best")), "scores")
        strong = scores.filter(F.col("best.score") >= how.accept / 2)
        told = salted_lookup(graph.select("pattern", "instance"), strong, "pattern", ["instance"]).filter("best IS NOT NULL")
        guessed = told.groupBy("instance").agg(F.max("best").alias("best"))
        guessed = guessed.join(known.select("instance"), "instance", "left_anti").select(
            "instance", F.array(F.struct(F.col("best.kind").alias("kind"), F.col("best.score").alias("belief"))).alias("believed"))
        beliefs = known.union(guessed)
    if scores is None:
        return marks.sparkSession.createDataFrame([], "pattern string, kind int, score double")
    return scores.filter(F.col("best.score") >= how.accept).select("pattern", F.col("best.kind").alias("kind"), F.col("best.score").alias("score"))


def discovered(marks: DataFrame, accepted: DataFrame) -> DataFrame:
    """``(row, found)``: spans of unlabelled identifiers under an accepted pattern, for rows that have some.

    Of a group that was found as a whole only that span is listed.
    """
    open_marks = marks.select("row", F.explode(F.filter("marks", lambda m: m["kind"].isNull())).alias("m"))
    places = open_marks.select("row", "m.start", "m.stop", "m.group", "m.whole", F.explode("m.patterns").alias("pattern"))
    told = salted_lookup(places, accepted.select("pattern", F.struct("score", "kind").alias("best")), "pattern", ["row", "start"]).filter("best IS NOT NULL")
    best = told.groupBy("row", "start", "stop", "group", "whole").agg(F.max("best").alias("best"))
    span = F.struct("start", "stop", F.col("best.kind").alias("kind"))
    grouped = best.groupBy("row", "group").agg(
        F.collect_list(F.when(F.col("whole"), span)).alias("whole"), F.collect_list(F.when(~F.col("whole"), span)).alias("parts"))
    chosen = F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("parts"))
    return grouped.groupBy("row").agg(F.flatten(F.collect_list(chosen)).alias("found"))


def find(documents: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``(row, doc_id, hash, base, spans)``, one row per row of ``documents``.

    ``base`` and ``spans`` are arrays of ``(start, stop, kind)`` in code points, by start and then kind
    number (see ``KINDS``); ``spans`` are the base ones and those the method adds. A null text is
    empty; repeated rows are marked alike; a null id is kept. Without seeds nothing is added, and an
    empty table has no rows. Only ``doc_id`` and ``text`` are read.
    """
    marks = mark_texts(documents, how)
    added = discovered(marks, score_patterns(marks, how))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    joined = marks.select("row", "doc_id", "hash", "base").join(added, "row", "left")
    spans = F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found"), order))
    return joined.select("row", "doc_id", "hash", "base", spans.alias("spans"))


def listed_spans(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by the upper-case name of its kind; overlapping spans become one."""
    out, at = [], 0
    for start, stop, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``documents``, all columns, with masked texts and, where the column exists, their new ``n_chars``."""
    found = find(documents, how).filter(F.size("spans") > 0)
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")).agg(F.max("spans").alias("_spans"))
    same = documents["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == spans["_h"])
    columns, place = documents.columns, documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, own in zip(batch.column(place), batch.column(len(columns)).to_pylist()):
                text = value.as_py()
                texts.append(masked(text, [(s["start"], s["stop"], s["kind"]) for s in own]) if own else text)
            made = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(made, names=columns)

    clean = documents.join(spans, same, "left").select(*columns, "_spans").mapInArrow(run, documents.schema)
    return clean.withColumn("n_chars", F.char_length("text").cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in columns else clean
