"""Benchmark decontamination with DataFrame functions: windows of words against benchmark windows.

The windows of the benchmark are the hash set. A document is scanned once: every word position gets
the hash of four words of the window that starts there, which the hash join looks up, and a found
position is verified word by word. Only found positions leave the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from serospark.llm.common import lower_ascii

WINDOW = 10
# Benchmark windows up to this number are broadcast (some 300 bytes each); more are joined by key.
BROADCAST_WINDOWS = 500_000

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Words of a text: runs of 0-9, a-z and non-ASCII letters after lower-casing A-Z; null has none."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), _GAPS), ""), F.array().cast("array<string>"))


def _key(n: Column, listed: Column, start: Column) -> Column:
    """Hash of four words of the window: the first, the last and two between."""
    return F.xxhash64(n, *[F.get(listed, (start + at).cast("int")) for at in (F.lit(0), F.floor(n / 3), F.floor(n * 2 / 3), n - 1)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(key, n, grams, items)``: the distinct windows of all items with the items they occur in.

    An item with fewer words than ``window``, but not none, is one window. Item ids are strings here.
    """
    listed = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = listed.select("item_id", n.alias("n"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return (
        grams.select("item_id", "n", F.slice("w", F.col("i"), F.col("n")).alias("grams"))
        .groupBy("n", "grams").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(_key(F.col("n"), F.col("grams"), F.lit(0)).alias("key"), "n", "grams", "items"))


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(row, doc_id, n_words, n_hit, items)``, one row per row of ``documents``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the items (sorted
    strings) with occurring windows. A null or wordless text has no words; null items and items
    without words have no windows, and an empty benchmark hits nothing. Repeated documents are
    separate rows. Only ``doc_id`` and ``text`` are read.
    """
    windows = benchmark_windows(benchmark, window)
    sizes = windows.groupBy("n").count().collect()  # at most ``window`` rows
    lengths = sorted(r["n"] for r in sizes) or [window]
    few = sum(r["count"] for r in sizes) <= broadcast_windows
    listed = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("w"))
    found = listed.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - lengths[0], F.lit(0)))).alias("i"))
    if len(lengths) > 1:
        found = found.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    else:
        found = found.withColumn("n", F.lit(lengths[0]))
    fits = F.col("i") + F.col("n") <= F.size("w")
    found = found.withColumn("key", F.when(fits, _key(F.col("n"), F.col("w"), F.col("i"))))
    lookup = windows.select("key", F.col("n").alias("m"), "grams", "items")
    pairs = found.join(F.broadcast(lookup) if few else lookup, "key", "left")
    same = F.coalesce((F.col("n") == F.col("m")) & (F.slice("w", F.col("i") + 1, F.col("n")) == F.col("grams")), F.lit(False))
    kept = pairs.select(
        "row", "doc_id", F.size("w").alias("n_words"), "i",
        F.when(same, F.struct("i", (F.col("i") + F.col("n")).alias("stop"))).alias("span"), F.when(same, F.col("items")).alias("items"),
    ).filter("span IS NOT NULL OR i = 0")
    spans = F.sort_array(F.collect_set("span"))
    grouped = kept.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.select("row", "doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), "items")


def covered(spans: Column) -> Column:
    """How many positions lie in any of the sorted half-open ``(i, stop)`` spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(state: Column, s: Column) -> Column:
        end = F.greatest(state["end"], s["stop"])
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(F.least(s["i"], end), state["end"])).alias("n"))
    return F.aggregate(spans, start, step, lambda state: state["n"])


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.0) -> DataFrame:
    """The rows of ``documents``, all columns, without texts whose share of hit words is over ``max_share``.

    Texts decide, so rows with equal ids are judged apart; rows with null ids or texts are kept
    unless their text is hit.
    """
    texts = documents.select("doc_id", "text")
    hits = scan(texts.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text"), benchmark, window)
    bad = hits.filter((F.col("n_hit") > 0) & (F.col("n_hit") > F.lit(max_share) * F.col("n_words"))).select(
        F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_h")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_h"]), "left_anti")
