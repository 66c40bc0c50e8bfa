"""Bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's shingles. Two sketches
merge into that of both texts' shingles; the hashes are unsigned 63-bit values, so the k-th one also
estimates how many distinct shingles there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 64
SHINGLE = 5
_SPACE = float(2**63)
# Rows per range of ids, and the largest number of ranges: range bounds are constants of the plan.
RANGE_ROWS = 250
MAX_RANGES = 1 << 16


def words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; a null text has none."""
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.array().cast("array<string>"))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; of all words at once where there are fewer; none for no words."""
    def hashed(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]).bitwiseAND(F.lit(2**63 - 1)))
        one = F.array(F.xxhash64(F.array_join(w, " ")).bitwiseAND(F.lit(2**63 - 1)))
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<long>"))
    # The words are bound once, else every use would split the text again.
    return F.flatten(F.transform(F.array(words(text)), hashed))


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in the union; 1 for two empty sets."""
    joint = merge(a, b, k)
    common = F.size(F.array_intersect(joint, F.array_intersect(a, b)))
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(common / F.size(joint))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    kth = F.element_at(a, k).cast("double") / F.lit(_SPACE)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 where ``a`` is empty."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def merged_sketch(sketches: Column, k: int = K) -> Column:
    """Aggregate: the sketch of all sketched parts of a group.

    Parts combine pairwise before the shuffle only as a list, so pass bounded groups, or merge in levels.
    """
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketches)))), 1, k)


def text_of(a: Column) -> Column:
    """A sketch as text: its hashes as 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprints(documents: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, sketch)``, row by row; a null text is empty and has the empty sketch."""
    return documents.select("doc_id", sketch(shingle_hashes(F.col("text"), size), k).alias("sketch"))


def _constant(values: list[int]) -> Column:
    """A constant array of longs (at least one), folded by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above ``value``: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    held = _constant(bounds)
    steps, step = [], 1 << max(0, len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= value, at + s).otherwise(at))


def with_next(documents: DataFrame, carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of ``documents`` with ``next``, a struct of ``carried`` of the row after it by ascending ``doc_id``.

    Null ids come first, equal ids follow each other by text, and the last row's next is the first.
    Ids are cut into ranges at values that occur in the table, so a range's neighbour is known: rows
    at a bound are copied into the range before it. One shuffle, no global order.
    """
    least, rows, nulls = documents.agg(F.min("doc_id"), F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(MAX_RANGES, rows // range_rows))
    cuts = documents.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 4 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []) - {least})
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_range_of(F.col("doc_id"), bounds))
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    opens = F.lit(False) if not bounds else F.coalesce(F.get(_constant(bounds), F.col("range") - 1) == F.col("doc_id"), F.lit(False))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"), F.lit(False).alias("around"))
    before = F.struct((F.col("range") - 1).alias("range"), F.lit(True).alias("copy"), F.lit(False).alias("around"))
    around = F.struct(F.lit(len(bounds)).alias("range"), F.lit(True).alias("copy"), F.lit(True).alias("around"))
    placed = documents.withColumn("range", at).withColumn(
        "place", F.explode(F.array_compact(F.array(own, F.when(opens, before), F.when(first, around)))))
    order = Window.partitionBy("place.range").orderBy("place.around", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    following = placed.withColumn("next", F.lead(F.struct(*carried)).over(order))
    return following.filter("NOT place.copy").drop("range", "place")


def edited_likeness(documents: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_chars, edited, own, edited_sketch, next_sketch)``, one row per row of ``documents``.

    The edited text of a document has its last quarter (rounded down, in code points) replaced by the
    first as many code points, or all, of the next document. A null text is empty; a table of one row
    is its own next. Repeated rows are each other's next. Only ``doc_id`` and ``text`` are read.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = texts.withColumn("own", sketch(shingle_hashes(F.col("text"), size), k))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    pairs = with_next(sketched, ["text", "own"])
    edited = F.concat(F.left("text", F.char_length("text") - quarter), F.left(F.col("next.text"), quarter))
    return pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("next_sketch"),
    ).withColumn("edited_sketch", sketch(shingle_hashes(F.col("edited"), size), k))
