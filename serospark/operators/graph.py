"""Iterative operators on the assay graph. Every round ends in a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serospark.functions import titres as T
from serospark.operators.titres import involved_names, numeric_edges
from serospark.plans.skew import LIMIT, hot_keys, keep_both_ends, lookup, lookup_as, lookup_ends, ordered_ids, sliced_join
from serospark.session import cut_lineage, drop_table

# Folders that the ends of cells are dealt to, so that a round of peeling opens only those of the keys it removes.
BUCKETS = 32
# Keys removed in one round that are sent to the ends of cells; with more of them both are shuffled.
SENT_KEYS = 100_000
# Nodes that a task joins before it hands their trees on.
HELD_NODES = 1 << 20


def prune_sparse(
    cells: DataFrame,
    row: str = "virus_1",
    column: str = "virus_2",
    titre: str = "titre",
    min_valid: int = 4,
    limit: int = LIMIT,
    buckets: int = BUCKETS,
    sent_keys: int = SENT_KEYS,
) -> DataFrame:
    """Drop rows and columns with fewer than ``min_valid`` numeric cells until nothing changes.

    Every key (a row or a column) has a count. Both counts of a round are taken on the same state: the keys below
    ``min_valid`` go, and a decrement is sent along each of their cells to the other end. A key goes once, so over all
    rounds a numeric cell sends at most two decrements, however many rounds a chain of removals takes. The ends of
    cells are written once, in folders by hash of the key; a round reads the folders of the keys it removes. Up to ``sent_keys``
    removed keys are broadcast, so the ends are shuffled only in rounds that remove more.
    """
    if min_valid <= 0:
        return cells
    key, bucket = ["is_row", "key"], F.pmod(F.xxhash64("is_row", "key"), F.lit(buckets)).cast("int")
    stored = cut_lineage(cells, "cells")
    numeric = stored.filter(T.titre_kind(F.col(titre)) == T.NUMBER).select(F.col(row).alias("r"), F.col(column).alias("c"))
    both = F.array(*[F.struct(F.lit(flag).alias("is_row"), F.col(own).alias("key"), F.col(other).alias("other")) for flag, own, other in ((True, "r", "c"), (False, "c", "r"))])
    ends = cut_lineage(numeric.select(F.inline(both)).withColumn("bucket", bucket), "ends", "bucket")
    counts = cut_lineage(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("bucket", bucket), "counts")
    hot = hot_keys(counts, key, limit)
    state, first = counts, counts
    while touched := {r["bucket"]: r["count"] for r in state.filter(F.col("_n") < min_valid).groupBy("bucket").count().collect()}:  # at most ``buckets`` rows
        removed = state.filter(F.col("_n") < min_valid).select(*key)
        own = ends.filter(F.col("bucket").isin(list(touched)))
        sent = sliced_join(own, removed, key, "inner", None if sum(touched.values()) <= sent_keys else hot)
        lost = sent.select((~F.col("is_row")).alias("is_row"), F.col("other").alias("key")).groupBy(*key).agg(F.count(F.lit(1)).alias("_lost"))
        left = state.filter(F.col("_n") >= min_valid).join(lost, key, "left")
        following = cut_lineage(left.select(*key, (F.col("_n") - F.coalesce("_lost", F.lit(0))).alias("_n"), "bucket"), "counts")
        if state is not first:
            drop_table(state)
        state = following
    drop_table(ends)
    rows, columns = (state.filter(F.col("is_row") == flag).select(F.col("key").alias(name)) for flag, name in ((True, row), (False, column)))
    left = lookup(stored, rows, row, "inner", limit)
    return lookup(left, columns, column, "inner", limit, stored).select(*cells.columns)


def _forest(held_nodes: int = HELD_NODES):
    """Edges ``(u, v)`` to a star for every component within the task, in portions of so many nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            above = parent.setdefault(node, node)
            while above != node:
                parent[node] = above = parent[above]
                node, above = above, parent[above]
            return node

        def stars() -> pa.RecordBatch:
            pairs = np.array([(n, root(n)) for n in parent], np.int64).reshape(-1, 2)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = root(u), root(v)
                if one != two:
                    parent[max(one, two)] = min(one, two)
            if len(parent) > held_nodes:
                yield stars()
                parent.clear()
        if parent:
            yield stars()
    return run


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller number, contracted within tasks first."""
    joined = edges.select("u", "v").mapInArrow(_forest(), "u long, v long")
    return joined.distinct()


def _minima(state: DataFrame) -> DataFrame:
    return state.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))


def _star_round(state: DataFrame, limit: int) -> DataFrame:
    """One large-star and one small-star step on ids ``(u, v)`` with ``u > v``."""
    both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _minima(both)
    joined = sliced_join(both, lowest.select("u", F.least("u", "_m").alias("_m")), ["u"], "inner", hot_keys(lowest, ["u"], limit))
    large = cut_lineage(joined.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct(), "large")
    lowest = _minima(large)
    linked = sliced_join(large, lowest.select("u", "_m"), ["u"], "inner", hot_keys(lowest, ["u"], limit)).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    following = cut_lineage(_oriented(linked.union(lowest.select("u", F.col("_m").alias("v")))), "edges")
    drop_table(large)
    return following


def _rooted(state: DataFrame) -> bool:
    """Whether every edge leads to a root and every node has one: nothing is left to join."""
    ends = state.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    again = state.select("v").distinct().join(ends.select(F.col("u").alias("v"), "n"), "v", "left_semi").isEmpty()
    return again and ends.filter("n > 1").isEmpty()


def stars(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(u, v)``: every number of the edges ``(u, v)`` that is not the smallest of its component, with the one that is."""
    state = cut_lineage(_oriented(edges), "edges")
    while not _rooted(state):
        following = _star_round(state, limit)
        drop_table(state)
        state = following
    return state


def connected_components(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(name, component)`` for undirected edges ``(a, b)``; the component is its smallest name.

    Names are numbered once in their own order, so rounds work on numbers and a smallest number is a
    smallest name. Every task joins its own edges first and hands on a star for each component it sees, at most an edge for
    each of its nodes; only these go into rounds, and the edges of each round are joined within
    tasks again. Rounds alternate the large-star and small-star steps of the published min-label
    method, which needs few of them on long chains too. Minima are combined on the map side and
    joined back in slices, so a hub with many edges is spread over tasks. The loop ends when every edge leads to a root.
    """
    edges = cut_lineage(edges.select("a", "b"), "edges")
    numbers = ordered_ids(involved_names(edges, "a", "b"))
    state = stars(lookup_ends(edges, numbers, "name", {"id": ("u", "v")}, limit=limit), limit)
    roots = numbers.join(state.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    named = lookup_as(roots.filter("root IS NOT NULL"), numbers, "root", "id", {"name": "component"}, limit=limit, counted=state.select(F.col("v").alias("root")))
    return named.select("name", "component").union(roots.filter("root IS NULL").select("name", F.col("name").alias("component")))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n_names"))


def largest_component(
    cells: DataFrame, row: str = "virus_1", column: str = "virus_2", titre: str = "titre", limit: int = LIMIT
) -> DataFrame:
    """Cells whose row and column lie in the component with the most names (ties: smallest id)."""
    cells = cut_lineage(cells, "cells")
    components = cut_lineage(connected_components(numeric_edges(cells, row, column, titre), limit))
    best = component_sizes(components).orderBy(F.desc("n_names"), "component").limit(1).select("component")
    names = components.join(F.broadcast(best), "component", "left_semi").select("name")
    return keep_both_ends(cells, names, row, column, limit)
