"""Antigenic maps: places for antigens and sera whose distances match the assay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serospark.functions.hashing import unit_hash
from serospark.models.sums import HeldSums, list_column, stacked, summed
from serospark.operators.titres import column_basis_distance
from serospark.plans.skew import LIMIT, sliced_join, stored_hot_keys
from serospark.session import cut_lineage, drop_table

# Nodes whose forces a task adds up before it hands them on.
HELD_NODES = 50_000
# Lengths that a round tries along its direction; the first is none.
STEPS = (0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 10.0)


def _axes(dims: int) -> list[str]:
    return [f"x{i}" for i in range(dims)]


def _hot_ends(edges: DataFrame, limit: int) -> list[DataFrame]:
    return [stored_hot_keys(edges, end, limit) for end in "ab"]


def _with_ends(edges: DataFrame, places: DataFrame, hot: list[DataFrame]) -> DataFrame:
    """Edges with the places of both ends: an array with all restarts, so an edge stays one row."""
    out = sliced_join(edges, places.select(F.col("node").alias("a"), F.col("p").alias("_pa")), ["a"], "inner", hot[0])
    return sliced_join(out, places.select(F.col("node").alias("b"), F.col("p").alias("_pb")), ["b"], "inner", hot[1])


def _residuals(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps from ``a`` to ``b``, map distances and residuals, per edge and restart.

    A bound only counts while the map is too close.
    """
    ends = [np.stack(batch.column(c).to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1, dims) for c in ("_pa", "_pb")]
    dist, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dist", "censored"))
    step = ends[1] - ends[0]
    d = np.sqrt((step * step).sum(axis=2))
    gap = d - dist[:, None]
    return step, d, np.where(bound[:, None].astype(bool) & (gap > 0), 0.0, gap)


def stress(edges: DataFrame, places: DataFrame, dims: int = 2, limit: int = LIMIT) -> DataFrame:
    """``(restart, stress)``: summed squared residuals of ``places (node, p)``."""
    hot = _hot_ends(edges, limit)

    def squares(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, gap = _residuals(batch, dims)
                total = (gap * gap).sum(axis=0)
                yield pa.RecordBatch.from_pydict({"restart": pa.array(np.arange(len(total)), pa.int32()), "s": pa.array(total)})

    parts = _with_ends(edges, places, hot).select("dist", "censored", "_pa", "_pb").mapInArrow(squares, "restart int, s double")
    return parts.groupBy("restart").agg(F.sum("s").alias("stress"))


def _forces(edges: DataFrame, places: DataFrame, dims: int, size: int, hot: list[DataFrame]) -> DataFrame:
    """``(name, sums)``: summed residual forces on every node, half the negative gradient of the stress."""
    def run(batches):
        held = None
        for batch in batches:
            held = held or HeldSums(batch.column(0).type, HELD_NODES)
            if batch.num_rows:
                step, d, gap = _residuals(batch, dims)
                pull = (np.divide(gap, d, out=np.zeros_like(d), where=d > 1e-12)[:, :, None] * step).reshape(len(d), size)
                yield from held.add(batch.column(0), pull)
                yield from held.add(batch.column(1), -pull)
        if held:
            yield from held.rest()

    parts = _with_ends(edges, places, hot).select("a", "b", "dist", "censored", "_pa", "_pb").mapInArrow(run, "name string, sums array<double>")
    return summed(parts, size)


def _line(edges: DataFrame, places: DataFrame, dims: int, restarts: int, hot: list[DataFrame]) -> np.ndarray:
    """``[step, restart]``: the stress of ``places (node, p)``, where ``p`` ends with a direction of its own length, after each of ``STEPS``."""
    size = restarts * dims

    def run(batches):
        total = np.zeros((len(STEPS), restarts))
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [stacked(batch.column(c)) for c in ("_pa", "_pb")]
            apart, turned = ((ends[1][:, cut] - ends[0][:, cut]).reshape(-1, restarts, dims) for cut in (slice(size), slice(size, None)))
            dist, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dist", "censored"))
            for i, step in enumerate(STEPS):
                gap = np.sqrt(((apart + step * turned) ** 2).sum(axis=2)) - dist[:, None]
                total[i] += np.where(bound[:, None].astype(bool) & (gap > 0), 0.0, gap * gap).sum(axis=0)
        yield pa.RecordBatch.from_arrays([list_column(total.reshape(1, -1))], names=["s"])

    parts = _with_ends(edges, places, hot).select("dist", "censored", "_pa", "_pb").mapInArrow(run, "s array<double>")
    sums = parts.agg(*[F.sum(F.get("s", F.lit(i))) for i in range(len(STEPS) * restarts)]).first()
    return np.array([v or 0.0 for v in sums]).reshape(len(STEPS), restarts)


def embed(
    edges: DataFrame,
    dims: int = 2,
    restarts: int = 1,
    rounds: int = 50,
    seed: int = 42,
    limit: int = LIMIT,
    tolerance: float = 1e-4,
) -> DataFrame:
    """``(node, p)`` minimising the stress of ``edges`` ``(a, b, dist, censored)``; ``p`` holds ``dims`` numbers per restart.

    Conjugate gradients with a line search, all restarts in the same passes. A node's mean residual force over twice its
    degree is the step to the minimum of a quadratic bound on the stress; a round goes along that step, turned by the last
    direction, by the best of a few lengths, none among them, so no round makes the stress worse. A restart whose
    direction gains nothing goes on from the plain step. A round reads the edges twice: for the forces (tasks add up their own
    nodes first, so a serum measured against everything is a few partial sums) and for the stress of all
    lengths. Rounds end when no restart gains ``tolerance`` of its stress. Every round's places are written out,
    and those before deleted.
    """
    edges = cut_lineage(edges.select("a", "b", F.col("dist").cast("double").alias("dist"), "censored"), "edges")
    hot = _hot_ends(edges, limit)
    span = edges.select(F.max("dist")).first()[0] or 1.0
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    size = restarts * dims
    start = [((unit_hash(F.col("node"), F.lit(r), F.lit(i), seed=seed) - 0.5) * span) for r in range(restarts) for i in range(dims)]
    nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    none = F.array_repeat(F.lit(0.0), size)
    stored = cut_lineage(nodes.select("node", "degree", F.array(*start).alias("p"), none.alias("d"), none.alias("old")), "places")
    places, plain = stored, [True] * restarts
    each = lambda values: F.array(*[F.lit(float(values[i // dims])) for i in range(size)])
    for _ in range(rounds):
        forces = _forces(edges, places, dims, size, hot).withColumnsRenamed({"name": "node", "sums": "f"})
        following = cut_lineage(places.join(forces, "node", "left").withColumn("f", F.coalesce("f", none)), "places")
        drop_table(stored)
        stored = following
        # Turn by the change of the forces against the last ones, each weighed by the node's degree.
        change = [F.sum(F.get("f", F.lit(i)) * (F.get("f", F.lit(i)) - F.get("old", F.lit(i))) / F.col("degree")) for i in range(size)]
        before = [F.sum(F.get("old", F.lit(i)) * F.get("old", F.lit(i)) / F.col("degree")) for i in range(size)]
        sums = np.array([v or 0.0 for v in stored.agg(*change, *before).first()]).reshape(2, restarts, dims).sum(axis=2)
        turn = np.where(np.array(plain) | (sums[1] <= 0), 0.0, np.maximum(0.0, sums[0] / np.where(sums[1] > 0, sums[1], 1.0)))
        turned = stored.withColumn("d", F.zip_with(F.transform("f", lambda f: f / (2 * F.col("degree"))), F.zip_with("d", each(turn), lambda d, t: d * t), lambda z, d: z + d))
        line = _line(edges, turned.select("node", F.concat("p", "d").alias("p")), dims, restarts, hot)
        best = line.argmin(axis=0)
        steps = [STEPS[i] for i in best]
        plain = [step == 0 for step in steps]
        places = turned.select("node", "degree", F.zip_with("p", F.zip_with("d", each(steps), lambda d, s: d * s), lambda p, d: p + d).alias("p"), "d", F.col("f").alias("old"))
        now = line.min(axis=0)
        if (line[0] - now <= tolerance * line[0]).all() and not (np.array(plain) & (turn > 0)).any():
            break
    return places.select("node", "p")


def best_restart(edges: DataFrame, places: DataFrame, dims: int = 2) -> DataFrame:
    """``(node, x0, ..., stress)``: the places of the restart with the least stress."""
    best = stress(edges, places, dims).orderBy("stress", "restart").limit(1)
    own = [F.get("p", F.col("restart") * dims + i).alias(x) for i, x in enumerate(_axes(dims))]
    return places.join(F.broadcast(best)).select("node", *own, "stress")


def fit_map(titres: DataFrame, dims: int = 2, restarts: int = 100, rounds: int = 50, seed: int = 42, test: str = "test", ref: str = "ref", titre: str = "titre") -> DataFrame:
    """``(name, side, x0, ..., stress)``: the best map of ``(test, ref, titre)`` over all restarts.

    Antigens (``side`` ag) and sera (sr) are separate points even under the same name.
    """
    based = column_basis_distance(titres, ref, titre)
    edges = cut_lineage(based.select(F.concat(F.lit("ag|"), F.col(test)).alias("a"), F.concat(F.lit("sr|"), F.col(ref)).alias("b"), F.col("distance").alias("dist"), "censored"), "edges")
    placed = best_restart(edges, embed(edges, dims, restarts, rounds, seed), dims)
    return placed.select(F.substring("node", 4, 1_000_000).alias("name"), F.substring("node", 1, 2).alias("side"), *_axes(dims), "stress")


def mds(distances: DataFrame, dims: int = 2, restarts: int = 1, rounds: int = 50, seed: int = 42) -> DataFrame:
    """``(name, x0, ..., stress)``: metric scaling of known distances ``(a, b, dist)``; gaps in the table are allowed."""
    edges = cut_lineage(distances.filter(F.col("a") < F.col("b")).select("a", "b", "dist", F.lit(False).alias("censored")), "edges")
    return best_restart(edges, embed(edges, dims, restarts, rounds, seed), dims).withColumnRenamed("node", "name")
