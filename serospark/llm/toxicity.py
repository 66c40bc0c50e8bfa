"""Toxicity: averaged subword embeddings with a linear softmax over whole texts.

Misspelt and inflected words share most of their character n-grams, and so their scores, with words
seen in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from serospark.llm.subwords import Model, scored, train

# Most labelled documents used for training, the same number of each label: those with the smallest hashes of their ids.
TRAIN_ROWS = 3000
THRESHOLD = 0.3


def remainder(doc_id: Column | str, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def sample_texts(documents: DataFrame, answers: DataFrame, rows: int, seed: int = 7) -> tuple[list, dict]:
    """Collected ``(answer, text)`` of at most ``rows`` documents of ``answers (doc_id, answer)``, and shares by answer.

    Every answer has an equal part of the rows (those with the smallest hashes of their ids), so a rare one is learnt at any
    share; the second result is each answer's share among all ``answers`` over that in the sample, to correct for
    it. Ids are chosen first, so the bounded list is all that is joined to the texts; of several texts of an id one
    is taken before they are collected, which bounds the rows too.
    """
    known = answers.filter("doc_id IS NOT NULL AND answer IS NOT NULL")
    counts = {r["answer"]: r["n"] for r in known.groupBy("answer").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    if not counts:
        return [], {}
    per = max(1, rows // len(counts))
    chosen = None
    for answer in sorted(counts, key=str):
        part = known.filter(F.col("answer") == F.lit(answer)).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per)
        chosen = part if chosen is None else chosen.union(part)
    text = F.coalesce("text", F.lit(""))
    picked = documents.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("answer").alias("answer"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sorted(picked.collect(), key=lambda r: r["doc_id"])  # at most ``rows`` rows
    taken = {a: sum(r["answer"] == a for r in found) for a in counts}
    shares = {a: (n / sum(counts.values())) / (taken[a] / len(found)) for a, n in counts.items() if taken[a]}
    return [(r["answer"], r["text"]) for r in found], shares


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 1) -> Model:
    """Train on at most ``rows`` documents of ``labels (doc_id, toxic)``.

    Null ids and labels are ignored, of several labels of a document the worst counts, null texts are
    empty. Without labels of both kinds the model scores every text with the share of toxic ones.
    """
    answers = labels.groupBy("doc_id").agg(F.max("toxic").alias("answer"))
    found, shares = sample_texts(documents, answers, rows)
    if len({y for y, _ in found}) < 2:
        share = (sum(y for y, _ in found) + 0.5) / (len(found) + 1)
        return Model([0, 1], np.zeros((1 << 10, 2), np.float32), np.log([1 - share, share]), 10)
    model = train([t for _, t in found], [y for y, _ in found], seed=seed)
    model.weigh(shares)
    return model


def score(documents: DataFrame, model: Model, *keys: str) -> DataFrame:
    """``(*keys, score)``: the probability that a text is toxic, row by row, empty and null texts too."""
    shared = documents.sparkSession.sparkContext.broadcast(model.parts())
    kinds = dict(documents.dtypes)

    def probabilities(model: Model, texts: list[str]) -> dict:
        return {"score": pa.array(model.probabilities(texts)[:, 1])}

    return documents.select(*keys, "text").mapInArrow(
        lambda batches: scored(shared, batches, len(keys), probabilities), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "score double"]))


def remove_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns and whatever their order, whose score is below ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model.parts())
    place = documents.columns.index("text")

    def kept(batches):
        own = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(own.probabilities(texts)[:, 1] < threshold))

    return documents.mapInArrow(kept, documents.schema)
