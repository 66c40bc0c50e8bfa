"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serospark.llm.subwords import Model, scored, train
from serospark.llm.toxicity import sample_texts

# Most documents used for training, the same number of each language: those with the smallest hashes of their ids.
TRAIN_ROWS = 3000
UNKNOWN = "und"


def fit(documents: DataFrame, rows: int = TRAIN_ROWS, seed: int = 1) -> Model:
    """Train on at most ``rows`` of the documents whose ``lang`` is not null; null texts are left out.

    With one language the model knows that one; without any it knows none.
    """
    answers = documents.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("doc_id").agg(F.min("lang").alias("answer"))
    found, shares = sample_texts(documents.filter("text IS NOT NULL"), answers, rows)
    classes = sorted({y for y, _ in found})
    if len(classes) < 2:
        return Model(classes, np.zeros((1 << 10, len(classes)), np.float32), np.zeros(len(classes)), 10)
    model = train([t for _, t in found], [y for y, _ in found], epochs=(5, 40), steps=15_000, seed=seed)
    model.weigh(shares)
    return model


def identify(documents: DataFrame, model: Model, *keys: str, reject_below: float | None = None, keep_rejected: bool = False) -> DataFrame:
    """``(*keys, lang_pred, score, rejected)``, row by row.

    ``score`` is the calibrated probability of the best class. It is rejected below ``reject_below``, which is fitted with the
    model if not given: hardly any text of a learnt language scores less. A null text, one without a letter (as
    ``str.isalpha`` has it) and, unless ``keep_rejected``, a rejected one are ``und``; the first two have score 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.parts())
    kinds = dict(documents.dtypes)
    bound = model.reject if reject_below is None else reject_below

    def best(model: Model, texts: list[str]) -> dict:
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not model.classes:
            return {"lang_pred": pa.array([UNKNOWN] * len(texts)), "score": pa.array(np.zeros(len(texts))), "rejected": pa.array([True] * len(texts))}
        p = model.probabilities(texts)
        top, score = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0)
        rejected = score < bound
        names = np.where(lettered & (keep_rejected | ~rejected), np.array(model.classes, object)[top], UNKNOWN)
        return {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score), "rejected": pa.array(rejected)}

    return documents.select(*keys, "text").mapInArrow(
        lambda batches: scored(shared, batches, len(keys), best), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "lang_pred string, score double, rejected boolean"]))
