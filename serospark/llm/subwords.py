"""Averaged subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is the bag of its hashed features: character n-grams of every word with its boundaries, and the
words themselves. A feature has an embedding; a text is the average of its features' embeddings, and a
linear softmax over it gives the classes. Embeddings and softmax are trained together. Because the
model is linear past the average, a trained model is one table of class scores per feature, which is
all that tasks need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 18
GRAMS = (3, 4, 5)
# Characters worked on together.
CHUNK = 1 << 19
_PRIME = 0x9E3779B1


def _word_characters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)] + [True])


_WORD = _word_characters()


def _mixed(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


@dataclass
class Features:
    """Per kind of feature, an id for every character position and whether the position has one."""

    ids: list[np.ndarray]
    live: list[np.ndarray]
    starts: np.ndarray  # first position of each text


def features(texts: list[str], bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> Features:
    """Features of lower-case texts, whole; anything but letters and digits parts words."""
    # Separators around each text: every text has a position, and no n-gram spans two texts.
    joined = "".join(" " + t + " \n" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    word = _WORD[np.minimum(codes, 1 << 16)]
    ends = np.cumsum([len(t) + 3 for t in texts])
    # One separator stands for a run of them, except where a text begins.
    begins = np.append(0, ends[:-1])
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[begins] = True
    keep[ends - 1] = True
    place = np.cumsum(keep) - 1
    starts = place[begins]
    word = word[keep]
    c = np.where(word, codes[keep], 0).astype(np.uint32)
    n = len(c)
    position = np.arange(n)
    stop = np.where(word, n, position)
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # the next separator at or after each position
    ids, live = [], []
    h = c.copy()
    power = 1
    for size in range(2, max(grams) + 1):
        power = power * _PRIME & 0xFFFFFFFF
        if size > n:
            break
        h[:n - size + 1] += c[size - 1:] * np.uint32(power)
        if size in grams:
            inner = np.zeros(n, bool)
            inner[:n - size + 1] = stop[1:n - size + 2] >= position[:n - size + 1] + size - 1
            ids.append(_mixed(h, size, bits))
            live.append(inner)
    first = word & ~np.append(False, word[:-1])
    at = np.flatnonzero(first)
    whole = np.zeros(n, np.uint32)
    if len(at):
        inside = (position - np.maximum.accumulate(np.where(first, position, 0))).astype(np.uint32)
        mixed = (c + np.uint32(1)) * (inside * np.uint32(_PRIME) | np.uint32(1))
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0x5BD1E995)
        mixed[~word] = 0
        whole[at] = np.add.reduceat(mixed, at)
    ids.append(_mixed(whole, 1, bits))
    live.append(first)
    return Features(ids, live, starts)


# Share of the texts left out of training whose best probability lies below the bound of rejection.
REJECTED = 0.005


@dataclass
class Model:
    """``table[f, c]``: score of feature ``f`` for class ``c``, averaged over a text and added to ``bias``.

    A best probability below ``reject`` is rare among texts of the learnt classes.
    """

    classes: list
    table: np.ndarray
    bias: np.ndarray
    bits: int = BITS
    reject: float = 0.0

    def parts(self) -> tuple:
        """What ``Model(*parts)`` is made from; plain values, which a worker can read without this package."""
        return self.classes, self.table, self.bias, self.bits, self.reject

    def weigh(self, shares: dict) -> None:
        """Turn probabilities fitted on a sample into those of the whole: ``shares`` has the whole's share of a class over the sample's."""
        self.bias = self.bias + np.log([max(shares.get(c, 1.0), 1e-12) for c in self.classes])

    def calibrate(self, z: np.ndarray, wanted: np.ndarray, rounds: int = 2000, rate: float = 0.05) -> None:
        """Scale and shift the scores to fit the classes of texts left out of training (scores ``z``)."""
        scale, shift, size = 1.0, np.zeros(z.shape[1]), np.abs(z).mean() + 1e-9
        for _ in range(rounds):
            p = softmax(z * scale + shift)
            p[np.arange(len(z)), wanted] -= 1
            scale = max(1e-3, scale - rate * (p * z).sum(axis=1).mean() / size)
            shift -= rate * p.mean(axis=0)
        self.table, self.bias = self.table * np.float32(scale), self.bias * scale + shift

    def logits(self, texts: list[str]) -> np.ndarray:
        """Class scores of whole texts, less those of the first class; any number of texts of any length."""
        table = self.table[:, 1:] - self.table[:, :1]
        total, count = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        for owners, parts in _portions(texts):
            found = features(parts, self.bits)
            for ids, live in zip(found.ids, found.live):
                at = np.flatnonzero(live)
                edges = np.append(np.searchsorted(at, found.starts), len(at))
                ids = ids[at]
                np.add.at(count, owners, np.diff(edges))
                for k in range(table.shape[1]):
                    sums = np.append(0.0, np.cumsum(table[ids, k], dtype=np.float64))
                    np.add.at(total[:, k + 1], owners, np.diff(sums[edges]))
        return total / np.maximum(count, 1)[:, None] + self.bias - self.bias[0]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts))


def _portions(texts: list[str]):
    """Lower-case texts in portions of about ``CHUNK`` characters; a longer text comes in parts, cut at spaces where it has some."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text, start = text.lower(), 0
        while True:
            end = len(text)
            if end - start > CHUNK:
                end = text.rfind(" ", start + 1, start + CHUNK)
                end = start + CHUNK if end < 0 else end
            owners.append(i)
            parts.append(text[start:end])
            size += end - start
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
            start = end
            if start >= len(text):
                break
    if parts:
        yield owners, parts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and the share of each."""
    found = features([text.lower()], bits)
    ids, counts = np.unique(np.concatenate([i[v] for i, v in zip(found.ids, found.live)]), return_counts=True)
    return ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: list, dims: int = 8, steps: int = 90_000, epochs: tuple[int, int] = (15, 100), rate: float = 0.5,
          pull: float = 200.0, decay: float = 0.01, least: int = 20, bits: int = BITS, seed: int = 1) -> Model:
    """Fit on whole texts, one at a time in shuffled order, with a rate falling to zero.

    There are about ``steps`` steps, in no fewer or more ``epochs`` than given. ``pull`` scales the step
    of the embeddings: averages over thousands of features move them little. ``decay`` shrinks the
    embeddings of a text's features at each step (less so below 3,000 texts), so that what single texts
    leave behind fades. Features of fewer than ``least`` texts (fewer for small samples) count in
    averages but have no embedding. The scores are calibrated afterwards on every fifth text, which is
    left out of training.
    """
    rounds = int(np.clip(steps / max(1, len(texts)), *epochs))
    decay *= min(1.0, len(texts) / 3000)
    classes = sorted(set(labels))
    index = {c: i for i, c in enumerate(classes)}
    rng = np.random.default_rng(seed)
    bags, wanted = [bag(t, bits) for t in texts], np.array([index[y] for y in labels])
    seen = np.zeros(1 << bits, np.int32)
    for ids, _ in bags:
        seen[ids] += 1
    common = seen >= min(least, max(1, len(texts) // 30))
    for i, (ids, part) in enumerate(bags):  # one by one: two whole sets of bags need not be held
        kept = common[ids]
        bags[i] = ids[kept], part[kept]
    table = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims)).astype(np.float32)
    table[~common] = 0
    weights = rng.uniform(-0.1, 0.1, (dims, len(classes))).astype(np.float32)
    share = np.bincount(wanted, minlength=len(classes)) + 1.0
    bias = np.log(share / share.sum()).astype(np.float32)
    aside = np.arange(len(texts)) % 5 == 4
    fitted = np.flatnonzero(~aside) if aside.any() else np.arange(len(texts))
    done, end = 0, rounds * len(fitted)
    for _ in range(rounds):
        for i in rng.permutation(fitted):
            ids, part = bags[i]
            if not len(ids):
                continue
            now = rate * (1 - done / end)
            done += 1
            hidden = part @ table[ids]
            p = softmax((hidden @ weights + bias)[None])[0]
            p[wanted[i]] -= 1
            back = weights @ p
            weights -= now * np.outer(hidden, p)
            bias -= 0.01 * now * p
            table[ids] = table[ids] * (1 - now * decay) - (now * pull) * part[:, None] * back
    model = Model(classes, table @ weights, bias, bits)
    if aside.any():
        held = np.flatnonzero(aside)
        z = np.array([bags[i][1] @ model.table[bags[i][0]] for i in held])
        model.calibrate(z + bias, wanted[held])
        sure = softmax(np.array([bags[i][1] @ model.table[bags[i][0]] for i in held]) + model.bias).max(axis=1)
        model.reject = float(np.quantile(sure, REJECTED))
    return model


def scored(model, batches, columns: int, out):
    """Map Arrow batches ``(*columns, text)`` to their columns beside what ``out(model, texts)`` gives as arrays by name; ``model`` is a broadcast of ``parts()``."""
    import pyarrow as pa

    own = Model(*model.value)
    for batch in batches:
        texts = [t or "" for t in batch.column(columns).to_pylist()]
        made = out(own, texts)
        yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *made.values()], names=[*batch.schema.names[:columns], *made])
