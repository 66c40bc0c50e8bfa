"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of words per worker.

Texts are split at ASCII white space, which the word tokenizer's own pre-tokenizer drops, so the ids
of a text are the ids of its words one after another; a worker encodes a word it has met before only
once. Tokenizer files of any other make are given whole texts.
"""

from __future__ import annotations

import json
import re
import string
import sys
import unicodedata
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from serospark.llm.texts import pieces
from serospark.llm.workers import remembered

# Words kept per worker (some 200 bytes a word), and bytes of text whose words are made distinct at once.
WORDS_KEPT = 300_000
SLICE_BYTES = 1 << 21
_ENDS = string.punctuation  # none is a letter or number, so marks after letters are a token group of their own
_WORD_MAKE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies use for each byte: printable Latin-1 as is, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def _drops_white_space(tokenizer: Tokenizer) -> bool:
    made = json.loads(tokenizer.to_str())
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        made.get("normalizer") == _WORD_MAKE["normalizer"] and len(steps) == 2 and made.get("post_processor") is None
        and steps[0].get("pattern") == {"Regex": _WORD_MAKE["split"]} and steps[0].get("invert") is True
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space"))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) of words, filled on demand; when full, the older half goes."""

    def __init__(self, tokenizer: Tokenizer, limit: int):
        super().__init__()
        self.limit, self.whole = limit, tokenizer.encode
        self.tokenize = tokenizer.model.tokenize
        self.letters = byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        packed = self.packed
        if word.isascii() and word.isalpha():
            ids = b"".join([packed[t.id] for t in self.tokenize(word.lower())])
        else:
            ids = self.other(word)
        if len(self) >= self.limit:
            for old in list(islice(self, self.limit // 2)):
                del self[old]
        self[word] = ids
        return ids

    def other(self, word: str) -> bytes:
        """Ids of a word with anything but ASCII letters in it."""
        if word.isalpha():
            lower = "".join(map(str.lower, word))
            if lower.isalpha() and unicodedata.is_normalized("NFC", word):
                letters = lower.encode().decode("latin-1").translate(self.letters)
                return b"".join([self.packed[t.id] for t in self.tokenize(letters)])
        return packed(self.whole(word, add_special_tokens=False).ids)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of each."""
        found = list(map(self.__getitem__, words))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` that have these ``sizes``, in the order of ``codes``, and their sizes."""
    starts, own = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(own)
    at = np.repeat(starts[codes] - (ends - own), own)
    at += np.arange(len(at))
    return ids[at], own


class Encoder:
    """Ids of UTF-8 texts.

    Words of many texts are made distinct at once: the memory of words is asked once for each of them, and ids
    are copied from there by arrays. Marks at the end of a word of letters are a word of their own.
    """

    def __init__(self, path: str, words_kept: int = WORDS_KEPT, slice_bytes: int = SLICE_BYTES):
        self.tokenizer, self.slice_bytes = Tokenizer.from_file(path), slice_bytes
        self.words = _Words(self.tokenizer, words_kept) if _drops_white_space(self.tokenizer) else None

    def _distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after another, and the number of each."""
        base = pc.utf8_rtrim(words, characters=_ENDS)
        letters = pc.utf8_is_alpha(base)
        parted = pc.and_(letters, pc.less(pc.binary_length(base), pc.binary_length(words)))
        # Only words of letters are put in lower case beforehand: control strings count in lower case only.
        base = pc.if_else(pc.string_is_ascii(base), pc.ascii_lower(base), base)
        heads = pc.if_else(letters, base, words).dictionary_encode()
        marks = pc.struct_field(pc.extract_regex(words.filter(parted), f"(?P<m>[{re.escape(_ENDS)}]+)$"), "m").dictionary_encode()
        known = [*heads.dictionary.to_pylist(), *marks.dictionary.to_pylist(), ""]
        # Two codes a word: its letters, and its marks or the empty word.
        codes = np.full((len(words), 2), len(known) - 1, np.int64)
        codes[:, 0] = heads.indices.to_numpy()
        codes[np.flatnonzero(parted.to_numpy(zero_copy_only=False)), 1] = marks.indices.to_numpy() + len(heads.dictionary)
        ids, sizes = _gathered(*self.words.of(known), codes.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def _slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        # The split has an empty word where a text begins or ends with white space.
        words = split.flatten().dictionary_encode()
        ids, own = _gathered(*self._distinct(words.dictionary), words.indices.to_numpy())
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        counts = before[ends]
        return ids, np.diff(counts, prepend=0)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (unsigned 32-bit), and how many each has; a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.words is None:
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        parts, counts, at = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            low = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, low + self.slice_bytes, "right"))
            if end > at:
                ids, own = self._slice(texts.slice(at, end - at).cast(pa.string()))
            else:  # one text longer than a slice
                end, made = at + 1, [self._slice(pa.array([p.decode()]))[0] for p in pieces(texts[at].as_py().encode(), self.slice_bytes)]
                ids, own = np.concatenate(made), np.array([sum(map(len, made))])
            parts.append(ids)
            counts.append(own)
            at = end
        return np.concatenate(parts), np.concatenate(counts)

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``batch`` with ``end_id`` after every text."""
        ids, counts = self.batch(texts)
        made = np.full(len(ids) + len(counts), end_id, np.uint32)
        made[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return made, counts + 1


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file; tasks that follow each other share its words."""
    return remembered(("encoder", path), lambda: Encoder(path))
