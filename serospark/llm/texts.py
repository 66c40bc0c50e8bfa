"""Words of UTF-8 texts without building one list for a very long text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """Consecutive parts of about ``size`` bytes, cut before spaces."""
    start = 0
    while len(data) - start > size:
        end = data.rfind(b" ", start + 1, start + size)
        if end < 0:
            end = data.find(b" ", start + size)
            if end < 0:
                break
        yield data[start:end]
        start = end
    yield data[start:]


def single_spaced(data: bytes) -> bytes:
    """Words (runs without ASCII white space) joined by one space."""
    if len(data) <= PIECE_BYTES:
        return b" ".join(data.split())
    return b" ".join(filter(None, (b" ".join(p.split()) for p in pieces(data))))


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``size`` bytes in a column of texts, or one row with more."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end
