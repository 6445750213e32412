"""Words of whole texts as numbers, for operators that work on arrays of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 20


def parts_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together have a bounded number of bytes, or are a single text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + PART_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts one after the other, a number for each that equal words share (the place where the
    word is met first), and the number of words per text. Words are separated by ASCII white space; null: none."""
    split = [(text or b"").split() for text in texts]
    words = list(chain.from_iterable(split))
    table: dict[bytes, int] = {}
    numbers = np.fromiter(map(table.setdefault, words, count()), dtype=np.int64, count=len(words))
    return words, numbers, np.fromiter(map(len, split), dtype=np.int64, count=len(split))
