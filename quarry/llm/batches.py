"""Record batches in slices of bounded size, so that a task works on some
megabytes of text at a time whatever the size of Spark's batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCK_WORDS = 1 << 16


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with up to ``most`` bytes in a column together; a
    longer value is a slice of its own. An empty batch is one slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, before = 0, 0
    while True:
        upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, upto - at)
        if upto >= len(ends):
            return
        at, before = upto, int(ends[upto - 1])


def contents(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """The values of a text column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length."""
    if len(data) < 1 << 20:
        yield data.split()
        return
    found = WORD.finditer(data)
    while block := [m.group() for m in islice(found, BLOCK_WORDS)]:
        yield block
