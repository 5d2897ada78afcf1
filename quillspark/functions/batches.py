"""Arrow batches in pieces, for functions that make much more of a batch than it holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in pieces of about ``limit`` bytes of a text column, or one row where that is
    larger. Copies nothing; an empty batch gives one empty piece."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 64
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
