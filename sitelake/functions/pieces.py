"""Arrow batches in parts small enough to hold as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one column taken at a time.
PIECE_BYTES = 4 * 1024 * 1024


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts, in order: up to ``limit`` bytes of a column each, or one row.

    Spark fills its batches by rows, so they grow with a table until they are full.
    """
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)
