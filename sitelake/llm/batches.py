"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Characters of text that a task works on at once; longer texts come alone.
CHUNK_CHARS = 2_000_000


def by_size(frames: Iterable[pd.DataFrame], column: str, limit: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows whose texts hold about ``limit`` characters."""
    for frame in frames:
        if not len(frame):
            continue
        lengths = frame[column].str.len().fillna(0).astype("int64")
        run = lengths.cumsum() // limit
        for _, part in frame.groupby(run.to_numpy(), sort=False):
            yield part.reset_index(drop=True)
