"""Vectors as the search operators read them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def distinct_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` of the usable vectors; rows that repeat an id count once."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id"])


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` highest scores, ties to smaller ids.

    Minus infinity marks what takes no part.
    """
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]
