"""Vectors as integers: what the vector operators share.

A vector takes part if neither it nor one of its components is null, NaN or infinite.
Components become ``floor(scale * x)``, with x as double. Vectors shorter than the longest
count as ending in zeros. ``packed`` turns a batch of lists into one matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_integers(df: DataFrame, vector_col: str, scale: int, **columns) -> DataFrame:
    """The rows whose vector takes part, as ``columns`` and ``v`` (array of long)."""
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.filter(vector.isNotNull() & sound).select(*[c.alias(n) for n, c in columns.items()], whole.alias("v"))


def extent(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows, longest vector and largest component, without its sign."""
    top = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    n, longest, largest = rows.agg(F.count("*"), F.max(F.size("v")), top).head()
    return n, longest or 0, largest or 0


def packed(column, width: int) -> np.ndarray:
    """An Arrow column of lists without nulls as a matrix of ``width`` columns."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
