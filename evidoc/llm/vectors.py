"""Vectors as integers, for the operators on ``embeddings``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a matrix that a Python task works on at once.
NUMBERS_PER_STEP = 1 << 20


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def integers(rows: DataFrame, keep: list[str], limit: int, vector: str = "embedding") -> DataFrame:
    """Columns ``keep`` of the rows with usable vectors, and ``x``: floor(256 * component) as longs, held
    within ``limit`` either way."""
    whole = lambda v: F.floor(F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), v.cast("double") * 256)))
    return rows.filter(usable(vector)).select(*keep, F.transform(vector, whole).alias("x"))


def length(rows: DataFrame, vector: str = "embedding") -> int:
    """The length of the longest usable vector, 0 without any."""
    return rows.filter(usable(vector)).agg(F.max(F.size(vector))).first()[0] or 0


def matrices(column: pa.Array, width: int):
    """(first row, matrix) of the rows of an array column whose lists all are of ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    step = max(1, NUMBERS_PER_STEP // max(1, width))
    for lo in range(0, len(flat), step):
        yield lo, flat[lo : lo + step].astype(np.int64)
