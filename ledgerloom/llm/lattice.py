"""Vectors as integers, and what iterated assignments of them to entries share.

Components become ``floor(scale * x)``.  Those beyond ``LIMIT`` either way count as ``LIMIT``, so that squared
distances and their sums fit 64 bits up to 4096 components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 24
#: Numbers that a block of rows holds at most, whatever the length of its vectors.
BLOCK = 1 << 19


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))


def whole_rows(vectors: DataFrame, scale: int, *others: str) -> DataFrame:
    """(vec_id, vector, *others) of rows whose vector is whole; ``vector`` has integers."""
    held = [F.col(c) for c in others]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), *held)
    return rows.where(finite(F.col("vector"))).withColumn("vector", scaled(F.col("vector"), scale))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel(), kind))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point (row) to every entry (column)."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * float(most) ** 2 * points.shape[1] < 2**53:  # all sums are whole numbers that a double holds
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    both = (points**2).sum(1)[:, None] - 2 * (points @ entries.T) + (entries**2).sum(1)[None, :]
    return both.astype(np.int64)


def below(squares: np.ndarray) -> np.ndarray:
    """A number at or below the distance, whatever the rounding."""
    return np.maximum(np.nextafter(np.sqrt(np.asarray(squares, np.float64)), -np.inf), 0)


def above(squares: np.ndarray) -> np.ndarray:
    """A number at or above the distance, whatever the rounding."""
    return np.nextafter(np.sqrt(np.asarray(squares, np.float64)), np.inf)


class Sums:
    """Rows and componentwise sums of each entry, added up over a task."""

    def __init__(self, entries: int, width: int):
        self.count = np.zeros(entries, np.int64)
        self.total = np.zeros((entries, width), np.int64)

    def add(self, points: np.ndarray, entry: np.ndarray) -> None:
        n = len(self.count)
        self.count += np.bincount(entry, minlength=n)
        for k in range(points.shape[1]):  # exact: a block's sums are far below 2 ** 53
            self.total[:, k] += np.bincount(entry, points[:, k], minlength=n).astype(np.int64)


def means(passed: DataFrame, entries: np.ndarray) -> np.ndarray:
    """New entries by ``passed(entry, many, total)``, one row an entry and task; entries without a point stay.

    The driver gets as many numbers as the entries have, which the parameters bound.
    """
    width = entries.shape[1]
    by = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)] if width <= 128 else None
    moved = entries.copy()
    tasks = passed.where("entry IS NOT NULL")
    if by:
        for row in tasks.groupBy("entry").agg(F.sum("many").alias("many"), *by).collect():
            if row.many:
                moved[row.entry] = [row[k + 2] // row.many for k in range(width)]
        return moved
    long = tasks.select("entry", "many", F.posexplode("total").alias("place", "part")).groupBy("entry", "place").agg(F.sum("many").alias("many"), F.sum("part").alias("part"))
    for row in long.collect():
        if row.many:
            moved[row.entry, row.place] = row.part // row.many
    return moved
