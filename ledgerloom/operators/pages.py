"""Pages by the last sort key instead of an offset.

The rows after a cursor are found by a range predicate on the sort columns, whose bound on the leading column
reaches the scan and prunes row groups of files that are sorted by it.  So a page costs the same wherever it is: a
top-k of what is beyond the cursor.  Rows that are equal in all sort columns are counted by the cursor, so a walk
over all pages gives every row once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A sort column and whether it descends.
Sort = Sequence[tuple[str, bool]]


@dataclass(frozen=True)
class Cursor:
    """The sort values of the last row seen, and how many rows with just these have been seen."""

    values: tuple[Any, ...]
    seen: int = 1


def _order(sort: Sort) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in sort]


def _beyond(column: str, down: bool, value: Any) -> Column:
    """Strictly after a value: nulls come first upwards and last downwards."""
    c = F.col(column)
    if down:
        return F.lit(False) if value is None else (c < F.lit(value)) | c.isNull()
    return c.isNotNull() if value is None else c > F.lit(value)


def _same(column: str, value: Any) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def beyond(sort: Sort, cursor: Cursor) -> Column:
    """Rows at or after the cursor."""
    after, equal = F.lit(False), F.lit(True)
    for (column, down), value in zip(sort, cursor.values, strict=True):
        after = after | (equal & _beyond(column, down, value))
        equal = equal & _same(column, value)
    # The bound on the leading column alone follows from the rest; as a plain comparison it can be pushed to the scan.
    (lead, down), value = sort[0], cursor.values[0]
    if value is not None:
        bound = (F.col(lead) <= F.lit(value)) | F.col(lead).isNull() if down else F.col(lead) >= F.lit(value)
        return bound & (after | equal)
    return F.col(lead).isNull() & (after | equal) if down else after | equal


def keyset_page(df: DataFrame, sort: Sort, size: int, cursor: Cursor | None = None) -> DataFrame:
    """The first ``size`` rows, or those after the cursor."""
    if cursor is None:
        return df.orderBy(*_order(sort)).limit(size)
    return df.where(beyond(sort, cursor)).orderBy(*_order(sort)).offset(cursor.seen).limit(size)


def cursor_after(rows: Sequence[Row], sort: Sort, cursor: Cursor | None = None) -> Cursor | None:
    """The cursor behind a page's rows; the old one if the page was empty."""
    if not rows:
        return cursor
    values = tuple(rows[-1][c] for c, _ in sort)
    seen = sum(tuple(r[c] for c, _ in sort) == values for r in rows)
    if cursor is not None and cursor.values == values:
        seen += cursor.seen
    return Cursor(values, seen)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """(total, total_pages), one row however many rows there are."""
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("bigint"))
