"""What the learned operators share: bounded samples of labelled rows and texts in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remainder(divisor: int):
    """crc32 of the document id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, those with the smallest hash of ``doc_id``.

    Hashes are even, so the smallest ``most`` of a value's ``n`` are below about ``most / n`` of their range; rows
    beyond four times that are left out first, and a task ranks a few times ``most`` rows however common a
    value is.  ``rows`` has ``doc_id`` and ``by``, a column of labels, of which there are few; equal rows count once.
    """
    place = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(by, "_by")
    near = rows.join(F.broadcast(counts), F.col(by) == F.col("_by")).where(place * F.col("_n") <= 4 * most + 100).drop("_by", "_n").distinct()
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id")))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


#: Partitions of a bounded sample.  Fitting runs hundreds of small jobs over it, each with a task a partition.
SAMPLE_PARTS = 8


def blocks(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts whose texts hold about ``size`` bytes, one row at least."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        wide = pa.types.is_large_string(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4))
        begin = 0
        while begin < len(texts):
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + size, side="right")) - 1)
            yield batch.slice(begin, stop - begin)
            begin = stop
