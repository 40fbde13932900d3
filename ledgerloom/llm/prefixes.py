"""All pairs of texts that can be similar, by prefixes of their rare shingles.

All texts' shingles are put in one order, rare ones first.  Let two texts have the weights ``x <= y`` in all, and a
weighted Jaccard similarity of at least ``t``.  What they have in common weighs at least ``t / (1 + t) * (x + y)``, so
at the first shingle they share at least that much is left in both.  Hence it lies where the lighter text has
``2 t / (1 + t)`` of its own weight left (its posted prefix), and where the heavier one has ``t`` of its own (its asked
prefix), which is longer.  Postings carry the weight that is left, and a pair whose smaller one falls short is
dropped.  Texts that share less than the posted prefix leaves, such as a common template, never meet.

A shingle's postings and questions are cut into blocks, and every block of the one meets every block of the other
in a cell of its own, so that no task has more than ``CELL`` of each, however common a shingle is.  In a cell the
postings are sorted by weight, and a question is compared with the run of those that can reach it.

The order is by how many of the texts hold a shingle, counted in slots of its hash; any order gives all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import fresh_folder
from .learning import blocks
from .sampling import Weights, shingle_lists
from .ship import session_of

SLOT_BITS = 20
PIECE_BITS = 14
CELL = 2000
PAIRS = 500_000
_POST = "shingle long, doc_id long, class long, n_class long, size double, left double, posted boolean"


def _held_by(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each slot; tasks give their sums in packed pieces."""
    pieces = 1 << SLOT_BITS - PIECE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shift = np.zeros(1 << SLOT_BITS, np.int64), np.uint64(64 - SLOT_BITS)
        for block in blocks(batches, 0):
            held = [h for h, _ in shingle_lists(block.column(0).to_pylist())]
            sums += np.bincount((np.concatenate(held) >> shift).view(np.int64), minlength=len(sums))
        if sums.any():
            packed = [row.tobytes() for row in sums.reshape(pieces, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(sums.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "sums"])

    schema = "piece int, sums binary"
    found = texts.select("text").mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect()  # a number for each slot
    out = np.zeros((pieces, 1 << PIECE_BITS), np.int64)
    for r in found:
        out[r.piece] = np.frombuffer(r.sums, np.int64)
    return out.ravel()


def prefix(h: np.ndarray, weight: np.ndarray, order: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(shingles, weight left from there on, whether posted, whole weight) of the asked prefix of a text."""
    by = np.lexsort((h, order[(h >> np.uint64(64 - SLOT_BITS)).view(np.int64)]))
    left = np.cumsum(weight[by][::-1])[::-1]
    size = float(left[0]) if len(left) else 0.0
    asked = left >= least * (1 - 1e-9) * size
    posted = left[asked] >= 2 * least / (1 + least) * (1 - 1e-9) * size
    return h[by][asked], left[asked], posted, size


def _posts(texts: DataFrame, weights: Broadcast[Weights], least: float) -> DataFrame:
    spark = session_of(texts)
    sent = spark.sparkContext.broadcast(_held_by(texts))
    folder = fresh_folder(spark, "prefixes")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, order = weights.value, sent.value
        for block in blocks(batches, 3):
            found = [prefix(h, weigh(h, counts), order, least) for h, counts in shingle_lists(block.column(3).to_pylist())]
            n = [len(x[0]) for x in found]
            names, kinds, many = (np.repeat(block.column(k).to_numpy(), n) for k in range(3))
            shingle, left, posted = (np.concatenate([x[k] for x in found]) for k in range(3))
            columns = [shingle.view(np.int64), names, kinds, many, np.repeat([x[3] for x in found], n), left, posted]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _POST.split(", ")])

    texts.select("doc_id", "class", "n_class", "text").mapInArrow(post, _POST).write.parquet(folder)
    sent.destroy()
    return spark.read.schema(_POST).parquet(folder)


def _cells(posts: DataFrame, cell: int) -> DataFrame:
    """Postings and questions of shingles that texts of several classes have, each in all the cells it belongs to."""
    held = posts.groupBy("shingle", F.hash("shingle").alias("_")).agg(
        F.count_if("posted").alias("posts"), F.count(F.lit(1)).alias("asks"), F.min("class").alias("low"), F.max("class").alias("high")
    )
    held = held.where("posts > 0 AND low < high").select(F.col("shingle").alias("_shingle"), F.ceil(F.col("posts") / cell).cast("long").alias("rows"), F.ceil(F.col("asks") / cell).cast("long").alias("columns"))
    rows = posts.join(held, F.col("shingle") == F.col("_shingle")).drop("_shingle")
    block = F.xxhash64("doc_id", "shingle")
    posted = rows.where("posted").select("*", F.lit(0).alias("side"), F.pmod(block, F.col("rows")).alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("column"))
    asked = rows.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"), F.pmod(block, F.col("columns")).alias("column"))
    return posted.unionByName(asked).select(F.xxhash64("shingle", "row", "column").alias("cell"), "shingle", "side", "size", "left", "doc_id", "class", "n_class")


def possible_pairs(texts: DataFrame, weights: Broadcast[Weights], least: float, cell: int = CELL) -> DataFrame:
    """The distinct (a, b) of ``texts(doc_id, class, n_class, text)`` of different classes that can be ``least`` similar.

    ``b`` is the side whose class has fewer texts.
    """
    rows = _cells(_posts(texts, weights, least), cell)
    floor = least * (1 - 1e-9)

    def pairs_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, shingle, side, size, left, doc, kind, many = columns
        asks, posts = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(asks) or not len(posts):
            return
        # Rows are sorted by (cell, shingle, side, size): a question meets the postings of its group from ``least``
        # times its own weight up to its weight.  Complex numbers are ordered by group, then weight.
        group = np.cumsum(np.concatenate([[False], (cells[1:] != cells[:-1]) | (shingle[1:] != shingle[:-1])]))
        places = group[posts] + 1j * size[posts]
        begin = np.searchsorted(places, group[asks] + 1j * (floor * size[asks]))
        end = np.searchsorted(places, group[asks] + 1j * size[asks], side="right")
        n = np.maximum(end - begin, 0)
        total = np.cumsum(n)
        k = 0
        while k < len(n):
            done = total[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
            m = n[k:stop]
            y = np.repeat(asks[k:stop], m)
            x = posts[np.arange(len(y)) - np.repeat(total[k:stop] - m - done, m) + np.repeat(begin[k:stop], m)]
            near = (kind[x] != kind[y]) & (np.minimum(left[x], left[y]) >= floor / (1 + least) * (size[x] + size[y]))
            x, y = x[near], y[near]
            fewer = (many[x] < many[y]) | ((many[x] == many[y]) & (doc[x] < doc[y]))
            found = np.unique(np.stack([np.where(fewer, doc[y], doc[x]), np.where(fewer, doc[x], doc[y])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            k = stop

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield from pairs_of([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from pairs_of(held)

    order = ["cell", "shingle", "side", "size", "doc_id"]
    return rows.repartition("cell").sortWithinPartitions(*order).mapInArrow(pair, "a long, b long").distinct()
