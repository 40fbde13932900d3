"""Short codes of vectors: one entry of a codebook for each of their parts, learned with adaptive bounds.

Components become integers and vectors are cut into equal consecutive parts; each part position has a codebook.
Rounds assign every part to its nearest entry and move every entry to the floor of its parts' mean.  After
Drake and Hamerly (2012), a part remembers between rounds its ``b`` closest other entries, nearest first, with a
lower bound for each, and one outer bound for all entries beyond; each bound holds for its place and all after.
When entries have moved, bounds sink by as much.  A part whose own entry, measured exactly, is nearer than the
first bound keeps it; one that is nearer than a later bound is compared with the entries before that place; one
that even the outer bound does not clear is compared with all.  Every comparison is of integers, so bounds only
decide what need not be compared, and ties go to the lower index.  ``b`` adapts: a block of rows writes as many
places as nearly all its parts have needed.

A round is one pass over a table of the parts' state, without a shuffle; a task gives sums for each entry beside
its rows.  The table of a round is written to the shared folder, and goes when the next one is complete.

Defined results: rows whose vector is null, holds null or non-finite components, is empty or not of a length that
``parts`` divides take no part; nor do those of another length than the first row's by (vec_id, vector), ids
before null; rows that share a ``vec_id`` are each coded, and each may begin an entry, in order of their
vectors; with fewer rows than ``entries`` there are as many entries as rows; components beyond 2 ** 24 / ``scale``
count as that; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import drop, fresh_folder
from .lattice import BLOCK, Sums, above, below, lists, matrix, means, squared, whole_rows
from .ship import session_of

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Places of a part's list: at first and at least, as a share of the entries.
MOST, FEWEST = 4, 32
#: The share of a block's parts that need no more places than it writes.
SERVED = 0.99

_NAMES = ["vec_id", "label", "vector", "own", "near", "bounds", "entry", "many", "total"]


def _state(label: str) -> str:
    return f"vec_id long, label {label}, vector array<int>, own array<int>, near array<int>, bounds array<float>, entry int, many long, total array<long>"


class Books:
    """The codebooks of all parts, and how far each entry moved since the bounds were made."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray | None = None):
        self.entries, self.drift = entries, drift  # (part, entry, component), (part, entry)

    def moved(self, entries: np.ndarray) -> Books:
        gap = entries - self.entries
        return Books(entries, above((gap * gap).sum(axis=2)))

    def _measured(self, points: np.ndarray, part: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Exact squared distances of points to the entries named in the same row."""
        gap = points[:, None, :] - self.entries[part[:, None], entry]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def all_compared(self, points: np.ndarray, part: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """(own, own squared distance, near, bounds) of points compared with every entry of their part."""
        size = self.entries.shape[1]
        b = min(b, size - 1)
        own, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        near, bounds = np.zeros((len(points), b), np.int64), np.full((len(points), b + 1), np.inf)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            apart = squared(points[at], self.entries[p])
            order = np.argsort(apart, axis=1, kind="stable")[:, : b + 2]
            ranked = np.take_along_axis(apart, order, axis=1)
            own[at], error[at], near[at] = order[:, 0], ranked[:, 0], order[:, 1 : b + 1]
            bounds[at, : order.shape[1] - 1] = below(ranked[:, 1:])
        return own, error, near, bounds

    def bounded(self, points: np.ndarray, part: np.ndarray, own: np.ndarray, near: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same after entries have moved, and how many places each point needed."""
        b = near.shape[1]
        own, near = own.copy(), near.copy()
        error = self._measured(points, part, own[:, None])[:, 0]
        bounds = bounds.astype(np.float64)
        bounds[:, :b] -= self.drift[part[:, None], near]
        bounds[:, b] -= self.drift.max(axis=1)[part]
        bounds = _ordered(np.nextafter(bounds, -np.inf))
        need = (bounds <= above(error)[:, None]).sum(axis=1)
        for z in range(1, b + 1):
            at = np.flatnonzero(need == z)
            if not len(at):
                continue
            entry = np.concatenate([own[at, None], near[at, :z]], axis=1)
            apart = np.concatenate([error[at, None], self._measured(points[at], part[at], near[at, :z])], axis=1)
            order = np.lexsort((entry, apart), axis=1)
            entry, apart = np.take_along_axis(entry, order, axis=1), np.take_along_axis(apart, order, axis=1)
            own[at], error[at], near[at, :z] = entry[:, 0], apart[:, 0], entry[:, 1:]
            bounds[at, :z] = below(apart[:, 1:])
        at = np.flatnonzero(need > b)
        if len(at):
            own[at], error[at], near[at], bounds[at] = self.all_compared(points[at], part[at], b)
        return own, error, near, _ordered(bounds), need


def _ordered(bounds: np.ndarray) -> np.ndarray:
    """Bounds that hold for all later places too."""
    return np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]


def _pass(state: DataFrame, books: Books, parts: int, last: bool = False) -> DataFrame:
    """Rows of ``state`` assigned anew; with sums for each entry, or with codes in the ``last`` pass."""
    size, width = books.entries.shape[1:]
    first, label = books.drift is None, state.schema["label"].dataType.simpleString()

    def assigned(points: np.ndarray, part: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        if first:
            return *books.all_compared(points, part, size // MOST), None
        own, near, bounds = (batch.column(k) for k in (3, 4, 5))
        own = matrix(own).reshape(-1)
        return books.bounded(points, part, own, matrix(near).reshape(len(own), -1), matrix(bounds, np.float32).reshape(len(own), -1))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kind = Sums(parts * size, width), None
        step = max(1, BLOCK // (parts * width))
        for whole in batches:
            kind = whole.column(1).type
            for begin in range(0, len(whole), step):
                # Rows of one block have lists of one length.
                for batch in [whole.slice(begin, step)] if first else _alike(whole.slice(begin, step)):
                    n = len(batch)
                    points = matrix(batch.column(2)).reshape(n * parts, width)
                    part = np.tile(np.arange(parts), n)
                    own, error, near, bounds, need = assigned(points, part, batch)
                    if last:
                        code = own.reshape(n, parts).astype(np.uint8)
                        hexed = [row.tobytes().hex() for row in code]
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexed), pa.array(error.reshape(n, parts).sum(axis=1))], names=["vec_id", "label", "code", "error"])
                        continue
                    sums.add(points, part * size + own)
                    b = near.shape[1]
                    if need is not None:
                        served = int(np.quantile(need, SERVED, method="higher"))
                        b = min(b, max(1, size // FEWEST, served))
                    kept = np.nextafter(bounds[:, : b + 1].astype(np.float32), np.float32(-np.inf))
                    none = pa.nulls(n, pa.int64())
                    columns = [*(batch.column(k) for k in range(3)), lists(own.reshape(n, parts), pa.int32()), lists(near[:, :b].reshape(n, parts * b), pa.int32()), lists(kept.reshape(n, parts * (b + 1)), pa.float32()), none.cast(pa.int32()), none, pa.nulls(n, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        if not last and kind is not None:
            used = np.flatnonzero(sums.count)
            empty = [pa.nulls(len(used), x) for x in (pa.int64(), kind, *[pa.list_(pa.int32())] * 3, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array(sums.count[used]), lists(sums.total[used], pa.int64())], names=_NAMES)

    return state.mapInArrow(apply, f"vec_id long, label {label}, code string, error long" if last else _state(label))


def _alike(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists are equally long."""
    sizes = np.diff(batch.column(4).offsets.to_numpy())
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row that takes part, and the codebooks (part, entry, component).

    ``code`` has two hex digits a part, so there are at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = session_of(vectors)
    rows = whole_rows(vectors, scale, "label").select("vec_id", "label", "vector")
    label = rows.schema["label"].dataType.simpleString()
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    length = len(first[0].vector)
    rows = rows.where(F.size("vector") == length)
    begin = np.array([r.vector for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = Books(begin.reshape(len(begin), parts, length // parts).transpose(1, 0, 2).copy())
    folder, before = fresh_folder(spark, "codes"), None
    for k in range(rounds):
        _pass(rows, books, parts).write.parquet(f"{folder}/round-{k}")
        if before:
            drop(spark, before)
        before = f"{folder}/round-{k}"
        state = spark.read.schema(_state(label)).parquet(before)
        flat = books.entries.reshape(-1, length // parts)
        books = books.moved(means(state, flat).reshape(books.entries.shape))
        rows = state.where("entry IS NULL")
    _pass(rows, books, parts, last=True).write.parquet(f"{folder}/codes")
    if before:
        drop(spark, before)
    return spark.read.schema(f"vec_id long, label {label}, code string, error long").parquet(f"{folder}/codes"), books.entries


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row that takes part."""
    coded, books = compress(vectors, parts, entries, rounds, scale)
    seal = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # Grouped by more than the label, so that the join has an exchange on both sides and a common label can be split.
    labels = coded.groupBy("label", F.hash("label").alias("_")).agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(seal).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, vector) with the integer components that ``coded(vec_id, code)`` stands for."""
    session_of(coded)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(len(batch), -1)
            rows = books[np.arange(codes.shape[1])[None, :], codes].reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(rows, pa.int32())], names=["vec_id", "vector"])

    return coded.select("vec_id", "code").mapInArrow(apply, "vec_id long, vector array<int>")
