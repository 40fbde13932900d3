"""Nearest neighbours by largest inner product along shifted Hilbert curves.

Vectors are projected at random to a few dimensions and placed on several Hilbert curves, each with its own
projection and shift.  Spark range-partitions and sorts by (curve, key); a task slides over its rows in
blocks and ranks the queries of a block against that block and its neighbours.  What the curves found is
merged and gives every query a bound: the score of its ``k``-th candidate.

Windows alone miss neighbours where vectors have no structure that a few dimensions keep.  So the windows
then widen along the first curve: its rows are packed into blocks with centre and radius, and a block is
ranked for a block of queries unless Cauchy's bound shows that nothing in it can beat what is known.  The
result is exact; on clustered vectors most blocks are excluded, on isotropic ones few are, and then the work
is that of the queries against all rows, in blocks.

Equal vectors are one point that carries its ``k + 1`` smallest ids, which is all that a list of ``k`` can
use, so copies cost nothing however many there are.  Scores are correctly rounded inner products.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows
without id; rows that repeat a ``vec_id`` count once, with the smallest vector; only vectors of equal length
are compared; ties go to the smaller id; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import fresh_folder
from .ship import session_of

CURVES = 4
AXES = 8
BITS = 7
BLOCK = 512
DATA_BLOCK = 2048
QUERY_BLOCK = 512
# Data blocks that meet all query blocks in one task.
SALT_BLOCKS = 64
# Points that a block returns beyond the k + 1 asked for, so that rounding cannot lose one.
SPARE = 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates below ``2 ** bits``."""
    x = [c.copy() for c in np.asarray(cells, dtype=np.int64).T]
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | ((x[i] ^ turn) >> level & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, axes: int = AXES, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """Keys of vectors on one curve; only directions count."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([seed, curve, dim])
    used = min(axes, dim)
    base = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :used]
    flat = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ base * math.sqrt(dim)
    even = 0.5 * (1 + np.tanh(0.7978845608 * (flat + 0.044715 * flat**3)))
    shifted = (even + rng.random(used) * 0.5 * (curve > 0)) / (1 + 0.5 * (curve > 0))
    return hilbert(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` largest of each row, in no order."""
    if scores.shape[1] <= many:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, many - 1, axis=1)[:, :many]


_FOUND = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("near", pa.float64())])
FOUND = "query long, point long, near double"


def _ranked(queries: np.ndarray, q: np.ndarray, points: np.ndarray, x: np.ndarray, many: int) -> pa.RecordBatch:
    scores = q @ x.T
    best = _best(scores, many)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, best.shape[1])), pa.array(points[best].ravel()), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], schema=_FOUND)


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def points_of(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (point, dim, vector, ids, asked), and the query rows (query_id, vector)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    asked = rows.where(is_query)
    both = ranked.select("vector", "vec_id", F.lit(False).alias("asked")).unionByName(asked.select("vector", F.lit(None).cast("long").alias("vec_id"), F.lit(True).alias("asked")))
    points = both.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("asked").alias("asked"))
    return points.select(F.col("ids")[0].alias("point"), F.size("vector").alias("dim"), "vector", "ids", "asked"), asked.select(F.col("vec_id").alias("query_id"), "vector")


def on_curves(points: DataFrame, curves: int) -> DataFrame:
    """A row (curve, key) of every point on every curve."""
    schema = pa.schema([("curve", pa.int32()), ("dim", pa.int32()), ("key", pa.int64()), ("point", pa.int64()), ("asked", pa.bool_()), ("vector", pa.list_(pa.float64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(3))
                for curve in range(curves):
                    keys = curve_keys(x, curve)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), curve, np.int32)), part.column(1), pa.array(keys), part.column(0), part.column(2), part.column(3).cast(schema.types[5])], schema=schema)

    return points.select("point", "dim", "asked", "vector").mapInArrow(place, "curve int, dim int, key long, point long, asked boolean, vector array<double>")


def in_windows(placed: DataFrame, many: int, block: int = BLOCK) -> DataFrame:
    """The best of every query in its own block of key order and the two beside it."""

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple] = []

        def rank(middle: int) -> pa.RecordBatch | None:
            (line, points, asked, x) = window[middle]
            if not asked.any():
                return None
            near = [w for w in window if w[0] == line]
            return _ranked(points[asked], x[asked], np.concatenate([w[1] for w in near]), np.concatenate([w[3] for w in near]), many)

        for cut in _runs(batches, block):
            window.append(cut)
            if len(window) > 3:
                window.pop(0)
            if len(window) > 1 and (made := rank(len(window) - 2)) is not None:
                yield made
        if window:
            window = window[-2:]
            if (made := rank(len(window) - 1)) is not None:
                yield made

    return placed.repartitionByRange("dim", "curve", "key").sortWithinPartitions("dim", "curve", "key", "point").mapInArrow(slide, FOUND)


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple]:
    """Sorted rows cut into ((dim, curve), points, asked, matrix) of at most ``block`` rows of one curve."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        lines = table["dim"].to_numpy() * 1000 + table["curve"].to_numpy()
        at = 0
        while at < len(table):
            stop = int(np.searchsorted(lines, lines[at], side="right"))
            if stop == len(table) and stop - at < block:
                break
            stop = min(stop, at + block)
            yield _run(table.slice(at, stop - at), int(lines[at]))
            at = stop
        rest = table.slice(at) if at < len(table) else None
    if rest is not None:
        yield _run(rest, int(rest["dim"][0].as_py()) * 1000 + int(rest["curve"][0].as_py()))


def _run(table: pa.Table, line: int) -> tuple:
    return line, table["point"].to_numpy(), table["asked"].to_numpy(zero_copy_only=False), _matrix(table["vector"].combine_chunks())


_PACKED = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("points", pa.binary()), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("length", pa.float64()), ("bound", pa.float64()), ("bounds", pa.binary())])
PACKED = "block long, dim int, points binary, x binary, centre array<double>, radius double, length double, bound double, bounds binary"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (dim, key, point, vector, bound) in key order as blocks with centre, radius, length and least bound."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for (line, points, _, x), bounds in _with_bounds(batches, size):
            centre = x.mean(axis=0)
            radius = float(np.linalg.norm(x - centre, axis=1).max())
            length = float(np.linalg.norm(x, axis=1).max())
            yield pa.RecordBatch.from_pylist([{"block": name, "dim": line // 1000, "points": points.tobytes(), "x": x.tobytes(), "centre": centre.tolist(), "radius": radius, "length": length, "bound": float(bounds.min()), "bounds": bounds.tobytes()}], schema=_PACKED)
            name += 1

    return rows.repartitionByRange("dim", "key").sortWithinPartitions("dim", "key", "point").mapInArrow(pack, PACKED)


def _with_bounds(batches: Iterator[pa.RecordBatch], size: int):
    """Runs of rows with their bounds, which ride along as the last component of the vector."""
    for line, points, asked, x in _runs(batches, size):
        yield (line, points, asked, np.ascontiguousarray(x[:, :-1])), np.ascontiguousarray(x[:, -1])


def widened(placed: DataFrame, bounds: DataFrame, many: int) -> DataFrame:
    """The best of every query in the blocks of the first curve that may hold something nearer than its bound."""
    spark = session_of(placed)
    folder = fresh_folder(spark, "curve-blocks")
    first = placed.where("curve = 0")
    data = first.select("dim", "curve", "key", "point", F.lit(False).alias("asked"), F.concat("vector", F.array(F.lit(0.0))).alias("vector"))
    packed(data, DATA_BLOCK).write.parquet(f"{folder}/data")
    asked = first.where("asked").join(bounds, F.col("point") == F.col("query"), "left")
    asked = asked.select("dim", "curve", "key", "point", "asked", F.concat("vector", F.array(F.coalesce(F.col("bound"), F.lit(float("-inf"))))).alias("vector"))
    packed(asked, QUERY_BLOCK).write.parquet(f"{folder}/queries")
    left, right = spark.read.parquet(f"{folder}/queries"), spark.read.parquet(f"{folder}/data")
    # Blocks only, not rows, meet here: q.x <= c.d + |c| r + R |d| + R r for q = c + R, x = d + r.
    a = left.select(F.col("block").alias("i"), "dim", F.col("centre").alias("c"), F.col("radius").alias("big"), F.col("bound").alias("least"))
    b = right.select(F.col("block").alias("j"), "dim", F.col("centre").alias("d"), F.col("radius").alias("small"))
    dot = F.aggregate(F.zip_with("c", "d", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda name: F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, v: s + v * v))
    most = dot + norm("c") * F.col("small") + F.col("big") * norm("d") + F.col("big") * F.col("small")
    # Vectors have one length as a rule; salted, no task has all blocks.
    salts = max(1, -(-right.count() // SALT_BLOCKS))
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    b = b.withColumn("salt", F.pmod(F.xxhash64("j"), F.lit(salts)).cast("int"))
    cells = a.join(b, ["dim", "salt"]).where(most >= F.col("least") - 1e-9).select("i", "j")
    whole = cells.join(left.select(F.col("block").alias("i"), F.col("points").alias("qp"), F.col("x").alias("q"), F.col("bounds").alias("qb")), "i")
    whole = whole.join(right.select(F.col("block").alias("j"), F.col("points").alias("dp"), F.col("x").alias("d")), "j")

    def rank(table: pa.Table) -> pa.Table:
        made = []
        for qp, q, qb, dp, d in zip(*(table[c].to_pylist() for c in ("qp", "q", "qb", "dp", "d")), strict=True):
            queries, points = np.frombuffer(qp, np.int64), np.frombuffer(dp, np.int64)
            scores = np.frombuffer(q).reshape(len(queries), -1) @ np.frombuffer(d).reshape(len(points), -1).T
            best = _best(scores, many)
            near = np.take_along_axis(scores, best, axis=1)
            kept = near >= np.frombuffer(qb)[:, None] - 1e-9
            made.append(pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(queries[:, None], near.shape)[kept]), pa.array(points[best][kept]), pa.array(near[kept])], schema=_FOUND))
        return pa.Table.from_batches(made, schema=_FOUND)

    # A group is one pair of blocks, so a task holds one pair at a time.
    return whole.groupBy("i", "j").applyInArrow(rank, FOUND)


def _merged(found: DataFrame, many: int) -> DataFrame:
    """The best distinct points of every query; limited in every task before rows are shuffled."""
    once = found.groupBy("query", "point").agg(F.max("near").alias("near"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "point"))).where(F.col("place") <= many)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = CURVES, widen: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of every row where ``is_query`` holds.

    With ``widen=False`` only the windows count, which is quick but finds only what lies near on some curve.
    """
    spark = session_of(vectors)
    folder = fresh_folder(spark, "neighbours")
    points, asked = points_of(vectors, is_query, k)
    points.write.parquet(f"{folder}/points")
    points = spark.read.parquet(f"{folder}/points")
    on_curves(points, curves).write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    many = k + 1 + SPARE
    _merged(in_windows(placed, many), many).write.parquet(f"{folder}/windows")
    found = spark.read.parquet(f"{folder}/windows")
    if widen:
        bounds = found.where(F.col("place") == k + 1).select("query", F.col("near").alias("bound"))
        found = _merged(widened(placed, bounds, many).unionByName(found.select("query", "point", "near")), many)
    return _lists(found, points, asked, k)


def _lists(found: DataFrame, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact scores of what was found, dealt out to the query rows."""
    named = found.select("query", "point").join(points.select(F.col("point").alias("query"), F.col("vector").alias("q")), "query")
    named = named.join(points.select("point", F.col("vector").alias("x"), "ids"), "point")
    schema = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [math.fsum((q * x).tolist()) for q, x in zip(_rows(batch.column(2)), _rows(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema.types[1]), pa.array(scores, pa.float64())], schema=schema)

    scored = named.select("query", "ids", "q", "x").mapInArrow(exact, "query long, ids array<long>, score double")
    each = scored.select("query", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # Two keys, so that the join below has an exchange of its own and a vector that many queries share is split.
    lists = best.groupBy("query", F.hash("query").alias("_")).agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("list"))
    lists = lists.join(points.select(F.col("point").alias("query"), "vector"), "query").select("vector", "list")
    rows = asked.join(lists, "vector").select("query_id", F.filter(F.sort_array("list"), lambda e: e["vec_id"] != F.col("query_id")).alias("list"))
    rows = rows.select("query_id", F.posexplode(F.slice("list", 1, k)).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def _rows(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
