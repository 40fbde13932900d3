"""A random forest learned by levels: Spark counts labels for all open nodes at once and hands MLlib the finished trees.

MLlib's own learner keeps an object of several hundred bytes for each row and finds its node and counters in every tree
through maps, which takes 5 to 8 microseconds a row and tree.  Here a row is one byte a feature, and a task counts a block of rows
for one tree after the other with numpy.  The rest is as there: values fall into at most ``BINS`` bins, whose limits come from a
sample; a tree draws its rows with replacement and a node its features; a split must leave ``min_rows`` rows on either
side and gain something by Gini's measure; sibling leaves that predict the same become one.

What a task draws follows from the seed, its block and the tree, so a repeated task counts the same.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, send_code

BINS = 32
#: Rows that the limits of the bins are taken from, rows of a block at most, and rows that are counted at once.
SAMPLE, BLOCK, CHUNK = 10_000, 500_000, 1 << 16
_EVEN = 1e-16
#: How often a row is drawn, by 16 random bits: Poisson with mean 1.
_DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


class Level(NamedTuple):
    """What tasks know of one tree: its splits so far in heap order, the slots of open nodes and the features of each."""

    feature: np.ndarray
    cut: np.ndarray
    slot: np.ndarray
    features: np.ndarray


def limits(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Limits between bins of about equal weight; between all values if they are few."""
    value, place = np.unique(values, return_inverse=True)
    between = (value[:-1] + value[1:]) / 2
    if len(between) < bins:
        return between
    done, out = np.cumsum(np.bincount(place, weights)), []
    stride = done[-1] / bins
    target = stride
    for k in range(1, len(value)):
        if len(out) < bins - 1 and abs(done[k - 1] - target) < abs(done[k] - target):
            out.append(between[k - 1])
            target += stride
    return np.array(out)


def packed(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """(block, codes): for each row and feature a byte with the bin and, lowest, the label."""
    width, most = len(cuts), BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, done = [], 0, 0
        place = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place + done], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block", "codes"])

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            held.append(np.stack([np.searchsorted(c, x[:, f]).astype(np.uint8) << 1 | label for f, c in enumerate(cuts)], axis=1))
            n += len(label)
            if n >= most:
                yield block()
                held, n, done = [], 0, done + 1
        if n:
            yield block()

    return rows.mapInArrow(pack, "block long, codes binary")


def counts(codes: np.ndarray, width: int, drawn: np.ndarray, tree: Level) -> np.ndarray:
    """(feature, slot, bin, label) of open nodes: how many drawn rows of a block are there."""
    slots, tried = tree.features.shape
    depth = (len(tree.feature) + 1).bit_length() - 1
    out = np.zeros((tried, slots * BINS * 2))
    for begin in range(0, len(drawn), CHUNK):
        times = drawn[begin : begin + CHUNK]
        at = np.flatnonzero(times)
        row, weight = (at + begin) * width, times[at].astype(np.float64)
        node = np.zeros(len(at), np.int64)
        for _ in range(depth):
            right = codes.take(row + tree.feature.take(node)) > tree.cut.take(node)
            node = 2 * node + 1 + right
        slot = tree.slot.take(node - len(tree.feature))
        if (slot < 0).any():
            still = np.flatnonzero(slot >= 0)
            row, weight, slot = row[still], weight[still], slot[still]
        first = slot * (BINS * 2)
        for j in range(tried):
            out[j] += np.bincount(first + codes.take(row + tree.features[:, j].take(slot)), weight, slots * BINS * 2)
    return out.reshape(tried, slots, BINS, 2)


def impurity(labels: np.ndarray) -> np.ndarray:
    """Gini's measure of weights by label, which stand last; 0 where there is none."""
    whole = labels.sum(-1)
    return np.where(whole > 0, 1 - (labels**2).sum(-1) / np.where(whole > 0, whole, 1) ** 2, 0)


def best(found: np.ndarray, features: np.ndarray, weights: np.ndarray, min_rows: int) -> list[np.ndarray]:
    """For each slot: feature (below 0: none), bin and gain of the best split, labels on the left and in all."""
    left = np.cumsum(found, axis=2)[:, :, :-1]
    whole = found[0].sum(1)
    right = whole[None, :, None, :] - left
    share = (left * weights).sum(-1) / np.maximum((whole * weights).sum(-1), 1e-300)[None, :, None]
    gain = impurity(whole * weights)[None, :, None] - share * impurity(left * weights) - (1 - share) * impurity(right * weights)
    gain[(left.sum(-1) < min_rows) | (right.sum(-1) < min_rows)] = -1
    slots = np.arange(len(whole))
    place = gain.transpose(1, 0, 2).reshape(len(whole), -1).argmax(1)
    j, cut = place // (BINS - 1), place % (BINS - 1)
    gain = gain[j, slots, cut]
    feature = np.where(gain > 0, features[slots, j], -1)
    return [feature, cut, gain, *left[j, slots, cut].T, *whole.T]


_BEST = ["feature", "cut", "gain", "left0", "left1", "all0", "all1"]
BEST = "tree int, slot int, feature int, cut int, gain double, left0 double, left1 double, all0 double, all1 double"


def splits(blocks: DataFrame, levels: Sequence[Level | None], width: int, weights: np.ndarray, min_rows: int, seed: int) -> pa.Table:
    """The best split of every open node of all trees, by one pass over the blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, code in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer(code.as_buffer(), np.uint8)
                for tree, level in enumerate(levels):
                    if level is not None:
                        drawn = _DRAWN[np.random.Generator(np.random.SFC64([seed, block, tree])).integers(0, 1 << 16, len(codes) // width, np.uint16)]
                        found = counts(codes, width, drawn, level).astype(np.uint32)
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["tree", "counts"])

    def choose(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        slots, tried = levels[tree].features.shape
        found = np.zeros((tried, slots, BINS, 2))
        for one in table["counts"]:
            found += np.frombuffer(one.as_buffer(), np.uint32).reshape(found.shape)
        values = best(found, levels[tree].features, weights, min_rows)
        return pa.table({"tree": pa.array([tree] * slots, pa.int32()), "slot": pa.array(range(slots), pa.int32())} | {
            k: pa.array(v, pa.int32() if k in ("feature", "cut") else pa.float64()) for k, v in zip(_BEST, values, strict=True)
        })

    return blocks.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(choose, BEST).toArrow()


class Tree:
    """A tree that grows, in heap order: children of node ``i`` are ``2i + 1`` and ``2i + 2``."""

    def __init__(self, depth: int):
        n = (2 << depth) - 1
        self.feature, self.cut, self.gain, self.labels = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros((n, 2))
        self.open = np.zeros(1, np.int64)

    def level(self, k: int, width: int, tried: int, rng: np.random.Generator) -> Level | None:
        if not len(self.open):
            return None
        begin = (1 << k) - 1
        inner = self.feature[:begin] >= 0
        slot = np.full(1 << k, -1)
        slot[self.open - begin] = np.arange(len(self.open))
        features = np.sort(rng.permuted(np.tile(np.arange(width), (len(self.open), 1)), axis=1)[:, :tried], axis=1)
        # Past a leaf all rows go left, to a node without a slot.
        return Level(np.where(inner, self.feature[:begin], 0), np.where(inner, 2 * self.cut[:begin] + 1, 255).astype(np.uint8), slot, features)

    def split(self, found: dict[str, np.ndarray], weights: np.ndarray, min_rows: int, last: bool) -> None:
        own = self.open[found["slot"]]
        left, whole = (np.stack([found[f"{k}{y}"] for y in (0, 1)], axis=1) for k in ("left", "all"))
        self.labels[own] = whole
        does = found["feature"] >= 0
        own, left, right = own[does], left[does], (whole - left)[does]
        self.feature[own], self.cut[own], self.gain[own] = found["feature"][does], found["cut"][does], found["gain"][does]
        children, labels = np.concatenate([2 * own + 1, 2 * own + 2]), np.concatenate([left, right])
        self.labels[children] = labels
        grows = (impurity(labels * weights) > _EVEN) & (labels.sum(1) >= 2 * min_rows)
        self.open = np.sort(children[grows]) if not last else children[:0]

    def nodes(self, cuts: Sequence[np.ndarray], weights: np.ndarray) -> list[tuple]:
        """The rows that MLlib stores of a tree, parents first."""
        stats = self.labels * weights
        unequal, votes, out = impurity(stats), stats.argmax(1), []

        def leaf(i: int) -> bool:
            """Whether all below a node predict the same, so that it is stored as a leaf."""
            return self.feature[i] < 0 or (leaf(2 * i + 1) and leaf(2 * i + 2) and votes[2 * i + 1] == votes[2 * i + 2])

        def add(i: int) -> int:
            place = len(out)
            own = (float(votes[i]), float(unequal[i]), stats[i].tolist(), int(self.labels[i].sum()))
            if leaf(i):
                out.append((place, *own, -1.0, -1, -1, (-1, [], -1)))
            else:
                out.append(None)
                f = int(self.feature[i])
                out[place] = (place, *own, float(self.gain[i]), add(2 * i + 1), add(2 * i + 2), (f, [float(cuts[f][self.cut[i]])], -1))
            return place

        add(0)
        return out


_NODE = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"


def as_model(spark: SparkSession, trees: Sequence[list[tuple]], width: int, params: dict) -> RandomForestClassificationModel:
    """The trees as MLlib's model, by way of the files that it stores."""
    path = fresh_path(spark, "forest")

    def meta(kind: str, uid: str, params: dict, **more) -> str:
        names = {"predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction", "impurity": "gini", "maxBins": BINS, "leafCol": ""}
        text = {"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
        return json.dumps({**text, "paramMap": params, "defaultParamMap": names, **more})

    tag = uuid.uuid4().hex[:12]
    whole = meta("RandomForestClassificationModel", f"RandomForestClassifier_{tag}", params | {"numTrees": len(trees)}, numFeatures=width, numClasses=2, numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    own = [(k, meta("DecisionTreeClassificationModel", f"dtc_{tag}{k}", params), 1.0) for k in range(len(trees))]
    spark.createDataFrame(own, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(k, node) for k, nodes in enumerate(trees) for node in nodes], _NODE).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def grow(rows: DataFrame, label: str, features: str, weight: str, trees: int, depth: int, min_rows: int, seed: int) -> RandomForestClassificationModel:
    """Learn from rows that have a vector of numbers, a label of 0 or 1 and a weight that its label alone decides."""
    spark = rows.sparkSession
    send_code(spark)
    plain = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"))
    labels = {r.y: (r.n, r.w) for r in plain.groupBy("y").agg(F.count("*").alias("n"), F.max("w").alias("w")).collect()}
    n = sum(k for k, _ in labels.values())
    if not n:
        raise ValueError("a forest needs rows")
    weights = np.array([labels.get(y, (0, 0.0))[1] for y in (0, 1)])
    seen = (plain if n <= SAMPLE else plain.sample(False, SAMPLE / n, seed)).toArrow()
    x = seen["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(seen), -1)
    width = x.shape[1]
    cuts = [limits(x[:, f], seen["w"].to_numpy()) for f in range(width)]
    tried = math.ceil(math.sqrt(width)) if trees > 1 else width
    grown, rng = [Tree(depth) for _ in range(trees)], np.random.default_rng(seed)
    blocks = packed(plain, cuts).persist()
    try:
        for k in range(depth):
            levels = [tree.level(k, width, tried, rng) for tree in grown]
            if not any(levels):
                break
            found = splits(blocks, levels, width, weights, min_rows, seed).sort_by([("tree", "ascending"), ("slot", "ascending")])
            columns = {c: found[c].to_numpy() for c in found.column_names}
            ends = np.searchsorted(columns["tree"], np.arange(trees + 1))
            for tree, a, b in zip(grown, ends[:-1], ends[1:], strict=True):
                tree.split({c: v[a:b] for c, v in columns.items()}, weights, min_rows, k + 1 == depth)
    finally:
        blocks.unpersist()
    params = {"labelCol": label, "featuresCol": features, "weightCol": weight, "maxDepth": depth, "minInstancesPerNode": min_rows, "seed": seed}
    nodes = [tree.nodes(cuts, weights) for tree in grown]
    return as_model(spark, nodes, width, params)
