"""The forest that is learned by levels, against plain counting and MLlib's own."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerloom.plans import forest


@pytest.fixture(scope="module")
def rows(spark):
    """Two features that tell, one that does not, one that is always the same; a quarter of the labels is 1."""
    c, id_ = F.col, F.col("id")
    plain = spark.range(0, 6000, 1, 5).select(
        (F.pmod(F.hash(id_), F.lit(1000)) / 10).alias("a"), F.pmod(F.hash(id_ + 7), F.lit(6)).cast("double").alias("b"),
        F.pmod(F.hash(id_ + 9), F.lit(50)).cast("double").alias("c"), F.lit(3.0).alias("d"), id_,
    )
    label = ((c("a") > 60) & (c("b") != 2) | (F.pmod(F.hash(id_ + 1), F.lit(20)) == 0)).cast("int")
    out = plain.withColumn("y", label).withColumn("w", F.when(label == 1, 2.5).otherwise(1.0))
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(out).persist()


def grown(rows, **more):
    return forest.grow(rows, "y", "features", "w", **{"trees": 12, "depth": 5, "min_rows": 2, "seed": 4, **more})


def test_limits_are_between_values():
    rng = np.random.default_rng(1)
    assert forest.limits(np.array([3.0, 1.0, 1.0, 7.0]), np.ones(4)).tolist() == [2.0, 5.0]
    assert forest.limits(np.zeros(9), np.ones(9)).tolist() == []
    values = rng.normal(size=4000)
    cuts = forest.limits(values, np.ones(4000))
    sizes = np.bincount(np.searchsorted(cuts, values))
    assert len(sizes) == forest.BINS and sizes.min() > 100 and sizes.max() < 150


def test_a_row_is_a_byte_a_feature(rows, monkeypatch):
    """MLlib keeps an object a row and a counter for each of its trees."""
    monkeypatch.setattr(forest, "BLOCK", 700)
    plain = rows.select(forest.vector_to_array("features").alias("x"), "y", F.col("w"))
    blocks = forest.packed(plain, [np.array([10.0, 60.0]), np.array([1.5]), np.array([]), np.array([])]).collect()
    assert sum(len(r.codes) for r in blocks) == 4 * 6000 and len({r.block for r in blocks}) == len(blocks) >= 5
    codes = np.concatenate([np.frombuffer(r.codes, np.uint8).reshape(-1, 4) for r in blocks])
    found = sorted(map(tuple, codes.tolist()))
    assert found == sorted(((2 * ((r.a > 10) + (r.a > 60)) + r.y, 2 * (r.b > 1.5) + r.y, r.y, r.y) for r in rows.collect()))


def test_counts_are_those_of_a_plain_loop(monkeypatch):
    monkeypatch.setattr(forest, "CHUNK", 64)
    rng = np.random.default_rng(5)
    codes, drawn = rng.integers(0, 64, (300, 3)).astype(np.uint8), rng.integers(0, 4, 300).astype(np.uint8)
    # Node 1 is a leaf; of nodes 3 to 6 only 6 and 5 are open.
    level = forest.Level(np.array([1, 0, 2]), np.array([21, 255, 41], np.uint8), np.array([-1, -1, 0, 1]), np.array([[0, 2], [1, 2]]))
    truth = np.zeros((2, 2, forest.BINS, 2))
    for row, times in zip(codes, drawn, strict=True):
        if row[1] // 2 > 10:
            slot = int(row[2] // 2 > 20)
            for j, f in enumerate(level.features[slot]):
                truth[j, slot, row[f] // 2, row[f] % 2] += times
    assert (forest.counts(codes.ravel(), 3, drawn, level) == truth).all()


def test_best_split_is_that_of_all():
    rng = np.random.default_rng(6)
    found, features, weights = rng.integers(0, 5, (2, 4, forest.BINS, 2)).astype(float), np.array([[0, 1], [1, 3], [0, 2], [2, 3]]), np.array([1.0, 3.0])
    found[1] = found[1] * 0 + found[0][:, rng.permutation(forest.BINS)]
    found[:, 3] = 0
    found[:, 3, 4, 1] = 9  # one label, nothing to gain
    gini = lambda x: 1 - sum((v / sum(x)) ** 2 for v in x) if sum(x) else 0
    feature, cut, gain, *_ = forest.best(found, features, weights, 3)
    for s in range(4):
        every = {}
        for j, k in itertools.product(range(2), range(forest.BINS - 1)):
            left, whole = found[j, s, : k + 1].sum(0), found[j, s].sum(0)
            if left.sum() >= 3 and (whole - left).sum() >= 3:
                a, b, all_ = left * weights, (whole - left) * weights, whole * weights
                every[j, k] = gini(all_) - (a.sum() * gini(a) + b.sum() * gini(b)) / all_.sum()
        most = max(every.values(), default=0)
        if most <= 0:
            assert feature[s] < 0
        else:
            assert gain[s] == pytest.approx(most) and every[features[s].tolist().index(feature[s]), cut[s]] == pytest.approx(most)


def test_draws_are_poisson():
    share = np.bincount(forest._DRAWN, minlength=6)[:4] / (1 << 16)
    assert share == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=1e-4) and forest._DRAWN.mean() == pytest.approx(1, abs=1e-4)


def test_learns_as_well_as_mllib(rows):
    train, test = rows.filter("id % 5 > 0"), rows.filter("id % 5 = 0")
    judge = BinaryClassificationEvaluator(labelCol="y")
    own = judge.evaluate(grown(train).transform(test))
    theirs = judge.evaluate(RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="w", numTrees=12, maxDepth=5, minInstancesPerNode=2, seed=4).fit(train).transform(test))
    assert own > 0.85 and own > theirs - 0.03


def test_model_is_whole(rows):
    model = grown(rows)
    assert model.getNumTrees == 12 and model.numFeatures == 4 and model.numClasses == 2 and model.getMaxDepth() == 5
    assert all(0 < tree.depth <= 5 for tree in model.trees)
    weights = model.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1) and weights[0] > weights[2] and weights[3] == 0
    shares = model.transform(rows).select(forest.vector_to_array("probability").alias("p")).collect()
    assert all(sum(r.p) == pytest.approx(1) for r in shares)


def test_odd_labels(spark, rows):
    alone = grown(rows.filter("y = 0"), trees=2)
    assert alone.totalNumNodes == 2 and alone.transform(rows).filter("prediction <> 0").count() == 0
    few = grown(rows.limit(3), trees=3)
    assert few.transform(rows).count() == 6000
    with pytest.raises(ValueError, match="rows"):
        grown(rows.filter("y > 1"))
