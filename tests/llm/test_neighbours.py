import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours as nn


def test_curve_visits_every_cell_once_and_steps_to_a_neighbour():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = nn.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q, a in good.items():
        if q % every == 0:
            scored = sorted((-math.fsum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good.items() if i != q and len(a) == len(b))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df, every, k, **options):
    rows = nn.nearest(df, F.pmod("vec_id", F.lit(every)) == 0, k, **options).collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, rank int, query_id string").repartition(3)

    return make


def test_edges(vectors):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    hot = rng.standard_normal(6).tolist()
    rows += [(100 + i, hot) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (None, hot), (0, rows[0][1]), (10, [1e300] * 6), (300, [1.0, 2.0]), (302, [2.0, 1.0]), (303, [])]
    rows = [r for r in rows if r[0] != 10] + [(10, rng.standard_normal(6).tolist())]
    assert found(vectors(rows), 10, 5) == brute(rows, 10, 5)
    assert found(vectors(rows[:3]), 1, 5) == brute(rows[:3], 1, 5)
    assert found(vectors([]), 10, 5) == []


def test_clustered_vectors_need_few_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(nn, "DATA_BLOCK", 64)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16)) * 10
    rows = [(i, (centres[i % 30] + rng.standard_normal(16) * 0.01).tolist()) for i in range(1500)]
    assert found(vectors(rows), 50, 10) == brute(rows, 50, 10)


def test_recall_of_windows_alone(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact = {(r[0], r[2]) for r in found(df, 20, 20)}
    windows = {(r[0], r[2]) for r in found(df, 20, 20, widen=False)}
    assert len(exact & windows) >= 0.9 * len(exact)
