"""Codes and clusters of vectors against plain rounds over all pairs."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm.clusters import Centroids, clustered, vector_clusters
from ledgerloom.llm.codes import Books, compress, decode, vector_codes
from ledgerloom.llm.lattice import squared

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, own int, near double, cluster long, entry int, code string"


@pytest.fixture
def vectors(spark):
    """Vectors from (vec_id, components, label), with columns whose names the operators use too."""

    def make(rows, parts=3):
        return spark.createDataFrame([(i, x, k, "v", 1, 0.5, 7, 2, "c") for i, x, k in rows], SCHEMA).repartition(parts)

    return make


def floors(x, scale):
    return [int(np.floor(scale * float(np.float32(c)))) for c in x]


def far(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))


def whole(x):
    return x is not None and all(c is not None and np.isfinite(c) for c in x)


def rounds_of(points, begin, rounds):
    """(assignment, entries) by comparing every point with every entry."""
    entries = [list(e) for e in begin]

    def nearest():
        return [min(range(len(entries)), key=lambda k: (far(p, entries[k]), k)) for p in points]

    for _ in range(rounds):
        own = nearest()
        for k in range(len(entries)):
            mine = [p for p, o in zip(points, own, strict=True) if o == k]
            if mine:
                entries[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return nearest(), entries


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(c)) for c in r[1]]))


def expected_codes(rows, parts, k, rounds, scale):
    kept = [r for r in rows if whole(r[1]) and r[1] and len(r[1]) % parts == 0]
    kept = [r for r in kept if len(r[1]) == len(by_id(kept)[0][1])]
    width = len(kept[0][1]) // parts
    books, codes, errors = [], [""] * len(kept), [0] * len(kept)
    first = [floors(r[1], scale) for r in by_id(kept)[:k]]
    for p in range(parts):
        points = [floors(r[1], scale)[p * width : (p + 1) * width] for r in kept]
        own, entries = rounds_of(points, [f[p * width : (p + 1) * width] for f in first], rounds)
        books += [c for e in entries for c in e]
        for n, o in enumerate(own):
            codes[n] += f"{o:02x}"
            errors[n] += far(points[n], entries[o])
    seal = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((str(r[0]), c, e, total[r[2]], seal) for r, c, e in zip(kept, codes, errors, strict=True))


def sample(seed, n, length, spread=1.0, steps=None):
    """Rows around a few places; with ``steps`` components lie on a coarse grid, so that ties abound."""
    rng = random.Random(seed)
    bases = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(5)]
    rows = []
    for i in range(n):
        x = [b + rng.gauss(0, spread) for b in rng.choice(bases)]
        if steps:
            x = [round(c * steps) / steps for c in x]
        rows.append((i * 7 % 1001, x, rng.choice([0, 1, 2, None])))
    return rows


ODD = [(2000, None, 1), (2001, [], 1), (2002, [1.0, None] * 4, 2), (2003, [float("nan")] * 8, 0), (2004, [float("inf")] * 8, 0), (2005, [1.0] * 5, 1)]


@pytest.mark.parametrize("steps", [None, 2])
def test_codes_as_by_all_pairs(vectors, steps):
    rows = sample(3, 160, 8, 0.5, steps)
    rows += rows[:3] + [(None, rows[5][1], None), (5, rows[9][1], 1)] + ODD + [(2006, [0.5] * 12, 1)]
    got = vector_codes(vectors(rows), parts=4, entries=9, rounds=5, scale=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected_codes(rows, 4, 9, 5, 16)


def test_few_rows_empty_table_and_decoding(vectors):
    rows = sample(4, 3, 4)
    assert sorted((str(r[0]), *r[1:]) for r in vector_codes(vectors(rows), parts=2, entries=8, rounds=2, scale=256).collect()) == expected_codes(rows, 2, 8, 2, 256)
    coded, books = compress(vectors(rows), parts=2, entries=8, rounds=0, scale=256)
    back = {r.vec_id: r.vector for r in decode(coded, books).collect()}
    assert back == {i: floors(x, 256) for i, x, _ in rows}  # every row is an entry
    for odd in ([], ODD[:5]):
        assert vector_codes(vectors(odd)).collect() == [] and vector_clusters(vectors(odd)).collect() == []
    with pytest.raises(ValueError):
        compress(vectors(rows), entries=257)


def test_bounds_spare_comparisons_and_lists_adapt():
    """Over many rounds: exact, most parts settled without a scan, lists cut to what is needed."""
    rng = np.random.default_rng(5)
    points = (rng.normal(0, 1, (6, 4))[rng.integers(0, 6, 4000)] * 300 + rng.normal(0, 40, (4000, 4))).astype(np.int64)
    part = np.zeros(4000, np.int64)
    books = Books(points[:32][None].copy())
    own, _, near, bounds = books.all_compared(points, part, 8)
    scans = 0
    for _ in range(12):
        total = np.stack([np.bincount(own, points[:, k], 32) for k in range(4)], axis=1)
        many = np.bincount(own, minlength=32)
        entries = books.entries.copy()
        entries[0, many > 0] = np.floor(total[many > 0] / many[many > 0, None]).astype(np.int64)
        books = books.moved(entries)
        own, error, near, bounds, need = books.bounded(points, part, own, near, bounds)
        apart = squared(points, books.entries[0])
        assert (own == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
        exact = np.sqrt(apart)
        listed = np.concatenate([own[:, None], near], axis=1)
        for z in range(bounds.shape[1]):  # each bound holds for all entries from its place on
            rest = exact.copy()
            np.put_along_axis(rest, listed[:, : z + 1], np.inf, axis=1)
            assert (bounds[:, z] <= rest.min(axis=1)).all()
        scans += int((need > near.shape[1]).sum())
        near, bounds = near[:, : max(2, near.shape[1] - 1)], bounds[:, : max(2, near.shape[1] - 1) + 1].astype(np.float32)
        bounds = np.nextafter(bounds, np.float32(-np.inf))
    assert scans < 0.25 * 12 * 4000


def expected_clusters(rows, k, rounds, scale, length, seed):
    kept = [r for r in rows if whole(r[1]) and len(r[1]) == length]
    hashes = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), [float(np.float32(c)) for c in r[1]]))
    points = [floors(r[1], scale) for r in kept]
    own, places = rounds_of(points, [floors(r[1], scale) for r in hashes[:k]], rounds)
    away = [far(p, places[o]) for p, o in zip(points, own, strict=True)]
    inertia = [sum(a for a, o in zip(away, own, strict=True) if o == c) for c in range(len(places))]
    seals = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return sorted((str(r[0]), o, a, inertia[o], sum(away), seals[o]) for r, o, a in zip(kept, own, away, strict=True))


@pytest.mark.parametrize("steps,k", [(None, 6), (1, 5), (2, 1)])
def test_clusters_as_by_all_pairs(vectors, steps, k):
    rows = sample(6, 150, 8, 0.7, steps)
    rows += rows[:3] + [(None, rows[5][1], None), (None, rows[6][1], 2)] + ODD
    got = vector_clusters(vectors(rows), centroids=k, rounds=6, scale=8, length=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected_clusters(rows, k, 6, 8, 8, 3)


def test_equal_vectors_and_more_centroids_than_rows(vectors):
    rows = [(i, [0.25] * 8, 0) for i in range(12)] + [(20, [1.0] * 8, 0)]
    got = vector_clusters(vectors(rows), rounds=3, length=8)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected_clusters(rows, 8, 3, 1024, 8, 3)
    assigned, inertia, places = clustered(vectors(rows[:2]), rounds=3, length=8)
    assert len(places) == 2 and {r.cluster for r in assigned.collect()} == {0} and inertia.count() == 1


@given(st.integers(0, 10**6), st.integers(2, 9), st.sampled_from([3, 40, 900]))
def test_search_finds_the_two_nearest_from_any_memory(seed, k, reach):
    """Whatever was remembered, as long as it was true before the centroids moved."""
    rng = np.random.default_rng(seed)
    points, places = rng.integers(-reach, reach, (60, 3)), rng.integers(-reach, reach, (k, 3))
    before = Centroids(places)
    cluster, second, upper, lower = before.first(points)
    for _ in range(3):
        now = before.moved(before.places + rng.integers(-reach // 3, reach // 3 + 1, (k, 3)))
        cluster, second, upper, lower, measured = now.search(points, cluster, second, upper, lower)
        apart = squared(points, now.places)
        assert (cluster == apart.argmin(axis=1)).all()
        rest = np.sqrt(apart)
        assert (upper >= rest.min(axis=1)).all()
        np.put_along_axis(rest, cluster[:, None], np.inf, axis=1)
        assert (lower <= rest.min(axis=1)).all() and (second != cluster).all()
        before = now


def test_search_measures_few_when_little_moves():
    rng = np.random.default_rng(2)
    places = rng.integers(-1000, 1000, (16, 4))
    points = places[rng.integers(0, 16, 3000)] + rng.integers(-90, 90, (3000, 4))
    now = Centroids(places)
    held = now.first(points)
    measured = now.moved(places + rng.integers(-3, 4, places.shape)).search(points, *held)[-1]
    assert measured < 0.2 * 16 * 3000
