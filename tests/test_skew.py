"""Ordered operators against brute force, with one key holding most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quantiles, windows

T0 = dt.datetime(2024, 1, 1)


def events(seed, n=400):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), T0 + dt.timedelta(seconds=rnd.randrange(0, 20_000), microseconds=rnd.choice([0, 0, 1]))) for _ in range(n)]


@pytest.mark.parametrize("seconds", [60, 900, 7200])
def test_trailing_count(spark, seconds):
    rows = events(seconds)
    got = sorted((r.u, r.ts, r.n_recent) for r in windows.trailing_count(spark.createDataFrame(rows, "u string, ts timestamp"), "u", "ts", seconds).collect())
    want = sorted((u, t, sum(1 for v, s in rows if v == u and t - dt.timedelta(seconds=seconds) < s <= t)) for u, t in rows)
    assert got == want


def test_window_edge(spark):
    at = [T0, T0 + dt.timedelta(minutes=14, seconds=59), T0 + dt.timedelta(minutes=15), T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=2)]
    got = sorted((r.ts, r.n_recent) for r in windows.trailing_count(spark.createDataFrame([("u", t) for t in at], "u string, ts timestamp"), "u", "ts", 900).collect())
    assert [n for _, n in got] == [1, 2, 2, 2, 2]


@pytest.mark.parametrize("gap", [30, 300])
def test_gap_sessions(spark, gap):
    rows = events(gap)
    got = sorted((r.u, r.session_start, r.session_end, r.events) for r in windows.gap_sessions(spark.createDataFrame(rows, "u string, ts timestamp"), "u", "ts", gap).collect())
    want = []
    for u in sorted({u for u, _ in rows}):
        times = sorted(t for v, t in rows if v == u)
        start, last, n = times[0], times[0], 1
        for t in times[1:]:
            if t - last < dt.timedelta(seconds=gap):
                last, n = t, n + 1
            else:
                want.append((u, start, last + dt.timedelta(seconds=gap), n))
                start, last, n = t, t, 1
        want.append((u, start, last + dt.timedelta(seconds=gap), n))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_fill_down(spark, block):
    rnd = random.Random(block)
    rows = [(f, i, rnd.choice([None, None, None, "m", "n"])) for f, size in (("big", 300), ("small", 5), ("none", 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "f string, i int, v string")
    got = sorted((r.f, r.i, r.w) for r in windows.fill_down(df, "f", "i", F.col("v"), "w", "-", block).collect())
    want, last = [], {}
    for f, i, v in rows:
        last[f] = v or last.get(f)
        want.append((f, i, last[f] or "-"))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles(spark, seed):
    rnd = random.Random(seed)
    values = [round(rnd.choice([rnd.uniform(-500, 500), rnd.uniform(0, 5_000_000), 12.5]), 2) for _ in range(rnd.choice([1, 2, 37, 500]))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select(F.col("v").cast("decimal(12,2)").alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.prob: r.value for r in quantiles.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-6)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v decimal(12,2)"), "v", [0.5]).count() == 0


def test_approximate_distribution_is_close(spark, tables):
    exact, near = quantiles.distribution(tables.claims_core, "claim_drg").first(), quantiles.distribution(tables.claims_core, "claim_drg", approx=True).first()
    assert near.median == pytest.approx(exact.median, rel=0.02) and near.q3 == pytest.approx(exact.q3, rel=0.02)


def test_latest_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("a", 1)], "k string, n int").repartition(4)
    assert sorted(map(tuple, windows.latest(df, ["k"], [F.desc("n")]).collect())) == [("a", 1), ("hot", 499)]
