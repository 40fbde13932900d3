"""Keyed tables: what a merge writes, what it leaves, and what happens when it is lost or repeated."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.session import fresh_path
from ledgerloom.sources.keyed import KeyedTable
from ledgerloom.sources.manifests import Manifests
from ledgerloom.streaming import jobs

SCHEMA = "a string, b bigint, v bigint, w string"


def newest():
    return [F.desc("v")]


@pytest.fixture
def table(spark):
    def make(rows, buckets=32):
        df = spark.createDataFrame(rows, SCHEMA)
        out = KeyedTable.create(spark, fresh_path(spark, "keyed"), df.schema, ["a", "b"], buckets)
        out.merge(df, newest())
        return out

    return make


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def files_of(table):
    return {f: path for path in table.read().inputFiles() for f in [path.rsplit("/", 2)[-2]]}


def test_a_small_batch_writes_few_buckets(spark, table):
    rows = [(f"k{i}", i, i, "old") for i in range(300)]
    t = table(rows)
    before = files_of(t)
    assert len(before) == 32
    batch = spark.createDataFrame([("k7", 7, 1, "new"), ("k7", 7, 2, "newer"), ("k70", 70, 0, "new"), ("other", 1, 1, "new")], SCHEMA)
    assert t.merge(batch, newest()) <= 3
    after = files_of(t)
    assert 1 <= sum(after[b] != before[b] for b in before) <= 3 and set(after) == set(before)
    want = sorted([r for r in rows if r[1] not in (7, 70)] + [("k7", 7, 2, "newer"), ("k70", 70, 0, "new"), ("other", 1, 1, "new")], key=repr)
    assert content(t) == want
    t.merge(batch, newest())
    assert content(t) == want
    assert [tuple(r) for r in t.lookup(("k70", 70), ("none", 3)).collect()] == [("k70", 70, 0, "new")]
    assert len(t.lookup(("k70", 70)).inputFiles()) == 1


def test_null_parts_updates_and_late_rows(spark, table):
    t = table([(None, 1, 5, "x"), (None, None, 5, "y"), ("k", None, 5, "z")])
    t.merge(spark.createDataFrame([(None, 1, 9, "x2"), (None, None, 1, "y2"), ("k", 3, 1, "new")], SCHEMA), newest(), update=["v"])
    assert content(t) == sorted([(None, 1, 9, "x"), (None, None, 1, "y"), ("k", None, 5, "z"), ("k", 3, 1, "new")], key=repr)
    t.merge(spark.createDataFrame([(None, 1, 3, "late"), ("k", 3, 8, "in time")], SCHEMA), newest(), late=True)
    assert content(t) == sorted([(None, 1, 9, "x"), (None, None, 1, "y"), ("k", None, 5, "z"), ("k", 3, 8, "in time")], key=repr)
    assert t.merge(spark.createDataFrame([], SCHEMA), newest()) == 0


def test_batches_are_known_by_number(spark, table):
    t = table([("k", 1, 1, "a")])
    batch = spark.createDataFrame([("k", 1, 0, "b")], SCHEMA)
    assert t.merge(batch, newest(), source="s", number=4) == 1
    t.merge(spark.createDataFrame([("k", 1, 7, "c")], SCHEMA), newest(), source="other", number=1)
    assert t.merge(batch, newest(), source="s", number=4) == 0 and t.last_batch("s") == 4
    assert content(t) == [("k", 1, 7, "c")]


def test_a_lost_merge_leaves_the_old_state(spark, table, monkeypatch):
    t = table([(f"k{i}", i, i, "old") for i in range(20)])
    before = content(t)
    batch = spark.createDataFrame([(f"k{i}", i, 1, "new") for i in range(10)], SCHEMA)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Manifests, "publish", fail)
        with pytest.raises(OSError):
            t.merge(batch, newest())
    assert content(t) == before
    t.merge(batch, newest())
    assert sum(r[3] == "new" for r in content(t)) == 10
    now = content(t)
    assert t.vacuum() > 0 and content(t) == now and t.vacuum() == 0


def test_two_writers_do_not_overwrite_each_other(spark, table):
    t = table([("k", 1, 1, "a")])
    number, state = t.manifests.latest()
    t.merge(spark.createDataFrame([("k", 1, 2, "b")], SCHEMA), newest())
    with pytest.raises(RuntimeError):
        t.manifests.publish(number + 1, state)
    assert content(t) == [("k", 1, 2, "b")]
    with pytest.raises(ValueError):
        KeyedTable(spark, fresh_path(spark, "nothing")).read()


def test_stream_upserts_late_rows_and_survives_a_repeat(spark, monkeypatch):
    schema = "id bigint, v string, ts timestamp"
    folder, out = fresh_path(spark, "feed"), fresh_path(spark, "upserts")
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rng, best, table = random.Random(1), {}, None
    for part in range(3):
        rows = [(rng.randrange(40), f"{part}/{i}", at(rng.randrange(10**6))) for i in range(60)]
        for r in rows:
            best[r[0]] = max(best.get(r[0], r), r, key=lambda x: x[2])
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        table = table or KeyedTable.create(spark, f"{out}/t", df.schema, ["id"], 8)
        run = lambda: jobs.upsert_stream(jobs.file_stream(spark, folder, df.schema), table, f"{out}/c", [F.desc("ts")])  # noqa: B023, E731
        if part == 1:  # the batch is published, but the stream ends before it knows
            real = KeyedTable.merge

            def merge_and_die(self, *a, real=real, **k):
                real(self, *a, **k)
                raise OSError("lost")

            with monkeypatch.context() as m:
                m.setattr(KeyedTable, "merge", merge_and_die)
                with pytest.raises(Exception, match="lost"):
                    run()
        run()
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(best.values())
