"""Streams fed in several files, against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.session import fresh_path
from ledgerloom.streaming import jobs

SCHEMA = "id bigint, user_id string, action string, status string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def event(i, minute, user="u", action="LOGIN_FAILED"):
    return (i, user, action, "failed", T0 + dt.timedelta(minutes=minute))


@pytest.fixture()
def feed(spark):
    """A folder plus a function that adds one file of events to it."""
    folder = fresh_path(spark, "feed")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    return folder, add


def test_each_file_is_read_once(spark, feed):
    folder, add = feed
    out = fresh_path(spark, "out")
    run = lambda: jobs.ingest_stream(jobs.file_stream(spark, folder, SCHEMA), f"{out}/t", f"{out}/c", ["id"], [F.desc("ts")])
    add([event(1, 0), event(2, 0), event(1, 5)])
    run()
    run()
    add([event(2, 9), event(3, 1)])
    run()
    rows = {r.id: r.ts for r in jobs.current(spark, f"{out}/t", ["id"], [F.desc("ts")]).collect()}
    assert rows == {1: T0 + dt.timedelta(minutes=5), 2: T0 + dt.timedelta(minutes=9), 3: T0 + dt.timedelta(minutes=1)}
    assert spark.read.parquet(f"{out}/t").count() == 4
    small = jobs.compact(spark, f"{out}/t", ["id"], [F.desc("ts")])
    assert spark.read.parquet(small).count() == 3
    # The stream goes on in the compacted table with the checkpoint it has.
    add([event(2, 2), event(3, 7), event(4, 4)])
    jobs.ingest_stream(jobs.file_stream(spark, folder, SCHEMA), small, f"{out}/c", ["id"], [F.desc("ts")])
    minutes = {r.id: (r.ts - T0).total_seconds() / 60 for r in jobs.current(spark, small, ["id"], [F.desc("ts")]).collect()}
    assert minutes == {1: 5, 2: 9, 3: 7, 4: 4}
    # A new checkpoint reads everything again into folders of its own and loses nothing.
    jobs.ingest_stream(jobs.file_stream(spark, folder, SCHEMA), small, f"{out}/c2", ["id"], [F.desc("ts")])
    again = {r.id: (r.ts - T0).total_seconds() / 60 for r in jobs.current(spark, small, ["id"], [F.desc("ts")]).collect()}
    assert again == minutes


def test_late_event_is_dropped(spark, feed):
    folder, add = feed
    out = fresh_path(spark, "out")

    def run():
        stream = jobs.log_rates(jobs.file_stream(spark, folder, SCHEMA), "10 minutes", "10 minutes")
        jobs.run_available(stream, f"{out}/r", f"{out}/c")

    add([event(1, 1), event(2, 2)])
    run()
    add([event(3, 200)])
    run()
    add([event(4, 3), event(5, 400)])  # 4 belongs to a window long closed
    run()
    rows = {(r.window_start, r.events) for r in spark.read.parquet(f"{out}/r").collect()}
    assert rows == {(T0, 2), (T0 + dt.timedelta(minutes=200), 1)}


def test_bruteforce(spark):
    df = spark.createDataFrame([event(i, m) for i, m in enumerate((0, 5, 14, 60))] + [event(9, 6, "v"), event(10, 7, action="LOGIN")], SCHEMA)
    rows = jobs.bruteforce(df).collect()
    assert {r.user_id for r in rows} == {"u"} and {r.failures for r in rows} == {3}


def test_breaches_and_sessions(spark):
    df = spark.createDataFrame([event(i, i / 60) for i in range(12)] + [event(99, 300)], SCHEMA)
    assert [r.requests for r in jobs.breaches(df, 10).collect()] == [12]
    assert sorted(r.events for r in jobs.sessions(df).collect()) == [1, 12]


def test_archive_split(spark):
    df = spark.createDataFrame([event(1, 0), event(2, 60 * 24 * 40)], SCHEMA)
    old, live = jobs.archive_split(df, 30, T0 + dt.timedelta(days=41))
    assert [r.id for r in old.collect()] == [1] and [r.id for r in live.collect()] == [2]
