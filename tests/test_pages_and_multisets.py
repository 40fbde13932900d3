"""Keyset pages, multiset comparisons and exact trailing counts on a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merge, multisets
from ledgerloom.operators.pages import Cursor, beyond, cursor_after, keyset_page, page_totals
from ledgerloom.operators.windows import trailing_count
from ledgerloom.session import fresh_path
from ledgerloom.streaming import jobs
from ledgerloom.streaming.trailing import TrailingCounts


@pytest.mark.parametrize("sort", [[("a", False), ("b", True)], [("a", True), ("b", False)], [("b", True)]])
def test_walking_all_pages_gives_each_row_once(spark, sort):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), i) for i in range(40)]  # ties and nulls everywhere
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(3)
    seen, cursor, keys = [], None, [c for c, _ in sort]
    while page := keyset_page(df, sort, 7, cursor).collect():
        seen += page
        cursor = cursor_after(page, sort, cursor)
    assert [tuple(r[k] for k in keys) for r in seen] == [tuple(r[k] for k in keys) for r in df.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in sort]).collect()]
    if len(sort) == 2:
        assert len(seen) == 40
    assert cursor_after([], sort, cursor) == cursor and keyset_page(df, sort, 7, cursor).collect() == []
    assert page_totals(df.where("i < 0"), 7).first()[:] == (0, 0) and page_totals(df, 7).first()[:] == (40, 6)


def test_the_bound_of_a_page_reaches_the_scan(spark):
    path = fresh_path(spark, "sorted")
    spark.range(100_000).selectExpr("id AS a", "id % 7 AS b").coalesce(1).sortWithinPartitions("a").write.option("parquet.block.size", 1 << 16).option("parquet.page.row.count.limit", 1000).parquet(path)
    df = spark.read.parquet(path)
    late = keyset_page(df, [("a", False)], 50, Cursor((90_000,)))
    assert [r.a for r in late.collect()] == list(range(90_001, 90_051))
    plan = df.where(beyond([("a", False)], Cursor((90_000,))))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,90000)" in plan
    down = df.where(beyond([("a", True), ("b", False)], Cursor((10, 3))))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(a,10)" in down


ROWS = [("rep", "a", 1), ("rep", "b", 2), ("rep", "b", 2), ("stm", "c", None), ("stm", None, 3), (None, "d", 4)]


@pytest.mark.parametrize(
    "change,group,kind",
    [
        (lambda r: r[1:], "rep", "fewer"),
        (lambda r: r + [r[1]], "rep", "more"),
        (lambda r: [("rep", "a", 9)] + r[1:], "rep", "changed"),
        (lambda r: [("rep", "b", 2)] + r[1:], "rep", "changed"),  # as many rows, but one stands for another
        (lambda r: r[:3] + [("stm", None, 3), ("stm", "c", 3)] + r[5:], "stm", "changed"),
        (lambda r: r[:5], None, "missing"),
        (lambda r: r + [("smt", "e", 5)], "smt", "added"),
        (lambda r: r[:3] + [("stm", None, None), ("stm", "c", 3)] + r[5:], "stm", "changed"),  # values moved between rows
    ],
)
def test_each_fault_of_a_migration_is_reported(spark, change, group, kind):
    schema = "download_type string, filename string, size int"
    before = spark.createDataFrame(ROWS, schema).repartition(3)
    assert multisets.differences(before, spark.createDataFrame(ROWS[::-1], schema), ["download_type"], ["filename", "size"]).collect() == []
    after = spark.createDataFrame(change(list(ROWS)), schema)
    [found] = multisets.differences(before, after, ["download_type"], ["filename", "size"]).collect()
    assert (found.download_type, found.difference) == (group, kind)
    report = {r.download_type: r for r in multisets.validated(before, after, ["download_type"], ["filename", "size"], ["rep", "smt"]).collect()}
    assert [k for k, r in report.items() if not r.match] == [group] and report[group].difference == kind
    assert {"rep", "smt"} <= set(report)


def test_fingerprints_do_not_depend_on_order(spark):
    df = spark.createDataFrame(ROWS, "k string, b string, c int")
    a = {tuple(r) for r in multisets.fingerprints(df.repartition(4), ["k"], ["b", "c"]).collect()}
    assert a == {tuple(r) for r in multisets.fingerprints(df.orderBy("b"), ["k"], ["b", "c"]).collect()} and len(a) == 3


def test_migration_by_mode(spark):
    history = spark.createDataFrame([([("f1", "rep", 10), ("f2", None, None), ("f1", "rep", 12), (None, "x", 1)],)], "downloads array<struct<name:string,type:string,size:bigint>>")
    ledger = spark.createDataFrame([("f1", "stm", 1, True), ("f9", "smt", 9, False)], "filename string, download_type string, file_size bigint, file_exists boolean")
    skip = {r.filename: (r.download_type, r.file_size) for r in merge.migrate_history(history, ledger).collect()}
    assert skip == {"f1": ("stm", 1), "f2": ("rep", 0), "f9": ("smt", 9)}
    update = {r.filename: (r.download_type, r.file_size, r.file_exists) for r in merge.migrate_history(history, ledger, "update").collect()}
    assert update == {"f1": ("rep", 12, True), "f2": ("rep", 0, None), "f9": ("smt", 9, False)}


def test_trailing_counts_on_a_stream(spark, monkeypatch):
    """Several files, late rows, a repeated micro-batch: as the batch operator over all that came in time."""
    schema = "id bigint, user string, ts timestamp"
    t0, rng = dt.datetime(2024, 1, 1), random.Random(5)
    folder, out = fresh_path(spark, "feed"), fresh_path(spark, "trailing")
    counts, every, newest = None, [], t0
    for part in range(4):
        rows = []
        for i in range(40):
            at = t0 + dt.timedelta(minutes=part * 30 + rng.randrange(30) - (25 if i % 5 == 0 else 0), microseconds=rng.choice([0, 0, 1]))
            rows.append((part * 100 + i, rng.choice(["hot", "hot", "a", None]), at))
        if part == 3:
            rows.append((999, "hot", t0))  # later than the delay allows
        every += rows[:40]
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        counts = counts or TrailingCounts(spark, out, df.schema, "user", "ts", 900, 3600)
        if part == 2:
            real = TrailingCounts._step

            def step_and_die(self, *a, real=real):
                real(self, *a)
                raise OSError("lost")

            with monkeypatch.context() as m:
                m.setattr(TrailingCounts, "_step", step_and_die)
                with pytest.raises(Exception, match="lost"):
                    counts.run(jobs.file_stream(spark, folder, df.schema), f"{out}-c")
        counts.run(jobs.file_stream(spark, folder, df.schema), f"{out}-c")
        newest = max(newest, *[r[2] for r in rows])
        open_ = {r[0] for r in every} - {r.id for r in counts.read().collect()}
        assert open_ == {r[0] for r in every if r[2] > newest - dt.timedelta(hours=1)}
    counts.close()
    want = trailing_count(spark.createDataFrame(every, schema), "user", "ts", 900)
    assert sorted(tuple(r) for r in counts.read().select("id", "n_recent").collect()) == sorted(tuple(r) for r in want.select("id", "n_recent").collect())
    assert counts.late() == 1
