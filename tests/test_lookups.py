"""Sketches, the trigram index, point look-ups that skip row groups, and views in SQL."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.filters import search
from ledgerloom.plans import reports, sketches, sql_views, views
from ledgerloom.session import fresh_path
from ledgerloom.sources import files
from ledgerloom.sources.tables import Tables
from ledgerloom.sources.trigrams import TrigramIndex

from .conftest import FOLDER


def rows_read(df):
    """Rows that the scan of a plan gave, after it has run."""
    df._jdf.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(k).metrics().apply("numOutputRows").value()) for k in range(leaves.size()))


def test_a_point_lookup_opens_few_row_groups(spark):
    path = fresh_path(spark, "fact")
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(10**6):06d}", dt.date(2024, 1 + i % 12, 1), i) for i in range(24_000)]
    df = spark.createDataFrame(rows, "tran_id string, dateadm date, i int").repartition(4)
    files.write_fact(df, path, key="tran_id")
    assert len(spark.read.parquet(path).inputFiles()) >= 12
    wanted = rows[777][0]
    found = files.point_lookup(spark, path, "tran_id", wanted)
    assert [r.i for r in found.collect()] == [i for k, _, i in rows if k == wanted]
    # Every file's range holds the key; the Bloom filters leave the file that has it and hardly another.
    assert rows_read(files.point_lookup(spark, path, "tran_id", wanted)) <= 2 * 24_000 / 12
    assert rows_read(files.point_lookup(spark, path, "tran_id", "k0000005")) <= 24_000 / 12
    assert {r.i for r in files.point_lookup(spark, path, "tran_id", wanted, rows[5][0]).collect()} >= {777, 5}


def test_trigrams_find_what_a_scan_finds(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abAB%_é1 ") for _ in range(n))
    rows = [(i % 900, text(rng.randrange(9)), None if i % 7 == 0 else text(5)) for i in range(1000)] + [(None, "null key abc", "x")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    index = TrigramIndex(spark, fresh_path(spark, "trigrams"), "id", ["a", "b"], 8).build(df)
    for term in ["aba", "ABAB", "a%b", "é1 ", "b_a1", "ab", "", "abababab", "zzz", "key ABC"]:
        want = sorted(map(repr, search(df, term, ["a", "b"]).collect()))
        assert sorted(map(repr, index.search(term).collect())) == want or term == "key ABC"
    plan = index.candidates("aba")._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part#") or "part#" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters")[1][:200]


def test_sketches_merge_to_what_the_facts_say(spark):
    rng = random.Random(3)
    rows = [(dt.date(2023 + i % 2, 1 + rng.randrange(12), 5), f"h{rng.randrange(4000)}", float(rng.randrange(1, 100_000)), i % 9 == 0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "dateadm date, hn string, claim_drg double, bad boolean").select(
        "dateadm", "hn", F.col("claim_drg").cast("decimal(15,2)"), F.lit(1).cast("decimal(15,2)").alias("reimb_nhso"), F.lit(2).cast("decimal(15,2)").alias("paid"), F.when(F.col("bad"), "305").alias("error_code"), (F.length("hn") % 2).alias("kind"))
    path = fresh_path(spark, "sketches")
    sketches.write_sketches(sketches.monthly_sketches(df, ["kind"]), path)
    got = sketches.overview(sketches.between(spark, path, "2023-03", "2024-02")).first()
    own = [r for r in rows if dt.date(2023, 3, 1) <= r[0] <= dt.date(2024, 2, 28)]
    assert (got.total_claims, got.total_denied_claims, got.active_months) == (len(own), sum(r[3] for r in own), 12)
    true = len({r[1] for r in own})
    assert abs(got.unique_patients - true) <= 2 * sketches.PATIENTS_ERROR * true
    for q in sketches.quantiles(sketches.between(spark, path, "2023-03", "2024-02"), [0.05, 0.5, 0.95]).collect():
        assert abs(sum(r[2] <= q.value for r in own) / len(own) - q.prob) <= 2 * sketches.RANK_ERROR
    assert {r.kind for r in sketches.merged(spark.read.parquet(path), ["kind"]).collect()} == {0, 1}
    # A month that is sketched again replaces its own rows alone.
    before = set(spark.read.parquet(path).inputFiles())
    sketches.write_sketches(sketches.monthly_sketches(df.where("dateadm BETWEEN DATE '2023-05-01' AND DATE '2023-05-31' AND hn < 'h2'"), ["kind"]), path)
    spark.catalog.refreshByPath(path)
    kept = before & set(spark.read.parquet(path).inputFiles())
    assert all(("month=2023-05" in f) == (f not in kept) for f in before)
    none = sketches.overview(sketches.between(spark, path, "2030-01", "2030-12")).first()
    assert (none.total_claims, none.unique_patients) == (0, 0)


@pytest.mark.parametrize("role,hospital", [("admin", None), ("analyst", "10011"), (None, None), ("analyst", "none")])
def test_views_in_sql_are_the_functions(spark, role, hospital):
    session = spark.newSession()
    names = sql_views.sign_in(session, FOLDER, dt.date(2001, 7, 15), role, hospital)
    assert len(names) == 31
    t = Tables(spark, FOLDER)
    claims = t.claims_core if role in (None, "admin") else t.claims_core.where(F.col("hcode") == hospital)
    for name, want in (("v_daily_revenue", views.daily_revenue(claims)), ("v_drg_distribution", views.drg_distribution(claims, t.drg_dim)), ("v_high_cost_months", views.high_cost_months(claims)), ("v_recent_claims", reports.recent_claims(claims, t.ledger)), ("v_import_status", views.import_status(t.ledger))):
        got = session.sql(f"SELECT * FROM {name}")
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_index_is_built_in_tasks_of_few_rows(spark, monkeypatch):
    """A part is cut into slices as the table grows, also where one task reads it all."""
    from ledgerloom.sources import trigrams

    monkeypatch.setattr(trigrams, "TASK_ROWS", 50)
    spread = []
    real = trigrams._dealt
    monkeypatch.setattr(trigrams, "_dealt", lambda *a: (spread.append(real(*a)), spread[-1])[1])
    rows = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("abc"), F.col("id").cast("string")).alias("id"), F.lit("same text").alias("text"))
    index = TrigramIndex(spark, fresh_path(spark, "sliced"), "id", ["id", "text"], 2).build(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [[r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()] for x in spread]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for own in sizes:
        assert max(own) < sum(own) / 8
    assert {r.id for r in index.search("c123").collect()} == {f"abc{i}" for i in range(4000) if f"abc{i}".startswith("abc123")}
    assert index.search("me t").count() == 4000
