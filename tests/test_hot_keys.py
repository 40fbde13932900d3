"""Joins with a key that is hot on the left, hot on the right, null or blank."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins, merge, quantiles, windows

HOT = 30_000


@pytest.fixture
def splitting(spark):
    """Small data splits as large data would: low thresholds and no broadcasts."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(spark, hot, name, rows=HOT, other=400):
    """``rows`` rows with the key ``hot`` and ``other`` rows with keys of their own, over many tasks."""
    key = F.when(F.col("id") < rows, F.lit(hot)).otherwise((F.col("id") - rows).cast("string"))
    return spark.range(0, rows + other, 1, 16).select(key.alias("k"), F.col("id").alias(name), F.sha2(F.col("id").cast("string"), 256).alias(f"{name}_text"))


def ran(df):
    """The plan as it ran, and its row count."""
    n = df.count()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), n


def largest_share(df):
    """The largest share of the rows that one task made."""
    # All columns are asked for: Spark splits by bytes, and without them there would be hardly any.
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *[F.max(c) for c in df.columns]).collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("match", [joins.left_match, joins.full_match])
def test_hot_left(splitting, match):
    out = match(feed(splitting, "7", "a"), feed(splitting, "7", "b", rows=1), "k")
    plan, n = ran(out)
    assert "skew=true" in plan and n == 2 * (HOT + 1) + 399  # the key 7 has two rows on the right
    assert largest_share(out) < 0.5


@pytest.mark.parametrize("match", [joins.left_match, joins.full_match])
def test_hot_right(splitting, match):
    out = match(feed(splitting, "7", "a", rows=1), feed(splitting, "7", "b"), "k")
    plan, n = ran(out)
    assert "skew=true" in plan and n == 2 * (HOT + 1) + 399
    assert largest_share(out) < 0.5


@pytest.mark.parametrize("hot", [None, "", "  "])
def test_rows_without_a_key_meet_nobody(splitting, hot):
    a, b = feed(splitting, hot, "a"), feed(splitting, hot, "b")
    assert joins.full_match(a, b, "k").count() == 2 * HOT + 400
    assert joins.left_match(a, b, "k").count() == HOT + 400


def test_full_match_as_full_join(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "k string, a int")
    b = spark.createDataFrame([("x", 10), ("z", 11), (None, 12)], "k string, b int")
    want = a.join(b, "k", "full_outer").select("k", "a", "b")
    assert sorted(map(repr, joins.full_match(a, b, "k").collect())) == sorted(map(repr, want.collect()))


def claims(spark, an, pid):
    return spark.range(0, HOT, 1, 16).select(
        F.col("id").cast("string").alias("tran_id"), F.lit(None).cast("string").alias("hn"), an.alias("an"), pid.alias("pid"), F.lit(dt.date(2024, 1, 1)).alias("dateadm"), F.sha2(F.col("id").cast("string"), 256).alias("note")
    )


@pytest.mark.parametrize("kind", ["null", "blank", "hot"])
def test_waterfall_spreads_claims(splitting, kind):
    key = {"null": F.lit(None).cast("string"), "blank": F.lit(""), "hot": F.concat(F.lit("AN"), (F.col("id") % 1 + 1).cast("string"))}[kind]
    visits = splitting.createDataFrame([("h", dt.date(2024, 1, 1), "v")], "hn string, visit_date date, vn string")
    admissions = splitting.createDataFrame([("AN1", "va"), ("", "blank"), (None, "null")], "an string, vn string")
    patients = splitting.createDataFrame([("p", "h")], "pid string, hn string")
    out = joins.waterfall_match(claims(splitting, key, key), visits, admissions, patients)
    plan, n = ran(out)
    assert n == HOT and largest_share(out) < 0.5
    assert kind != "hot" or "skew=true" in plan
    assert {r.vn for r in out.select("vn").distinct().collect()} == ({"va"} if kind == "hot" else {None})


def test_persisted_match_splits_a_hot_statement(splitting):
    stm = feed(splitting, "7", "file_id").select(F.col("k").alias("tran_id"), "file_id", "file_id_text", F.lit(5).cast("decimal(12,2)").alias("total_compensation"))
    newest = windows.latest(feed(splitting, "7", "n", rows=2).select(F.col("k").alias("tran_id"), F.lit(5).cast("decimal(12,2)").alias("paid"), "n"), ["tran_id"], [F.desc("n")])
    out = joins.persist_match(stm, newest)
    plan, n = ran(out)
    assert "skew=true" in plan and n == HOT + 400 and out.filter("rep_matched").count() == n


def test_trailing_count_of_an_attack(spark):
    """Ten thousand tries in one second are put in order as one moment."""
    rows = spark.range(0, 10_000, 1, 8).select(F.lit("u").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3).alias("ts"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS user_id, current_timestamp() AS ts")).unionByName(spark.sql("SELECT 'w' AS user_id, CAST(NULL AS TIMESTAMP) AS ts"))
    out = windows.trailing_count(rows, "user_id", "ts", 2).groupBy("user_id", "ts").agg(F.min("n_recent").alias("a"), F.max("n_recent").alias("b")).collect()
    got = sorted((r.ts.second, r.a, r.b) for r in out if r.user_id == "u")
    assert [x[1:] for x in got] == [(3334, 3334), (6667, 6667), (6666, 6666)]
    assert [(r.a, r.b) for r in out if r.user_id != "u"] == [(0, 0), (0, 0)]


KEYS = ["fund", "grp"]


def test_null_key_parts_are_equal(spark):
    target = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, None, 3)], "fund string, grp string, v int")
    batch = spark.createDataFrame([("a", None, 10), ("a", None, 11), ("b", None, 12), (None, None, 13)], "fund string, grp string, v int")
    want = [("a", "x", 2), ("a", None, 11), ("b", None, 12), (None, None, 13)]
    for apply in (lambda t: merge.upsert(t, batch, KEYS, [F.desc("v")]), lambda t: merge.upsert_columns(t, batch, KEYS, ["v"], [F.desc("v")])):
        once = apply(target)
        assert sorted(map(tuple, once.collect()), key=repr) == sorted(want, key=repr)
        assert sorted(map(tuple, apply(once).collect()), key=repr) == sorted(want, key=repr)


def test_other_types_are_refused_by_exact_quantiles(spark):
    with pytest.raises(TypeError, match="double"):
        quantiles.exact_quantiles(spark.createDataFrame([(0.001,)], "v double"), "v", [0.5])
    with pytest.raises(TypeError, match="decimal"):
        quantiles.exact_quantiles(spark.createDataFrame([], "v decimal(30,2)"), "v", [0.5])


def test_quantiles_of_wide_values(spark):
    values = [-(10**15), -3, 0, 7, 10**15 + 1, 10**17]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert {r.prob: r.value for r in quantiles.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()} == {0.0: -1e15, 0.5: 3.5, 1.0: 1e17}
    cents = df.select((F.col("v").cast("decimal(38,0)") / 1000).cast("decimal(18,3)").alias("v"))
    assert {r.prob: r.value for r in quantiles.exact_quantiles(cents, "v", [0.5]).collect()} == {0.5: 0.0035}


def test_no_hint_and_few_scans(tables):
    plan = quantiles.distribution(tables.claims_core, "claim_drg")._jdf.queryExecution().toString()
    assert not re.search(r"strategy=broadcast", plan)
