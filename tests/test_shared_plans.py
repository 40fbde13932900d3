"""What plans read and shuffle, counted after they have run."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins
from ledgerloom.plans import alerts
from ledgerloom.session import fresh_path


@pytest.fixture(scope="module")
def stored(spark, tables):
    """The two feeds as tables of their own, so that a scan is a scan."""
    path = fresh_path(spark, "feeds")
    tables.claims_core.withColumn("rep_no", F.col("file_id").cast("string")).write.parquet(f"{path}/claims")
    tables.stm_core.withColumn("rep_no", F.col("file_id").cast("string")).write.parquet(f"{path}/stm")
    return spark.read.parquet(f"{path}/claims"), spark.read.parquet(f"{path}/stm")


def final_plan(df) -> str:
    df._jdf.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.split(r"\+?-? ?== Initial Plan ==", text)[0]


def test_insights_read_the_facts_once(stored):
    plan = final_plan(alerts.insights(stored[0], dt.date(2001, 7, 15)))
    assert plan.count("FileScan parquet") == 1


def test_both_legs_of_a_match_share_their_exchange(spark, stored):
    claims, stm = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joins.reconcile(claims, stm)
        plan = final_plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Claims and statements go to the inner join and to the join that finds the rows alone from one shuffle each.
    assert plan.count("ReusedExchange") >= 2


@pytest.mark.parametrize("hot", ["claims", "statements"])
def test_existence_counts_with_a_hot_claim(spark, hot):
    rep = [("hot", float(i % 50)) for i in range(600 if hot == "claims" else 3)] + [(f"k{i}", 5.0) for i in range(30)] + [("none", 1.0), (None, 2.0)]
    pay = [("hot", float(i % 40) + 0.25) for i in range(4 if hot == "claims" else 900)] + [(f"k{i}", 5.0 if i % 2 else 9.0) for i in range(30)] + [(None, 2.0)]
    claims = spark.createDataFrame(rep, "tran_id string, x double").select("tran_id", F.col("x").cast("decimal(15,2)").alias("reimb_nhso"))
    stm = spark.createDataFrame(pay, "tran_id string, x double").select("tran_id", F.col("x").cast("decimal(15,2)").alias("paid_after_deduction"))
    got = joins.exists_counts(claims, stm).first()
    by = {}
    for k, x in pay:
        by.setdefault(k, []).append(x)
    near = sum(any(abs(x - y) < 1 for y in by.get(k, [])) for k, x in rep if k is not None)
    far = sum(any(abs(x - y) >= 1 for y in by.get(k, [])) for k, x in rep if k is not None)
    assert (got.total, got.matched, got.diff_amount) == (len(rep), near, far)


def test_reconciled_amounts_are_claimed_less_paid(spark):
    claims = spark.createDataFrame([("a", 10.0), ("b", 7.0), ("c", None), (" ", 3.0)], "tran_id string, x double").select("tran_id", F.lit("r").alias("rep_no"), F.lit("h").alias("hn"), F.col("x").cast("decimal(15,2)").alias("reimb_nhso"), F.lit(None).cast("date").alias("dateadm"), F.lit(None).cast("string").alias("error_code"))
    stm = spark.createDataFrame([("a", 4.0), ("d", 2.5), ("c", 0.0)], "tran_id string, x double").select("tran_id", F.lit("r").alias("rep_no"), F.lit("h").alias("hn"), F.col("x").cast("decimal(15,2)").alias("paid_after_deduction"), F.lit(None).cast("date").alias("date_admit"))
    got = {r.tran_id: (float(r.rep_amount), float(r.stm_amount), float(r["diff"]), r.status) for r in joins.reconcile(claims, stm).collect()}
    assert got == {"a": (10, 4, 6, "diff_amount"), "b": (7, 0, 7, "rep_only"), "c": (0, 0, 0, "matched"), "d": (0, 2.5, -2.5, "stm_only")}
    [batch] = joins.reconcile_batches(claims, stm).collect()
    assert (float(batch.rep_amount), float(batch.stm_amount), float(batch["diff"]), batch.status) == (20, 6.5, 13.5, "diff_amount")
