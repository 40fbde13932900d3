"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

from ledgerloom.operators import filters, windows
from ledgerloom.plans import reports
from ledgerloom.session import fresh_path
from ledgerloom.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(tables):
    text = plan(reports.monthly_trend(tables.claims_core))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:" in text
    assert "o_orderpriority" not in text
    assert text.count("FileScan") == 1


def test_filter_reaches_the_scan(tables):
    rows = filters.facets(tables.orders, o_orderstatus="F").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(rows)


def test_top_k_is_not_a_sort(tables):
    text = plan(reports.under_reimbursed(tables.claims_core))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_latest_is_limited_before_its_shuffle(tables):
    text = plan(windows.latest(tables.details_core, ["tran_id"], [F.desc("claim_amount")]))
    assert "Partial" in text and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_batches_need_one_shuffle_and_no_join(tables):
    from ledgerloom.operators.joins import reconcile_batches

    text = plan(reconcile_batches(tables.claims_core.withColumn("rep_no", F.col("hn")), tables.stm_core.withColumn("rep_no", F.col("hn"))))
    assert "Join" not in text and text.count("Exchange") == 1


def test_months_are_pruned(spark, tables):
    path = fresh_path(spark, "months")
    files.write_fact(tables.claims_core.select("tran_id", "dateadm"), path)
    assert "PartitionFilters: [isnotnull(month" in plan(files.read_months(spark, path, "1999-01", "1999-03"))
    facts = spark.read.parquet(path)
    year = filters.fiscal_year(facts, 2542)
    assert "(month" in re.search(r"PartitionFilters: \[([^\]]*)", plan(year))[1] and "1998-10" in plan(year)
    assert "1999-02" in re.search(r"PartitionFilters: \[([^\]]*)", plan(filters.date_range(facts, "1999-02-03")))[1]
    assert year.count() == filters.fiscal_year(tables.claims_core, 2542).count() > 0
    assert spark.read.parquet(path).count() == tables.claims_core.count()


def test_bucketed_feeds_join_without_a_shuffle(spark, tables):
    from ledgerloom.operators.joins import reconcile

    for name, df in (("b_claims", tables.claims_core), ("b_stm", tables.stm_core)):
        files.write_bucketed(df.drop("rep_no"), name, fresh_path(spark, name), "tran_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = reconcile(spark.table("b_claims"), spark.table("b_stm"))
        assert "Exchange" not in plan(rows)
        assert rows.count() == reconcile(tables.claims_core, tables.stm_core).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("b_claims", "b_stm"):
            spark.sql(f"DROP TABLE {name}")
