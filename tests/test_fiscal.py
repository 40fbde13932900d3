"""Golden fiscal-year examples and calendar edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fiscal
from ledgerloom.operators import filters


def test_bounds():
    assert fiscal.bounds(2569) == (dt.date(2025, 10, 1), dt.date(2026, 9, 30))
    assert fiscal.bounds(2569, dt.date(2026, 1, 18)) == (dt.date(2025, 10, 1), dt.date(2026, 1, 18))
    assert fiscal.bounds_be(2569) == ("25681001", "25690930")
    assert fiscal.bounds_be(2569, dt.date(2026, 1, 18)) == ("25681001", "25690118")


@pytest.mark.parametrize("day, fy", [((2026, 1, 18), 2569), ((2025, 10, 15), 2569), ((2025, 9, 25), 2568), ((2025, 9, 30), 2568), ((2025, 10, 1), 2569)])
def test_fiscal_year_of(spark, day, fy):
    assert fiscal.fiscal_year_of(dt.date(*day)) == fy
    row = spark.createDataFrame([(dt.date(*day),)], "d date").select(fiscal.fiscal_year("d"), fiscal.fiscal_quarter("d")).first()
    assert row[0] == fy
    assert row[1] == {10: 1, 1: 2, 9: 4}[day[1]]


def test_labels(spark):
    row = spark.range(1).select(fiscal.fy_label(F.lit(2569)), fiscal.fy_label(F.lit(2569), "en")).first()
    assert row[0] == "ปีงบประมาณ 2569 (1 ต.ค. 2568 - 30 ก.ย. 2569)"
    assert row[1] == "FY 2569 (1 Oct 2025 - 30 Sep 2026)"


def test_month_bounds():
    assert fiscal.month_bounds(2569, 10, 2) == (dt.date(2025, 10, 1), dt.date(2026, 2, 28))
    assert fiscal.month_bounds(2567, 2, 2) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert fiscal.months_be(2569)[0] == "256810" and fiscal.months_be(2569)[-1] == "256909"


def test_buddhist_dates(spark):
    rows = spark.createDataFrame([("25680122",), ("2568",), ("25681301",), ("25670229",), (None,)], "t string")
    got = [r[0] for r in rows.select(fiscal.be_to_date("t")).collect()]
    assert got == [dt.date(2025, 1, 22), None, None, dt.date(2024, 2, 29), None]


def test_last_day_counts_whole(spark):
    rows = spark.createDataFrame([(dt.datetime(2025, 9, 30, 23, 59),), (dt.datetime(2025, 10, 1),), (dt.datetime(2024, 10, 1),), (None,)], "dateadm timestamp")
    assert filters.fiscal_year(rows, 2568).count() == 2


def test_invalid_bounds_are_ignored(spark):
    rows = spark.createDataFrame([(dt.date(2025, 1, 1),), (dt.date(2026, 1, 1),)], "dateadm date")
    assert filters.date_range(rows, "2025-13-01", "x").count() == 2
    assert filters.date_range(rows, "2025-06-01").count() == 1
