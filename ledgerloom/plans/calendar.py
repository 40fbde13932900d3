"""The date dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fiscal

# Thai month names by number.
THAI_MONTHS = {
    1: "มกราคม", 2: "กุมภาพันธ์", 3: "มีนาคม", 4: "เมษายน", 5: "พฤษภาคม", 6: "มิถุนายน",
    7: "กรกฎาคม", 8: "สิงหาคม", 9: "กันยายน", 10: "ตุลาคม", 11: "พฤศจิกายน", 12: "ธันวาคม",
}

# Thai public holidays with a fixed date (MM-dd).
HOLIDAYS = {
    "01-01": "วันขึ้นปีใหม่",
    "04-06": "วันจักรี",
    "05-01": "วันแรงงานแห่งชาติ",
    "05-04": "วันฉัตรมงคล",
    "07-28": "วันเฉลิมพระชนมพรรษาพระบาทสมเด็จพระเจ้าอยู่หัว",
    "08-12": "วันเฉลิมพระชนมพรรษาสมเด็จพระนางเจ้าฯ พระบรมราชินี",
    "10-13": "วันคล้ายวันสวรรคตพระบาทสมเด็จพระบรมชนกาธิเบศร มหาภูมิพลอดุลยเดชมหาราช บรมนาถบพิตร",
    "10-23": "วันปิยมหาราช",
    "12-05": "วันคล้ายวันพระบรมราชสมภพพระบาทสมเด็จพระบรมชนกาธิเบศร มหาภูมิพลอดุลยเดชมหาราช บรมนาถบพิตร",
    "12-10": "วันรัฐธรรมนูญ",
    "12-31": "วันสิ้นปี",
}


def _pick(names: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def describe(days: DataFrame, col: str = "full_date", sunday_zero: bool = False) -> DataFrame:
    """Calendar attributes of a frame of dates.  Weekdays count from Monday = 0, or Sunday = 0."""
    d = F.col(col)
    monday = F.weekday(d)
    dow = F.pmod(monday + 1, F.lit(7)) if sunday_zero else monday
    holiday = _pick(HOLIDAYS, F.date_format(d, "MM-dd"))
    month = F.month(d)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_id"), d.alias("full_date"), dow.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"), month.alias("month_number"), F.date_format(d, "MMMM").alias("month_name"),
        _pick(THAI_MONTHS, month).alias("month_name_th"), F.quarter(d).alias("quarter"), F.year(d).alias("year"),
        (fiscal.fiscal_year(d) - fiscal.ERA).alias("fiscal_year"), fiscal.fiscal_quarter(d).cast("int").alias("fiscal_quarter"),
        (monday >= 5).alias("is_weekend"), holiday.isNotNull().alias("is_holiday"), holiday.alias("holiday_name"),
    )


def date_dimension(spark: SparkSession, start: dt.date, end: dt.date, sunday_zero: bool = False) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("full_date"))
    return describe(days, sunday_zero=sunday_zero)


def date_dimension_for(df: DataFrame, col: str) -> DataFrame:
    """The calendar of every day from the first to the last date in a column."""
    span = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).filter("a IS NOT NULL")
    return describe(span.select(F.explode(F.sequence("a", "b")).alias("full_date")))


def extend(dim: DataFrame, year: int) -> DataFrame:
    """Rows of the dates up to the end of ``year`` that the dimension lacks."""
    first = dim.agg(F.min("full_date").alias("a"))
    days = first.select(F.explode(F.sequence("a", F.lit(dt.date(year, 12, 31)))).alias("full_date"))
    return describe(days.join(dim.select("full_date"), "full_date", "left_anti"))


def listing(dim: DataFrame, month: int | None = None, year_be: int | None = None, quarter: int | None = None, fy_be: int | None = None) -> DataFrame:
    """Filtered calendar with Buddhist-era texts, newest first."""
    rows = dim
    for col, value in (("month_number", month), ("quarter", quarter)):
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    if year_be is not None:
        rows = rows.filter(F.col("year") == year_be - fiscal.ERA)
    if fy_be is not None:
        rows = rows.filter(F.col("fiscal_year") == fy_be - fiscal.ERA)
    return rows.withColumns(
        {
            "date_be": F.concat(F.date_format("full_date", "dd/MM/"), (F.col("year") + fiscal.ERA).cast("string")),
            "year_be": F.col("year") + fiscal.ERA,
            "fiscal_year_be": F.col("fiscal_year") + fiscal.ERA,
        }
    ).orderBy(F.desc("full_date"))


def coverage(dim: DataFrame) -> DataFrame:
    span = F.datediff(F.max("full_date"), F.min("full_date")) + 1
    return dim.agg(F.min("full_date").alias("first"), F.max("full_date").alias("last"), F.count("*").alias("rows"), span.alias("covered_days"))
