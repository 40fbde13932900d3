"""Buddhist-era dates and the fiscal year that starts on 1 October.

Fiscal year *n* (Buddhist era) runs from 1 Oct *n*-544 to 30 Sep *n*-543 (Gregorian).
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import _c

ERA = 543
# Calendar months in fiscal order.
FISCAL_MONTHS = (10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8, 9)


def month_of(c: Column | str) -> Column:
    return F.trunc(_c(c), "MM")


def ym(c: Column | str) -> Column:
    return F.date_format(_c(c), "yyyy-MM")


def minus_months(c: Column | str, n: int) -> Column:
    return F.add_months(_c(c), -n)


def minus_days(c: Column | str, n: int) -> Column:
    return F.date_sub(_c(c), n)


def be_to_date(c: Column | str) -> Column:
    """``yyyyMMdd`` in the Buddhist era to a date; null when malformed or impossible."""
    text = _c(c)
    year = F.lpad((F.substring(text, 1, 4).try_cast("int") - ERA).cast("string"), 4, "0")
    iso = F.concat(year, F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2))
    return F.when(text.rlike(r"^\d{8}$"), iso.try_cast("date"))


def to_be_month(c: Column | str) -> Column:
    """Date to ``yyyyMM`` text in the Buddhist era."""
    return F.concat((F.year(_c(c)) + ERA).cast("string"), F.date_format(_c(c), "MM"))


def to_be_date(c: Column | str) -> Column:
    return F.concat((F.year(_c(c)) + ERA).cast("string"), F.date_format(_c(c), "MMdd"))


def be_month_to_ym(c: Column | str) -> Column:
    """``yyyyMM`` (Buddhist era) to Gregorian ``yyyy-MM``; null unless six characters long."""
    text = _c(c)
    year = F.substring(text, 1, 4).try_cast("int") - ERA
    return F.when(F.length(text) == 6, F.concat(year.cast("string"), F.lit("-"), F.substring(text, 5, 2)))


def be_month_label(c: Column | str) -> Column:
    text = _c(c)
    return F.when(F.length(text) == 6, F.concat(F.substring(text, 5, 2), F.lit("/"), F.substring(text, 1, 4))).otherwise(text)


def fiscal_year(c: Column | str) -> Column:
    d = _c(c)
    return F.year(d) + F.when(F.month(d) >= 10, ERA + 1).otherwise(ERA)


def fiscal_year_be(c: Column | str) -> Column:
    """Fiscal year of a Buddhist-era ``yyyyMM[dd]`` text."""
    text = _c(c)
    year, month = F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 2).try_cast("int")
    return F.when(F.length(text) >= 6, year + F.when(month >= 10, 1).otherwise(0))


def fiscal_quarter(c: Column | str) -> Column:
    return F.pmod(F.quarter(_c(c)), F.lit(4)) + 1


def fy_label(fy: Column, lang: str = "th") -> Column:
    start = fy - 1
    if lang == "th":
        text = ["ปีงบประมาณ ", fy, " (1 ต.ค. ", start, " - 30 ก.ย. ", fy, ")"]
    else:
        text = ["FY ", fy, " (1 Oct ", start - ERA, " - 30 Sep ", fy - ERA, ")"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in text])


def bounds(fy: int, to_current: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """First and last day of a fiscal year; ``to_current`` replaces the last day."""
    return dt.date(fy - ERA - 1, 10, 1), to_current or dt.date(fy - ERA, 9, 30)


def be_text(day: dt.date) -> str:
    return f"{day.year + ERA}{day:%m%d}"


def bounds_be(fy: int, to_current: dt.date | None = None) -> tuple[str, str]:
    first, last = bounds(fy, to_current)
    return be_text(first), be_text(last)


def month_bounds(fy: int, first: int, last: int) -> tuple[dt.date, dt.date]:
    """Days covered by calendar months ``first``..``last`` of a fiscal year."""

    def year_of(month: int) -> int:
        return fy - ERA - (1 if month >= 10 else 0)

    y1, y2 = year_of(first), year_of(last)
    return dt.date(y1, first, 1), dt.date(y2, last, calendar.monthrange(y2, last)[1])


def fiscal_year_of(day: dt.date) -> int:
    return day.year + ERA + (1 if day.month >= 10 else 0)


def months_be(fy: int) -> list[str]:
    """The twelve ``yyyyMM`` months of a fiscal year in fiscal order."""
    return [f"{fy - 1 if m >= 10 else fy}{m:02d}" for m in FISCAL_MONTHS]
