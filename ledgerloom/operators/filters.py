"""Filters, searches, pages and status columns."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.money import _c, is_error, ratio, zero
from ..functions.text import digits_key, like_escape, pad, strip0
from .windows import latest


def _in_days(df: DataFrame, lo: dt.date | None, hi: dt.date | None, col: str) -> DataFrame:
    """Rows between two days.  A fact table in month folders (``sources.files.write_fact``) is also cut by
    folder, so other months are not even listed."""
    by_month = col == "dateadm" and dict(df.dtypes).get("month") == "string"
    for day, keeps in ((lo, lambda c, x: c >= x), (hi, lambda c, x: c <= x)):
        if day is not None:
            df = df.filter(keeps(F.col(col).cast("date"), F.lit(day)))
            if by_month:
                df = df.filter(keeps(F.col("month"), F.lit(day.strftime("%Y-%m"))))
    return df


def fiscal_year(df: DataFrame, fy: int, col: str = "dateadm", to_current: dt.date | None = None) -> DataFrame:
    """Rows of one fiscal year by a Gregorian date or timestamp (compared as a date)."""
    first, last = fiscal.bounds(fy, to_current)
    return _in_days(df, first, last, col)


def fiscal_year_be(df: DataFrame, fy: int, col: str = "posting_date", to_current: dt.date | None = None) -> DataFrame:
    """Rows of one fiscal year by a Buddhist-era ``yyyyMMdd`` text; the text range reaches the scan."""
    first, last = fiscal.bounds_be(fy, to_current)
    return df.filter(F.col(col).between(first, last))


def fiscal_months(df: DataFrame, fy: int, first: int, last: int, col: str = "dateadm") -> DataFrame:
    lo, hi = fiscal.month_bounds(fy, first, last)
    return _in_days(df, lo, hi, col)


def fiscal_months_be(df: DataFrame, fy: int, first: int, last: int, col: str = "posting_date") -> DataFrame:
    lo, hi = fiscal.month_bounds(fy, first, last)
    return df.filter(F.col(col).between(fiscal.be_text(lo), fiscal.be_text(hi)))


def checked_date(text: str | None) -> dt.date | None:
    """A ``YYYY-MM-DD`` argument, or None when it is not one."""
    if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            return None
    return None


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "dateadm") -> DataFrame:
    """Open or closed range; an invalid bound is ignored."""
    return _in_days(df, checked_date(start), checked_date(end), col)


def statement_fy(df: DataFrame, fy: int, year: str = "statement_year", month: str = "statement_month") -> DataFrame:
    """Statements of a fiscal year by Buddhist-era year and month numbers."""
    at = F.col(year) * 12 + F.col(month)
    return df.filter(at.between((fy - 1) * 12 + 10, fy * 12 + 9))


def facets(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on the given columns; ``EMPTY`` selects null or blank, None is no filter."""
    for col, value in wanted.items():
        if value is None:
            continue
        if value == "EMPTY":
            df = df.filter(F.col(col).isNull() | (F.col(col) == ""))
        else:
            df = df.filter(F.col(col) == (value.upper() if col in ("main_inscl", "ptype") else value))
    return df


def by_status(df: DataFrame, status: str = "all") -> DataFrame:
    if status in ("denied", "error"):
        return df.filter(is_error())
    return df.filter(~is_error()) if status == "success" else df


def search(df: DataFrame, term: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive "contains" over several columns; wildcards in the term are literal."""
    pattern = f"%{like_escape(term)}%"
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(F.col(col).ilike(pattern), F.lit(False))
    return df.filter(hit)


def search_all(feeds: Mapping[str, tuple[DataFrame, Sequence[str], str, str]], term: str, k: int = 50) -> DataFrame:
    """The first ``k`` hits in each feed.  A feed is (rows, searched columns, key, amount)."""
    parts = []
    for source, (df, cols, key, amount) in feeds.items():
        hits = search(df, term, cols).select(
            F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), F.col(amount).alias("amount")
        )
        parts.append(hits.orderBy("key", "amount").limit(k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page(df: DataFrame, page: int = 1, per_page: int = 50, sort: str = "dateadm", order: str = "desc", allowed: Sequence[str] = (), key: Sequence[str] = ("tran_id",)) -> DataFrame:
    """One page with the totals beside each row.

    A sort column outside ``allowed`` falls back to the first allowed one.  ``key`` makes the order
    total.  The page is a top-k, never a full sort.
    """
    if allowed and sort not in allowed:
        sort = allowed[0]
    lead = F.col(sort).desc() if order.lower() == "desc" else F.col(sort).asc()
    n = df.agg(F.count("*")).scalar()
    rows = df.orderBy(lead, *[F.col(k) for k in key]).offset((page - 1) * per_page).limit(per_page)
    return rows.withColumn("total", n).withColumns(
        {
            "total_pages": F.ceil(F.col("total") / per_page).cast("bigint"),
            "has_next": F.col("total") > page * per_page,
            "has_prev": F.lit(page > 1),
        }
    )


def lookup(df: DataFrame, code: str, short: str = "hcode5", long: str = "hcode9") -> DataFrame:
    """Rows whose short code is ``code`` (as given or padded to five) or whose long code is or ends with it."""
    return df.filter(F.col(short).isin(code, code.zfill(5)) | (F.col(long) == code) | F.col(long).endswith(code))


def vendor_eq(df: DataFrame, code: str, col: str = "vendor_no") -> DataFrame:
    """Vendor equality on digits only, whatever the padding."""
    return df.filter(digits_key(col) == int(re.sub(r"\D", "", code)))


def same_vendor(code: str, col: str = "vendor_no") -> Column:
    return strip0(col) == code.lstrip("0")


def vendor10(col: Column | str) -> Column:
    return pad(col, 10)


def secure(df: DataFrame, role: str | None, hospital: str | None, col: str = "hcode") -> DataFrame:
    """Row access: an admin or a session without a role sees all, others their own hospital."""
    if role is None or role == "admin":
        return df
    return df.filter(F.col(col) == F.lit(hospital))


def is_aged_unpaid(days: int, as_of: dt.date, only_clean: bool = False) -> Column:
    old = F.col("dateadm") < F.date_sub(F.lit(as_of), days)
    return old & (zero("paid") == 0) & (~is_error() if only_clean else F.col("claim_drg") > 0)


def aged_unpaid(df: DataFrame, days: int, as_of: dt.date, only_clean: bool = False) -> DataFrame:
    """Claims still unpaid ``days`` before ``as_of``."""
    return df.filter(is_aged_unpaid(days, as_of, only_clean))


def user_activity(audit: DataFrame, user: str, days: int, as_of: dt.datetime, k: int) -> DataFrame:
    since = F.lit(as_of - dt.timedelta(days=days))
    rows = audit.filter((F.col("user_id") == user) & (F.col("ts") >= since))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(k)


def with_status(df: DataFrame) -> DataFrame:
    """Visit kind, pass/fail and the row's own reimbursement rate."""
    return df.withColumns(
        {
            "visit": F.when(F.col("an").isNotNull() & (F.col("an") != ""), "IPD").otherwise("OPD"),
            "outcome": F.when(is_error(), "fail").otherwise("pass"),
            "reimb_rate": ratio(zero("paid"), zero("claim_drg"), 1),
        }
    )


# Display labels.
SERVICE_LABELS = {
    "": "ไม่ระบุ",
    "E": "ฉุกเฉิน (E)",
    "R": "ส่งต่อ (R)",
    "P": "ป้องกัน (P)",
    "A": "อุบัติเหตุ (A)",
    "C": "เรื้อรัง (C)",
    "N": "ทั่วไป (N)",
}


def label(c: Column | str, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Code to label; an unknown code keeps itself unless a default is given."""
    code = _c(c)
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.lit(default) if default else code)
