"""Filters, searches, pages, status columns, sorts and set operations."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import filters, joins, pages, windows
from ..operators.pages import Cursor
from ..plans import bookkeeping, reports, sql_views
from ..session import fresh_path
from ..sources import files
from ..sources.trigrams import TrigramIndex
from .base import AS_OF, AS_OF_SQL, ERR, FY, FY_FROM, FY_TO, IS_IP, OK, d, n, query, rt, rtn, s, txt

_ROWS = f"tran_id, {txt('dateadm')} AS dateadm, {d('claim_drg')} AS claim_drg"
_COLS = ["tran_id", "dateadm", "claim_drg"]


@query("fil01_fiscal_year", f"SELECT {_ROWS} FROM claims_core WHERE claims_core.dateadm BETWEEN {FY_FROM} AND {FY_TO}")
def _(t):
    return filters.fiscal_year(t.claims_core, FY).select(*_COLS)


@query("fil01_fiscal_year_to_date", f"SELECT {_ROWS} FROM claims_core WHERE claims_core.dateadm BETWEEN DATE '2000-10-01' AND {AS_OF_SQL}")
def _(t):
    return filters.fiscal_year(t.claims_core, 2544, to_current=AS_OF).select(*_COLS)


@query("fil02_fiscal_year_be", f"SELECT ref_doc_no, vendor_no, posting_date, {d('total_amount')} AS total_amount FROM transfers_core WHERE posting_date BETWEEN '25411001' AND '25420930'")
def _(t):
    return filters.fiscal_year_be(t.transfers_core, FY).select("ref_doc_no", "vendor_no", "posting_date", "total_amount")


@query("fil03_fiscal_months", f"SELECT {_ROWS} FROM claims_core WHERE claims_core.dateadm BETWEEN DATE '1998-12-01' AND DATE '1999-02-28'")
def _(t):
    return filters.fiscal_months(t.claims_core, FY, 12, 2).select(*_COLS)


@query("fil04_date_range", f"SELECT {_ROWS} FROM claims_core WHERE claims_core.dateadm >= DATE '2000-02-29'")
def _(t):
    return filters.date_range(t.claims_core, "2000-02-29", "2000-13-01").select(*_COLS)


@query("fil05_statement_fy", "SELECT file_id, filename FROM stm_files WHERE (statement_year = 2567 AND statement_month >= 10) OR (statement_year = 2568 AND statement_month <= 9)")
def _(t):
    return filters.statement_fy(t.stm_files, 2568).select("file_id", "filename")


@query("fil06_facets", f"SELECT {_ROWS} FROM claims WHERE scheme = 'UCS' AND main_inscl = 'OFC' AND ptype = 'OP' AND (service_type IS NULL OR service_type = '')")
def _(t):
    return filters.facets(t.claims, scheme="UCS", main_inscl="ofc", ptype="op", service_type="EMPTY", hn=None).select(*_COLS)


@query("fil07_by_status", f"SELECT 'denied' AS status, {n(ERR)} AS n FROM claims_core UNION ALL SELECT 'success', {n(OK)} FROM claims_core UNION ALL SELECT 'all', count(*) FROM claims_core")
def _(t):
    def one(w):
        return filters.by_status(t.claims_core, w).agg(F.lit(w).alias("status"), F.count("*").alias("n"))

    return joins.stack([one("denied"), one("success"), one("all")])


@query("fil08_search", f"SELECT {_ROWS} FROM claims_core WHERE contains(lower(tran_id), 'an77') OR contains(lower(hn), 'an77') OR contains(lower(an), 'an77')")
def _(t):
    return filters.search(t.claims_core, "An77", ["tran_id", "hn", "an"]).select(*_COLS)


_INDEXED = ["tran_id", "hn", "an"]


def _trigrams(t):
    return TrigramIndex(t.spark, fresh_path(t.spark, "trigrams"), "tran_id", _INDEXED, 16).build(t.claims_core.select("tran_id", "hn", "an", "dateadm", "claim_drg"))


for _name, _term in (("fil08_indexed", "An77"), ("fil08_indexed_digits", "123"), ("fil08_indexed_short", "77")):

    @query(_name, f"SELECT {_ROWS} FROM claims_core WHERE " + " OR ".join(f"contains(lower({c}), '{_term.lower()}')" for c in _INDEXED))
    def _(t, term=_term):
        return _trigrams(t).search(term).select(*_COLS)


@query("fil09_search_all", f"""SELECT * FROM (SELECT 'rep' AS source, tran_id AS key, {d('reimb_nhso')} AS amount FROM claims_core WHERE contains(tran_id, '123') OR contains(hn, '123') ORDER BY key, amount LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'stm', tran_id AS key, {d('paid_after_deduction')} AS amount FROM stm_core WHERE contains(tran_id, '123') OR contains(hn, '123') ORDER BY key, amount LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'smt', ref_doc_no AS key, {d('total_amount')} AS amount FROM transfers_core WHERE contains(ref_doc_no, '123') ORDER BY key, amount LIMIT 50)""")
def _(t):
    return filters.search_all(
        {
            "rep": (t.claims_core, ["tran_id", "hn"], "tran_id", "reimb_nhso"),
            "stm": (t.stm_core, ["tran_id", "hn"], "tran_id", "paid_after_deduction"),
            "smt": (t.transfers_core, ["ref_doc_no"], "ref_doc_no", "total_amount"),
        },
        "123",
    )


@query("fil10_page", f"""SELECT {_ROWS}, (SELECT count(*) FROM claims_core WHERE {ERR}) AS total, CAST(ceil((SELECT count(*) FROM claims_core WHERE {ERR}) / 40.0) AS BIGINT) AS total_pages,
  true AS has_next, true AS has_prev FROM claims_core WHERE {ERR} ORDER BY claims_core.claim_drg DESC NULLS LAST, tran_id LIMIT 40 OFFSET 80""")
def _(t):
    rows = filters.by_status(t.claims_core, "denied").select(*_COLS)
    return filters.page(rows, 3, 40, "claim_drg", "desc", ["dateadm", "claim_drg"])


_SORT = [("claim_drg", True), ("dateadm", False), ("tran_id", False)]
_BY = "claim_drg DESC NULLS LAST, dateadm ASC NULLS FIRST, tran_id ASC"


@query("fil10_keyset_page", f"""SELECT {_ROWS} FROM claims_core WHERE {ERR} AND (claims_core.claim_drg < 50000 OR (claims_core.claim_drg = 50000 AND (claims_core.dateadm > DATE '1997-03-01'
  OR (claims_core.dateadm = DATE '1997-03-01' AND claims_core.tran_id > '5')))) ORDER BY {_BY.replace("claim_drg", "claims_core.claim_drg").replace("dateadm", "claims_core.dateadm")} LIMIT 40""")
def _(t):
    rows = filters.by_status(t.claims_core, "denied").select(*_COLS)
    return pages.keyset_page(rows, _SORT, 40, pages.Cursor((Decimal("50000.00"), dt.date(1997, 3, 1), "5"), 0))


@query("fil10_keyset_walk", f"SELECT tran_id, CAST((row_number() OVER (ORDER BY {_BY}) - 1) // (SELECT (count(*) + 4) // 5 FROM claims_core WHERE {ERR}) AS INT) AS page FROM claims_core WHERE {ERR}")
def _(t):
    """All rows in five pages, each found by the last row of the one before."""
    rows = filters.by_status(t.claims_core, "denied").select(*[c for c, _ in _SORT])
    size = (rows.count() + 4) // 5
    out, cursor = None, None
    for number in range(5):
        page = pages.keyset_page(rows, _SORT, size, cursor).withColumn("page", F.lit(number))
        last = page.orderBy(*[F.col(c).asc_nulls_first() if down else F.col(c).desc_nulls_last() for c, down in _SORT]).limit(1).collect()
        cursor = pages.cursor_after(last, _SORT, cursor)
        out = page if out is None else out.unionByName(page)
    return out.select("tran_id", "page")


@query("fil10_totals", f"SELECT count(*) AS total, CAST(ceil(count(*) / 40.0) AS BIGINT) AS total_pages FROM claims_core WHERE {ERR}")
def _(t):
    return pages.page_totals(filters.by_status(t.claims_core, "denied"), 40)


@query("fil11_latest_version", f"""SELECT tran_id, file_id, row_number, {d('claim_amount')} AS claim_amount FROM (SELECT *, row_number() OVER (PARTITION BY tran_id, row_number
  ORDER BY claim_amount DESC, item_code) AS rn FROM details_core) WHERE rn = 1""")
def _(t):
    rows = windows.latest(t.details_core, ["tran_id", "row_number"], [F.desc("claim_amount"), F.asc("item_code")])
    return rows.select("tran_id", "file_id", "row_number", "claim_amount")


@query("fil12_lookup", "SELECT hcode5, hcode9, name, province FROM offices WHERE hcode5 IN ('10042', '10042') OR hcode9 = '10042' OR hcode9 LIKE '%10042'")
def _(t):
    return filters.lookup(t.offices, "10042").select("hcode5", "hcode9", "name", "province")


@query("fil12_point_lookup", f"SELECT {_ROWS} FROM claims_core WHERE tran_id IN ('77', '142')")
def _(t):
    path = fresh_path(t.spark, "keyed-fact")
    files.write_fact(t.claims_core.select(*_COLS), path, key="tran_id")
    return files.point_lookup(t.spark, path, "tran_id", "77", "142").select(*_COLS)


@query("fil13_vendor_eq", f"SELECT vendor_no, count(*) AS n, {s('total_amount')} AS total_amount FROM transfers_core WHERE TRY_CAST(nullif(regexp_replace(vendor_no, '[^0-9]', '', 'g'), '') AS BIGINT) = 10007 GROUP BY 1")
def _(t):
    return filters.vendor_eq(t.transfers_core, "0010007").groupBy("vendor_no").agg(F.count("*").alias("n"), F.sum("total_amount").alias("total_amount"))


@query("fil14_same_vendor", f"SELECT vendor_no, count(*) AS n FROM transfers_core WHERE ltrim(vendor_no, '0') = '10010' GROUP BY 1")
def _(t):
    return t.transfers_core.filter(filters.same_vendor("0000010010")).groupBy("vendor_no").agg(F.count("*").alias("n"))


_MIXED = "CASE WHEN length(posting_date) = 8 AND ref_doc_no LIKE '%-2' THEN substr(posting_date, 7, 2) || '/' || substr(posting_date, 5, 2) || '/' || substr(posting_date, 1, 4) ELSE posting_date END"


def _mixed(t):
    return t.transfers_core.withColumn("posting_date", F.expr(_MIXED.replace("ref_doc_no LIKE '%-2'", "endswith(ref_doc_no, '-2')")))


@query("fil15_posting_order", f"""SELECT ref_doc_no, vendor_no, {_MIXED} AS posting_date, posting_date AS posting_key, {d('total_amount')} AS total_amount FROM transfers_core
  ORDER BY posting_key DESC, ref_doc_no, vendor_no, transfers_core.total_amount LIMIT 50 OFFSET 25""")
def _(t):
    return bookkeeping.sorted_transfers(_mixed(t), 50, 25).select("ref_doc_no", "vendor_no", "posting_date", "posting_key", "total_amount")


@query("fil16_secure", f"SELECT hcode, count(*) AS n, {s('reimb_nhso')} AS reimb FROM claims_core WHERE hcode = '10011' GROUP BY 1 UNION ALL SELECT 'admin', count(*), {s('reimb_nhso')} FROM claims_core")
def _(t):
    own = filters.secure(t.claims_core, "analyst", "10011").groupBy("hcode").agg(F.count("*").alias("n"), F.sum("reimb_nhso").alias("reimb"))
    every = filters.secure(t.claims_core, "admin", "10011").agg(F.lit("admin").alias("hcode"), F.count("*").alias("n"), F.sum("reimb_nhso").alias("reimb"))
    return own.unionByName(every)


@query("fil16_sql_views", f"""SELECT 'analyst' AS who, {txt('dateadm')} AS service_date, ptype, count(*) AS total_cases FROM claims_core WHERE hcode = '10011' AND dateadm IS NOT NULL GROUP BY claims_core.dateadm, ptype
  UNION ALL SELECT 'admin', {txt('dateadm')}, ptype, count(*) FROM claims_core WHERE dateadm IS NOT NULL GROUP BY claims_core.dateadm, ptype""")
def _(t):
    """A standing view read in SQL by two sessions of different roles."""
    out = None
    for who, hospital in (("analyst", "10011"), ("admin", None)):
        session = t.spark.newSession()
        sql_views.sign_in(session, t.folder, AS_OF, who, hospital)
        rows = session.sql("SELECT :who AS who, service_date, ptype, sum(total_cases) AS total_cases FROM v_daily_revenue GROUP BY service_date, ptype", args={"who": who})
        out = rows if out is None else out.unionByName(rows)
    return out


@query("fil17_aged_unpaid", f"""SELECT 'all' AS kind, count(*) AS n, {s('claim_drg')} AS amount FROM claims_core WHERE dateadm < {AS_OF_SQL} - 30 AND coalesce(paid, 0) = 0 AND claim_drg > 0
  UNION ALL SELECT 'clean', count(*), {s('claim_drg')} FROM claims_core WHERE dateadm < {AS_OF_SQL} - 60 AND coalesce(paid, 0) = 0 AND {OK}""")
def _(t):
    def one(kind, df):
        return df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("claim_drg").alias("amount"))

    return one("all", filters.aged_unpaid(t.claims_core, 30, AS_OF)).unionByName(one("clean", filters.aged_unpaid(t.claims_core, 60, AS_OF, only_clean=True)))


@query("fil18_vendor10", "SELECT hcode5, lpad(hcode5, 10, '0') AS vendor_no FROM offices")
def _(t):
    return t.offices.select("hcode5", filters.vendor10("hcode5").alias("vendor_no"))


@query("fil19_user_activity", f"""SELECT id, action, status, {txt('ts')} AS ts FROM audit WHERE user_id = '7' AND audit.ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY
  ORDER BY audit.ts DESC, id DESC LIMIT 1000""")
def _(t):
    return filters.user_activity(t.audit, "7", 10, dt.datetime(2024, 1, 25), k=1000).select("id", "action", "status", "ts")


@query("prj01_status_columns", f"""SELECT tran_id, CASE WHEN {IS_IP} THEN 'IPD' ELSE 'OPD' END AS visit, CASE WHEN {ERR} THEN 'fail' ELSE 'pass' END AS outcome,
  {rt('coalesce(paid, 0)', 'coalesce(claim_drg, 0)', 1)} AS reimb_rate FROM claims_core""")
def _(t):
    return filters.with_status(t.claims_core).select("tran_id", "visit", "outcome", "reimb_rate")


@query("prj02_labels", """SELECT service_type, CASE service_type WHEN '' THEN 'ไม่ระบุ' WHEN 'E' THEN 'ฉุกเฉิน (E)' WHEN 'R' THEN 'ส่งต่อ (R)' WHEN 'P' THEN 'ป้องกัน (P)' ELSE 'none' END AS label,
  count(*) AS n FROM claims_core GROUP BY 1, 2""")
def _(t):
    out = t.claims_core.groupBy("service_type").agg(F.count("*").alias("n"))
    return out.withColumn("label", filters.label("service_type", filters.SERVICE_LABELS, "none"))


@query("win01_share", f"SELECT main_fund, count(*) AS count, {rtn('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM claims_core GROUP BY 1")
def _(t):
    return windows.share(t.claims_core.groupBy("main_fund").agg(F.count("*").alias("count")))


@query("win05_month_change", f"""WITH m AS (SELECT strftime(dateadm, '%Y-%m') AS month, sum(reimb_nhso) AS v FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 2)
  SELECT month, {d('v')} AS current, {d('p')} AS previous, round(CAST(v - p AS DOUBLE) / CAST(p AS DOUBLE) * 100, 2) AS change_pct
  FROM (SELECT *, lag(v) OVER (ORDER BY month) AS p FROM m) ORDER BY month DESC LIMIT 1""")
def _(t):
    m = t.claims_core.filter("dateadm IS NOT NULL").groupBy(F.date_format("dateadm", "yyyy-MM").alias("month")).agg(F.sum("reimb_nhso").alias("v"))
    return windows.change_between_months(m, "month", "v")


@query("tk01_topk", f"SELECT hn, {s('claim_drg')} AS claimed FROM claims_core GROUP BY 1 ORDER BY sum(claim_drg) DESC, hn LIMIT 20")
def _(t):
    return reports.topk(t.claims_core.groupBy("hn").agg(F.sum("claim_drg").alias("claimed")), "claimed", 20, "hn")


@query("tk02_latest_k_ascending", "SELECT strftime(dateadm, '%Y-%m') AS month, count(*) AS n FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def _(t):
    m = t.claims_core.filter("dateadm IS NOT NULL").groupBy(F.date_format("dateadm", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return reports.latest_k_ascending(m, "month", 5)


@query("tk03_order_by_expression", f"SELECT tran_id, {d('his_amount_diff')} AS his_amount_diff FROM claims_core WHERE his_amount_diff IS NOT NULL ORDER BY abs(claims_core.his_amount_diff) DESC, claims_core.dateadm DESC NULLS LAST, tran_id LIMIT 30")
def _(t):
    rows = t.claims_core.filter("his_amount_diff IS NOT NULL")
    return rows.orderBy(F.abs("his_amount_diff").desc(), F.desc_nulls_last("dateadm"), "tran_id").limit(30).select("tran_id", "his_amount_diff")


@query("tk04_rank_order", "SELECT severity, count(*) AS n FROM notices GROUP BY 1")
def _(t):
    return reports.order_rank(t.notices.groupBy("severity").agg(F.count("*").alias("n")), "severity", ["critical", "warning", "info"])


@query("tk05_nulls_last", f"SELECT id, {txt('last_login_at')} AS last_login_at FROM users")
def _(t):
    from ..plans.views import order_nulls_last

    return order_nulls_last(t.users.select("id", "last_login_at"), "last_login_at")


@query("tk06_offset", f"SELECT tran_id, {d('reimb_nhso')} AS reimb_nhso FROM claims_core WHERE file_id = 7 ORDER BY tran_id LIMIT 30 OFFSET 60")
def _(t):
    return bookkeeping.file_items(t.claims_core, 7, 30, 60).select("tran_id", "reimb_nhso")


@query("tk06_keyset", f"SELECT tran_id, {d('reimb_nhso')} AS reimb_nhso FROM claims_core WHERE file_id = 7 AND claims_core.tran_id > '3' ORDER BY tran_id LIMIT 30")
def _(t):
    return bookkeeping.file_items_after(t.claims_core, 7, 30, Cursor(("3",), 0)).select("tran_id", "reimb_nhso")


@query("so01_union_distinct", "SELECT hn AS key FROM claims_core UNION SELECT hcode FROM claims_core")
def _(t):
    return joins.union_distinct(t.claims_core.select(F.col("hn").alias("key")), t.claims_core.select(F.col("hcode").alias("key")))


@query("so02_key_union", "SELECT strftime(dateadm, '%Y-%m') AS month FROM claims_core WHERE dateadm IS NOT NULL UNION SELECT strftime(run_date, '%Y-%m') FROM transfers_core")
def _(t):
    a = t.claims_core.filter("dateadm IS NOT NULL").select(F.date_format("dateadm", "yyyy-MM").alias("month"))
    return joins.union_distinct(a, t.transfers_core.select(F.date_format("run_date", "yyyy-MM").alias("month")))


@query("so03_difference", "SELECT tran_id FROM claims_core EXCEPT SELECT tran_id FROM stm_core")
def _(t):
    return joins.difference(t.claims_core.select("tran_id"), t.stm_core.select("tran_id"))


@query("so05_stack", f"SELECT tran_id, data_type, {d('paid_after_deduction')} AS paid_after_deduction FROM stm_core")
def _(t):
    x = t.stm_core.select("tran_id", "data_type", "paid_after_deduction")
    return joins.stack([x.filter(F.col("data_type") == k) for k in ("normal", "appeal", "disabled_d1")])


@query("so06_present_in", "SELECT tran_id FROM claims_core WHERE tran_id IN (SELECT tran_id FROM stm_core)")
def _(t):
    return joins.present_in(t.claims_core.select("tran_id"), t.stm_core, "tran_id")
