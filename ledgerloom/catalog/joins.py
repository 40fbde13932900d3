"""Matching of feeds and lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import pad
from ..operators import joins, windows
from ..plans import calendar, reports, views
from .base import d, hu, n, query, txt

_R = "coalesce(reimb_nhso, 0)"


def _match_sql(rep: str, pay: str, err: str = "true") -> str:
    return f"""SELECT coalesce(r.tran_id, s.tran_id) AS tran_id, coalesce(r.rep_no, s.rep_no) AS rep_no, coalesce(r.hn, s.hn) AS hn,
      {txt('coalesce(r.dateadm, s.date_admit)')} AS service_date, r.error_code, {d('coalesce(r.reimb_nhso, 0)')} AS rep_amount, {d('coalesce(s.paid_after_deduction, 0)')} AS stm_amount,
      {d('coalesce(r.reimb_nhso, 0) - coalesce(s.paid_after_deduction, 0)')} AS diff,
      CASE WHEN r.tran_id IS NOT NULL AND s.tran_id IS NOT NULL AND abs(coalesce(r.reimb_nhso, 0) - coalesce(s.paid_after_deduction, 0)) < 0.01 THEN 'matched'
        WHEN r.tran_id IS NOT NULL AND s.tran_id IS NOT NULL THEN 'diff_amount' WHEN r.tran_id IS NOT NULL THEN 'rep_only' ELSE 'stm_only' END AS status
      FROM (SELECT * FROM claims WHERE {rep} AND {err}) r FULL JOIN (SELECT * FROM stm WHERE {pay}) s ON r.tran_id = s.tran_id"""


MATCH = _match_sql("true", "true")


@query("jn01_reconcile_claims", MATCH)
def _(t):
    return joins.reconcile(t.claims, t.stm)


@query("jn01_reconcile_filtered", _match_sql("dateadm BETWEEN DATE '1998-10-01' AND DATE '1999-09-30'", "date_admit BETWEEN DATE '1998-10-01' AND DATE '1999-09-30'", "error_code IS NOT NULL AND error_code <> ''"))
def _(t):
    return joins.reconcile(t.claims, t.stm, date_from="1998-10-01", date_to="1999-09-30", has_error=True)


BATCH = """SELECT rep_no, coalesce(rc, 0) AS rep_count, coalesce(sc, 0) AS stm_count, CAST(coalesce(ra, 0) AS DOUBLE) AS rep_amount, CAST(coalesce(sa, 0) AS DOUBLE) AS stm_amount,
  CAST(coalesce(ra, 0) - coalesce(sa, 0) AS DOUBLE) AS diff, CASE WHEN sc IS NULL THEN 'rep_only' WHEN rc IS NULL THEN 'stm_only'
  WHEN abs(coalesce(ra, 0) - coalesce(sa, 0)) < 0.01 THEN 'matched' ELSE 'diff_amount' END AS status
  FROM (SELECT rep_no, count(*) AS rc, sum(reimb_nhso) AS ra FROM claims GROUP BY 1) r
  FULL JOIN (SELECT rep_no, count(*) AS sc, sum(paid_after_deduction) AS sa FROM stm GROUP BY 1) s USING (rep_no)"""


@query("jn02_reconcile_batches", BATCH)
def _(t):
    return joins.reconcile_batches(t.claims, t.stm)


@query("jn03_match_filters", f"SELECT * FROM ({MATCH}) WHERE contains(lower(tran_id), '12') AND status = 'diff_amount' AND abs(diff) >= 10")
def _(t):
    return joins.keep_matches(joins.reconcile(t.claims, t.stm), "tran_id", "12", "diff_amount", 10)


@query("jn04_outer_by_union", f"SELECT tran_id, {d('reimb_nhso')} AS reimb_nhso, {d('paid_after_deduction')} AS paid_after_deduction FROM claims_core FULL JOIN (SELECT tran_id, paid_after_deduction FROM stm_core) USING (tran_id)")
def _(t):
    return joins.full_match(t.claims_core.select("tran_id", "reimb_nhso"), t.stm_core.select("tran_id", "paid_after_deduction"), "tran_id")


_COUNTS = "count(*) AS total, " + ", ".join(f"{n(chr(39).join(['status = ', k, '']))} AS {k}" for k in ("matched", "rep_only", "stm_only", "diff_amount"))


@query("jn05_match_counts", f"SELECT {_COUNTS} FROM ({MATCH})")
def _(t):
    return joins.match_counts(joins.reconcile(t.claims, t.stm))


@query("jn05_batch_counts", f"SELECT {_COUNTS} FROM ({BATCH})")
def _(t):
    return joins.match_counts(joins.reconcile_batches(t.claims, t.stm))


@query("jn06_batch_records", f"""SELECT rep_no, count(*) AS count, {d(f'sum({_R})')} AS rep_amount, {d('max(sa)')} AS stm_amount,
  CASE WHEN max(sc) IS NULL THEN 'rep_only' WHEN abs(max(sa) - sum({_R})) < 1 THEN 'matched' ELSE 'diff_amount' END AS status
  FROM claims LEFT JOIN (SELECT rep_no, count(*) AS sc, sum(coalesce(paid_after_deduction, 0)) AS sa FROM stm GROUP BY 1) s USING (rep_no) GROUP BY 1""")
def _(t):
    return joins.batch_records(t.claims, t.stm)


@query("jn07_claim_records", f"""SELECT tran_id, c.rep_no, c.hn, {d(_R)} AS rep_amount, {d('sa')} AS stm_amount,
  CASE WHEN sa IS NULL THEN 'rep_only' WHEN abs({_R} - sa) < 1 THEN 'matched' ELSE 'diff_amount' END AS status
  FROM claims c LEFT JOIN (SELECT tran_id, min(coalesce(paid_after_deduction, 0)) AS sa FROM stm GROUP BY 1) s USING (tran_id)""")
def _(t):
    return joins.claim_records(t.claims, t.stm)


_EX = "EXISTS (SELECT 1 FROM stm_core s WHERE s.tran_id = c.tran_id AND abs(coalesce(s.paid_after_deduction, 0) - coalesce(c.reimb_nhso, 0)) {} 1)"


@query("jn08_exists_counts", f"SELECT *, total - matched - diff_amount AS rep_only FROM (SELECT count(*) AS total, {n(_EX.format('<'))} AS matched, {n(_EX.format('>='))} AS diff_amount FROM claims_core c)")
def _(t):
    return joins.exists_counts(t.claims_core, t.stm_core)


_DIFF = "(coalesce(s.total_compensation, 0) - coalesce(r.paid, 0))"
STM_VIEW = f"""SELECT s.tran_id, s.hn, s.an, {txt('s.date_admit')} AS date_admit, {d('s.amount_claimed')} AS stm_claimed, {d('s.total_compensation')} AS stm_compensation,
  r.rep_no AS rep_repno, {d('r.claim_net')} AS rep_claim_net, {d('r.paid')} AS rep_paid, {d('r.reimb_nhso')} AS rep_reimb_nhso, f.document_no, f.scheme, f.file_type,
  f.statement_month, f.statement_year, CASE WHEN r.tran_id IS NULL THEN 'missing_rep' WHEN s.total_compensation IS NULL THEN 'missing_stm'
  WHEN abs({_DIFF}) < 1 THEN 'matched' ELSE 'amount_diff' END AS reconcile_status, {d(_DIFF)} AS amount_difference
  FROM stm s LEFT JOIN claims r ON s.tran_id = r.tran_id LEFT JOIN stm_files f ON s.file_id = f.file_id WHERE s.data_type IN ('normal', 'appeal')"""


@query("jn09_statement_view", STM_VIEW)
def _(t):
    return joins.statement_view(t.stm, t.claims, t.stm_files)


@query("jn10_statement_batches", f"""SELECT rep_repno AS rep_no, count(*) AS count, round(sum(stm_compensation), 2) AS stm_amount, round(sum(rep_reimb_nhso), 2) AS rep_amount,
  CASE WHEN bool_and(reconcile_status = 'matched') THEN 'matched' WHEN bool_or(reconcile_status = 'amount_diff') THEN 'diff_amount' ELSE 'stm_only' END AS status
  FROM ({STM_VIEW}) GROUP BY 1""")
def _(t):
    return joins.statement_batches(joins.statement_view(t.stm, t.claims, t.stm_files))


@query("jn10_statement_counts", f"""SELECT count(*) AS total, {n("reconcile_status = 'matched'")} AS matched, {n("reconcile_status = 'amount_diff'")} AS diff_amount,
  {n("reconcile_status = 'missing_rep'")} AS stm_only FROM ({STM_VIEW})""")
def _(t):
    return joins.statement_counts(joins.statement_view(t.stm, t.claims, t.stm_files))


_PERSIST = f"""SELECT s.tran_id, s.file_id, r.tran_id IS NOT NULL AS rep_matched, CASE WHEN r.tran_id IS NULL THEN 'missing_rep' WHEN abs({_DIFF}) < 1 THEN 'matched'
  ELSE 'amount_diff' END AS reconcile_status, {_DIFF} AS reconcile_diff FROM stm_core s LEFT JOIN claims_core r USING (tran_id)"""


@query("jn11_persist_match", f"SELECT * REPLACE ({d('reconcile_diff')} AS reconcile_diff) FROM ({_PERSIST})")
def _(t):
    rows = joins.persist_match(t.stm_core, windows.latest(t.claims_core, ["tran_id"], [F.desc("file_id")]))
    return rows.select("tran_id", "file_id", "rep_matched", "reconcile_status", "reconcile_diff")


@query("jn11_match_totals", f"SELECT reconcile_status, count(*) AS count, {d('sum(abs(reconcile_diff))')} AS total_diff FROM ({_PERSIST}) WHERE file_id = 3 GROUP BY 1")
def _(t):
    return joins.match_totals(joins.persist_match(t.stm_core, windows.latest(t.claims_core, ["tran_id"], [F.desc("file_id")]), file_id=3))


_MATCHES = "SELECT CASE WHEN o_orderkey % 14 = 0 THEN 'X' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS tran_id, 'V' || o_orderkey AS his_vn FROM orders WHERE o_orderkey % 7 = 0"


def _matches(t):
    k = F.col("o_orderkey")
    return t.orders.filter(k % 7 == 0).select(
        F.when(k % 14 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(k.cast("string")).alias("tran_id"), F.concat(F.lit("V"), k.cast("string")).alias("his_vn")
    )


@query("jn12_apply_matches", f"""SELECT tran_id, coalesce(m.his_vn, c.his_vn) AS his_vn, CASE WHEN m.his_vn IS NOT NULL THEN true ELSE c.his_matched END AS his_matched
  FROM claims_core c LEFT JOIN ({_MATCHES}) m USING (tran_id)""")
def _(t):
    return joins.apply_matches(t.claims_core, _matches(t)).select("tran_id", "his_vn", "his_matched")


@query("jn12_failed_matches", f"SELECT tran_id, his_vn FROM ({_MATCHES}) WHERE tran_id NOT IN (SELECT tran_id FROM claims_core)")
def _(t):
    return joins.failed_matches(t.claims_core, _matches(t))


@query("jn13_dimension_lookup", "SELECT tran_id, hcode, name, province FROM claims_core LEFT JOIN (SELECT hcode5, name, province FROM offices) ON hcode = hcode5")
def _(t):
    return joins.enrich(t.claims_core, t.offices.select("hcode5", "name", "province"), "hcode", "hcode5").select("tran_id", "hcode", "name", "province")


@query("jn14_either_code", f"""SELECT ref_doc_no, vendor_no, {d('total_amount')} AS total_amount, h.name AS facility FROM transfers_core
  LEFT JOIN offices h ON h.hcode5 = ltrim(vendor_no, '0') OR h.hcode5 = vendor_no""")
def _(t):
    rows = joins.by_either_code(t.transfers_core, t.offices.select("hcode5", F.col("name").alias("facility")), "vendor_no", "hcode5")
    return rows.select("ref_doc_no", "vendor_no", "total_amount", "facility")


@query("jn15_with_calendar", "SELECT tran_id, CAST(year(dateadm) AS INT) AS year, CAST(quarter(dateadm) AS INT) AS quarter, CAST(isodow(dateadm) - 1 AS INT) AS day_of_week FROM claims_core WHERE dateadm IS NOT NULL")
def _(t):
    dim = calendar.date_dimension_for(t.claims_core, "dateadm")
    return views.with_calendar(t.claims_core, dim, "year", "quarter", "day_of_week").select("tran_id", "year", "quarter", "day_of_week")


@query("jn16_detail_with_claim", f"SELECT x.tran_id, row_number, item_code, {d('claim_amount')} AS claim_amount, {txt('c.dateadm')} AS claim_date FROM details_core x JOIN claims_core c USING (tran_id)")
def _(t):
    return reports.detail_with_claim(t.details_core, t.claims_core).select("tran_id", "row_number", "item_code", "claim_amount", "claim_date")


@query("jn20_coding_opportunities", f"""WITH g AS (SELECT substr(drg, 1, 3) AS g, CAST(sum(rw) AS DOUBLE) / CAST(count(rw) AS DOUBLE) AS a FROM claims_core WHERE rw IS NOT NULL GROUP BY 1)
  SELECT tran_id, hn, drg, {d('rw')} AS rw, {d('claim_drg')} AS claim_drg, {hu('a', 3)} AS avg_rw_for_drg, {hu('a - CAST(rw AS DOUBLE)', 3)} AS rw_gap
  FROM claims_core JOIN g ON g = substr(drg, 1, 3) WHERE CAST(claims_core.rw AS DOUBLE) < a * 0.7 AND claims_core.claim_drg > 5000 ORDER BY claims_core.claim_drg DESC, tran_id LIMIT 20""")
def _(t):
    return reports.coding_opportunities(t.claims_core)


@query("jn21_orphans", """SELECT filename, 'not_in_ledger' AS problem FROM stm_files WHERE file_id % 3 > 0 AND filename NOT IN (SELECT filename FROM stm_files WHERE file_id % 4 > 0)
  UNION ALL SELECT filename, 'file_missing' FROM stm_files WHERE file_id % 4 > 0 AND filename NOT IN (SELECT filename FROM stm_files WHERE file_id % 3 > 0)""")
def _(t):
    return joins.orphans(t.stm_files.filter("file_id % 3 > 0"), t.stm_files.filter("file_id % 4 > 0"))


@query("jn22_file_status", """SELECT d.filename, d.imported, l.status AS import_status, d.imported OR coalesce(l.status = 'completed', false) AS is_imported FROM downloads d
  LEFT JOIN (SELECT filename, CASE WHEN service_month % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM downloads WHERE fiscal_year % 2 = 0) l USING (filename)""")
def _(t):
    from ..plans.bookkeeping import file_status

    ledger = t.downloads.filter("fiscal_year % 2 = 0").select("filename", F.when(F.col("service_month") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return file_status(t.downloads, ledger).select("filename", "imported", "import_status", "is_imported")


@query("jn24_trailing_failures", f"""SELECT id, user_id, {txt('ts')} AS ts, count(*) OVER (PARTITION BY user_id ORDER BY audit.ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n_recent
  FROM audit WHERE action = 'LOGIN_FAILED'""")
def _(t):
    return windows.trailing_count(t.audit.filter("action = 'LOGIN_FAILED'"), "user_id", "ts", 86400).select("id", "user_id", "ts", "n_recent")


_VISITS = "SELECT hn, dateadm AS visit_date, 'V' || tran_id AS vn FROM claims_core WHERE CAST(tran_id AS BIGINT) % 3 = 0 AND dateadm IS NOT NULL"
_ADM = "SELECT an, 'A' || tran_id AS vn FROM claims_core WHERE an LIKE 'AN%' AND CAST(tran_id AS BIGINT) % 5 < 3"
_PAT = "SELECT pid, hn FROM claims_core WHERE CAST(hn AS BIGINT) % 4 <> 1"


@query("jn27_waterfall", f"""WITH byday AS (SELECT hn, visit_date, min(vn) AS vn FROM ({_VISITS}) GROUP BY 1, 2), byan AS (SELECT an, min(vn) AS vn FROM ({_ADM}) GROUP BY 1),
  pat AS (SELECT pid, min(hn) AS hn FROM ({_PAT}) GROUP BY 1)
  SELECT c.tran_id, coalesce(a.vn, b.vn, e.vn) AS vn, CASE WHEN a.vn IS NOT NULL THEN 'hn_date' WHEN b.vn IS NOT NULL THEN 'an' WHEN e.vn IS NOT NULL THEN 'pid_date' END AS match_pass
  FROM (SELECT *, CASE WHEN CAST(tran_id AS BIGINT) % 7 = 0 THEN NULL ELSE hn END AS h FROM claims_core) c LEFT JOIN byday a ON c.h = a.hn AND c.dateadm = a.visit_date
  LEFT JOIN byan b ON nullif(c.an, '') = b.an LEFT JOIN pat p ON c.pid = p.pid LEFT JOIN byday e ON p.hn = e.hn AND c.dateadm = e.visit_date""")
def _(t):
    c, k = t.claims_core, F.col("tran_id").cast("bigint")
    visits = c.filter((k % 3 == 0) & F.col("dateadm").isNotNull()).select("hn", F.col("dateadm").alias("visit_date"), F.concat(F.lit("V"), "tran_id").alias("vn"))
    admissions = c.filter(F.col("an").startswith("AN") & (k % 5 < 3)).select("an", F.concat(F.lit("A"), "tran_id").alias("vn"))
    patients = c.filter(F.col("hn").cast("bigint") % 4 != 1).select("pid", "hn")
    claims = c.withColumn("hn", F.when(k % 7 != 0, F.col("hn")))
    return joins.waterfall_match(claims, visits, admissions, patients).select("tran_id", "vn", "match_pass")


@query("jn28_flag_amounts", f"""WITH b AS (SELECT tran_id, sum(claim_amount) / 1 AS billed FROM details_core GROUP BY 1)
  SELECT tran_id, {d('claim_drg - CAST(billed AS DECIMAL(25,2))')} AS amount_diff, CASE WHEN billed IS NULL THEN 'unbilled'
  WHEN abs(claim_drg - CAST(billed AS DECIMAL(25,2))) > 100 THEN 'review' ELSE 'ok' END AS amount_status FROM claims_core LEFT JOIN b USING (tran_id)""")
def _(t):
    billing = t.details_core.groupBy("tran_id").agg(F.sum("claim_amount").alias("billed"))
    return joins.flag_amounts(t.claims_core, billing).select("tran_id", "amount_diff", "amount_status")


@query("jn29_prefix_join", "SELECT c.tran_id, c.drg, p.code FROM claims_core c JOIN (SELECT DISTINCT substr(lpad(CAST(p_partkey % 300 AS VARCHAR), 5, '0'), 1, CAST(3 + p_partkey % 3 AS INT)) AS code FROM part) p ON starts_with(c.drg, p.code)")
def _(t):
    code = F.substring(pad(F.col("p_partkey") % 300, 5), F.lit(1), (3 + F.col("p_partkey") % 3).cast("int"))
    return joins.prefix_join(t.claims_core.select("tran_id", "drg"), t.part.select(code.alias("code")).distinct(), "drg", "code")


@query("jn30_drug_lookup", f"SELECT tran_id, row_number, item_code, generic_name, {d('price')} AS price FROM details_core LEFT JOIN drugs ON item_code = tmt_code")
def _(t):
    return joins.enrich(t.details_core, t.drugs, "item_code", "tmt_code").select("tran_id", "row_number", "item_code", "generic_name", "price")


_SINCE = dt.datetime(2024, 1, 30)


@query("jn25_login_history", f"""SELECT u.id AS user_id, u.username, u.email, {txt('a.ts')} AS login_time, a.ip_address, a.status FROM users u LEFT JOIN audit a ON a.user_id = u.username
  AND a.action IN ('LOGIN', 'LOGIN_FAILED') AND a.ts > TIMESTAMP '2024-01-30' - INTERVAL 3 DAY WHERE NOT u.is_deleted""")
def _(t):
    return views.user_login_history(t.users, t.audit, _SINCE, 3)


@query("jn26_active_users", f"""SELECT id, username, email, role, hospital_code, {txt('last_login_at')} AS last_login_at, {txt('created_at')} AS created_at,
  (SELECT count(*) FROM sessions s WHERE s.user_id = u.id AND s.is_active) AS active_sessions FROM users u WHERE is_active AND NOT is_deleted""")
def _(t):
    return views.active_users_summary(t.users, t.sessions)
