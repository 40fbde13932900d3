"""Standing views and the calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import ingest
from ..plans import calendar, reports, views
from .base import AS_OF, AS_OF_SQL, ERR, ERR_VIEW, FY, FY_FROM, FY_TO, av, d, hu, n, query, rtn, s, txt
from .joins import STM_VIEW


def _sum(x: str) -> str:
    return d(f"sum({x})")


@query("vw01_daily_claim_summary", f"""SELECT {txt('dateadm')} AS service_date, ptype, main_inscl, count(*) AS claim_count, {_sum('reimb_nhso')} AS total_reimbursement, {n(ERR_VIEW)} AS error_count,
  {n('his_matched')} AS matched_count FROM claims_core GROUP BY 1, 2, 3""")
def _(t):
    return views.daily_claim_summary(t.claims_core)


@query("vw02_unmatched_claims", f"""SELECT c.file_id, tran_id, hn, an, pid, ptype, {txt('dateadm')} AS dateadm, {txt('datedsc')} AS datedsc, {d('reimb_nhso')} AS reimb_nhso, error_code, filename,
  {txt('file_date')} AS file_date FROM claims_core c LEFT JOIN (SELECT file_id, filename, file_date FROM ledger) f ON c.file_id = f.file_id WHERE his_matched = false""")
def _(t):
    return views.unmatched_claims(t.claims_core, t.ledger)


@query("vw03_import_status", f"""SELECT file_type, status, count(*) AS file_count, CAST(sum(total_records) AS BIGINT) AS total_records, CAST(sum(imported_records) AS BIGINT) AS imported_records,
  CAST(sum(failed_records) AS BIGINT) AS failed_records, {txt('min(file_date)')} AS earliest_file, {txt('max(file_date)')} AS latest_file FROM ledger GROUP BY 1, 2""")
def _(t):
    return views.import_status(t.ledger)


@query("vw04_drug_analytics", f"""SELECT item_code, item_name, item_type, count(*) AS prescription_count, {_sum('quantity')} AS total_quantity, {_sum('claim_amount')} AS total_claim,
  {_sum('reimb_amount')} AS total_reimb, {av('unit_price')} AS avg_unit_price, {n(ERR)} AS error_count FROM details GROUP BY 1, 2, 3""")
def _(t):
    return views.drug_analytics(t.details)


@query("vw05_deny_analytics", f"SELECT deny_code, fund_code, count(*) AS deny_count, {_sum('claim_amount')} AS total_denied_amount, count(DISTINCT tran_id) AS affected_cases FROM details_core WHERE deny_code IS NOT NULL GROUP BY 1, 2")
def _(t):
    return views.deny_analytics(t.details_core.filter("deny_code IS NOT NULL"))


@query("vw06_instrument_analytics", f"""SELECT item_code, item_name, count(*) AS usage_count, {_sum('quantity')} AS total_claim_qty, {_sum('claim_amount')} AS total_claim, {_sum('reimb_amount')} AS total_reimb,
  {rtn('sum(reimb_amount)', 'sum(claim_amount)')} AS approval_rate FROM details WHERE row_number <= 3 GROUP BY 1, 2""")
def _(t):
    return views.instrument_analytics(t.details.filter("row_number <= 3"))


@query("vw07_monthly_summary", f"""SELECT rep_period, file_type, CAST(sum(total_cases) AS BIGINT) AS total_cases, CAST(sum(passed_cases) AS BIGINT) AS passed_cases, CAST(sum(failed_cases) AS BIGINT) AS failed_cases,
  {_sum('ip_claim + drug_claim + inst_claim')} AS total_claim, {_sum('ip_reimb + drug_reimb + inst_reimb')} AS total_reimb, {_sum('reimb_total')} AS grand_total FROM file_totals GROUP BY 1, 2""")
def _(t):
    return views.monthly_summary(t.file_totals)


_TH = "CASE month(dateadm) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in calendar.THAI_MONTHS.items()) + " END"
_Y = "CAST(year(dateadm) AS INT) AS year, CAST(month(dateadm) AS INT) AS month_number"
_YM3 = f"{_Y}, {_TH} AS month_name_th"
_FQ = "CAST(CASE WHEN month(dateadm) >= 10 THEN 1 WHEN month(dateadm) <= 3 THEN 2 WHEN month(dateadm) <= 6 THEN 3 ELSE 4 END AS INT)"
_ON = "FROM claims_core WHERE dateadm IS NOT NULL"


def _dim(t):
    return calendar.date_dimension_for(t.claims_core, "dateadm")


@query("vw08_monthly_revenue_by_fund", f"""SELECT {_YM3}, CAST(year(dateadm) + CASE WHEN month(dateadm) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year, {_FQ} AS fiscal_quarter, ptype, main_fund, scheme,
  count(*) AS total_cases, {_sum('claim_drg')} AS total_claimed, {_sum('reimb_nhso')} AS total_reimb_nhso, {_sum('reimb_agency')} AS total_reimb_agency, {av('reimb_nhso')} AS avg_reimb_nhso,
  {n(ERR_VIEW)} AS denied_cases FROM claims WHERE dateadm IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def _(t):
    return views.monthly_revenue_by_fund(t.claims, _dim(t))


@query("vw09_daily_revenue", f"""SELECT {txt('dateadm')} AS service_date, ptype, main_inscl, count(*) AS total_cases, {_sum('reimb_nhso')} AS total_reimb, {av('reimb_nhso')} AS avg_reimb, {n(ERR_VIEW)} AS denied_count
  {_ON} GROUP BY 1, 2, 3""")
def _(t):
    return views.daily_revenue(t.claims_core)


@query("vw10_error_analysis", f"""SELECT error_code, ptype, count(*) AS total_cases, {_sum('claim_drg')} AS total_claimed, {_sum('reimb_nhso')} AS total_reimb, {hu(av('claim_drg - reimb_nhso'))} AS avg_denied_amount,
  {d('sum(claim_drg) - sum(reimb_nhso)')} AS total_denied_amount, e.type, e.description FROM claims_core c LEFT JOIN error_dim e ON c.error_code = e.code WHERE {ERR_VIEW} GROUP BY 1, 2, 8, 9""")
def _(t):
    return views.error_analysis(t.claims_core, t.error_dim)


@query("vw11_fund_performance", f"""SELECT main_fund, sub_fund, ptype, count(*) AS total_cases, {_sum('claim_drg')} AS total_claimed, {_sum('reimb_nhso')} AS total_reimb, {hu(av('reimb_nhso'))} AS avg_reimb,
  {rtn('sum(reimb_nhso)', 'sum(claim_drg)')} AS reimb_rate_pct, fund_name_th FROM claims_core LEFT JOIN fund_dim ON main_fund = fund_code GROUP BY 1, 2, 3, fund_name_th""")
def _(t):
    return views.fund_performance(t.claims_core, t.fund_dim)


def _z(c: str) -> str:
    return f"coalesce({c}, 0)"


@query("vw12_hc_analysis", f"""SELECT {_YM3}, ptype, count(*) AS total_cases, {_sum(_z('iphc'))} AS total_iphc, {_sum(_z('ophc'))} AS total_ophc, {_sum(f"{_z('iphc')} + {_z('ophc')}")} AS total_hc,
  {av(f"({_z('iphc')} + {_z('ophc')})")} AS avg_hc {_ON} AND ({_z('iphc')} > 0 OR {_z('ophc')} > 0) GROUP BY 1, 2, 3, 4""")
def _(t):
    return views.hc_analysis(t.claims_core, _dim(t))


_AE = " + ".join(_z(c) for c in ("ae_opae", "ae_ipnb", "ae_ipuc", "ae_ip3sss", "ae_ip7sss", "ae_carae", "ae_caref", "ae_caref_puc"))


@query("vw13_ae_analysis", f"""SELECT {_YM3}, ptype, count(*) AS total_cases, {_sum(_z('ae_opae'))} AS total_opae, {_sum(_z('ae_ipnb'))} AS total_ipnb, {_sum(_z('ae_ipuc'))} AS total_ipuc,
  {_sum(_z('ae_carae'))} AS total_carae, {_sum(_AE)} AS total_ae {_ON} AND ({_z('ae_opae')} > 0 OR {_z('ae_ipnb')} > 0 OR {_z('ae_ipuc')} > 0) GROUP BY 1, 2, 3, 4""")
def _(t):
    return views.ae_analysis(t.claims_core, _dim(t))


_DMIS = {"total_cataract": "cataract_amt", "total_dmisrc": "dmisrc_amt", "total_rcuhosc": "rcuhosc_amt", "total_rcuhosr": "rcuhosr_amt", "total_stroke_drug": "dmis_stroke_drug", "total_dm": "dmis_dm", "total_pp": "dmis_pp"}


@query("vw14_dmis_analysis", f"""SELECT {_YM3}, count(*) AS total_cases, {', '.join(f'{_sum(_z(c))} AS {k}' for k, c in _DMIS.items())} {_ON}
  AND ({_z('cataract_amt')} > 0 OR {_z('dmisrc_amt')} > 0 OR {_z('rcuhosc_amt')} > 0 OR {_z('dmis_dm')} > 0) GROUP BY 1, 2, 3""")
def _(t):
    return views.dmis_analysis(t.claims_core, _dim(t))


_DENY = ", ".join(f"count(*) FILTER (WHERE {k} <> '-') AS {k}_count" for k in ("deny_hc", "deny_ae", "deny_inst", "deny_ip", "deny_dmis"))


@query("vw15_denial_breakdown", f"SELECT {_YM3}, ptype, count(*) AS total_cases, {_DENY} {_ON} GROUP BY 1, 2, 3, 4")
def _(t):
    return views.denial_breakdown(t.claims_core, _dim(t))


@query("vw16_file_import_summary", f"""SELECT file_id, filename, status, total_records, CAST(epoch(import_completed_at - import_started_at) AS BIGINT) AS duration_seconds, {d('coalesce(r, 0)')} AS total_reimb,
  {d('coalesce(c, 0)')} AS total_claimed FROM ledger LEFT JOIN (SELECT file_id, sum(reimb_nhso) AS r, sum(claim_drg) AS c FROM claims_core GROUP BY 1) x USING (file_id)""")
def _(t):
    return views.file_import_summary(t.ledger, t.claims_core).select("file_id", "filename", "status", "total_records", "duration_seconds", "total_reimb", "total_claimed")


@query("vw17_hospital_comparison", f"""SELECT hcode, {_Y}, count(*) AS total_cases, {_sum('reimb_nhso')} AS total_reimb, {av('reimb_nhso')} AS avg_reimb, {n(ERR_VIEW)} AS denied_cases,
  {rtn(n(ERR_VIEW), 'count(*)')} AS denial_rate_pct, o.name AS hospital_name, o.health_region FROM claims_core c LEFT JOIN offices o ON c.hcode = o.hcode5 WHERE dateadm IS NOT NULL GROUP BY 1, 2, 3, o.name, o.health_region""")
def _(t):
    return views.hospital_comparison(t.claims_core, _dim(t), t.offices)


@query("vw18_drg_distribution", f"""SELECT drg, count(*) AS total_cases, {av('rw')} AS avg_rw, {_sum('reimb_nhso')} AS total_reimb, {av('reimb_nhso')} AS avg_reimb, drg_name_th, mdc
  FROM claims_core LEFT JOIN drg_dim ON drg = drg_code WHERE drg <> '-' GROUP BY 1, 6, 7""")
def _(t):
    return views.drg_distribution(t.claims_core, t.drg_dim)


@query("vw19_payment_type_analysis", f"""SELECT payment_type, ptype, {_Y}, count(*) AS total_cases, {_sum('reimb_nhso')} AS total_reimb, {av('reimb_nhso')} AS avg_reimb {_ON} AND payment_type IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(t):
    return views.payment_type_analysis(t.claims_core, _dim(t))


@query("vw20_stm_rep_reconciliation", STM_VIEW)
def _(t):
    return views.stm_rep_reconciliation(t.stm, t.claims, t.stm_files)


_NET = "CAST(coalesce(total_paid, 0) - coalesce(salary_deduction, 0) - coalesce(adjrw_paid_deduction, 0) AS DECIMAL(15,2))"


@query("vw21_stm_statistics", f"""SELECT hospital_code, scheme, file_type, statement_year, statement_month, count(DISTINCT f.file_id) AS file_count, CAST(sum(rep_count) AS BIGINT) AS total_rep_count,
  CAST(sum(patient_count) AS BIGINT) AS total_patient_count, {_sum('total_paid')} AS total_paid, {_sum(_NET)} AS total_net_receivable
  FROM stm_files f LEFT JOIN receivables r ON f.file_id = r.file_id WHERE f.status = 'completed' GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return views.stm_statistics(t.stm_files, ingest.receivable_net(t.receivables))


_NOW = dt.datetime(2024, 2, 1)


def _act(w: str) -> str:
    return n(f"action = '{w}'")


@query("vw22_audit_log_stats", f"""SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, {n("status = 'failed'")} AS failed_events, {n("status = 'denied'")} AS denied_events,
  {_act('LOGIN')} AS total_logins, {_act('LOGIN_FAILED')} AS failed_logins, {n("action IN ('CREATE','UPDATE','DELETE')")} AS data_changes, {_act('EXPORT')} AS data_exports,
  {txt('min(ts)')} AS first_event, {txt('max(ts)')} AS last_event, count(DISTINCT ts::DATE) AS active_days,
  CAST(epoch(TIMESTAMP '2024-02-01' - date_trunc('second', max(ts))) AS BIGINT) AS seconds_since_last_event FROM audit""")
def _(t):
    return views.audit_log_stats(t.audit, _NOW)


@query("vw23_user_activity_summary", f"""SELECT user_id, user_email, count(*) AS total_actions, count(DISTINCT ts::DATE) AS active_days, {n("action IN ('CREATE','UPDATE','DELETE')")} AS data_modifications,
  {_act('READ')} AS data_reads, {_act('EXPORT')} AS data_exports, {n("status = 'failed'")} AS failed_actions, {txt('min(ts)')} AS first_activity, {txt('max(ts)')} AS last_activity,
  array_to_string(list_sort(list(DISTINCT ip_address)), ',') AS ip_addresses FROM audit GROUP BY 1, 2""")
def _(t):
    return views.user_activity_summary(t.audit)


@query("vw23_user_addresses", f"SELECT user_id, ip_address, count(*) AS actions, {txt('min(ts)')} AS first_used, {txt('max(ts)')} AS last_used FROM audit WHERE user_id IS NOT NULL AND ip_address IS NOT NULL GROUP BY 1, 2")
def _(t):
    return views.user_addresses(t.audit)


@query("vw24_data_access_log", f"""SELECT id, user_id, user_email, action, resource_type, {txt('ts')} AS ts, ip_address, CASE action WHEN 'READ' THEN 'Viewed' WHEN 'EXPORT' THEN 'Exported'
  WHEN 'UPDATE' THEN 'Modified' WHEN 'DELETE' THEN 'Deleted' END AS access_type FROM audit WHERE action IN ('READ', 'EXPORT', 'UPDATE', 'DELETE')""")
def _(t):
    return views.data_access_log(t.audit)


def _threat(minutes: int) -> str:
    return f"""WITH f AS (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{minutes * 60 - 1}.999999' SECOND PRECEDING AND CURRENT ROW) AS k FROM audit WHERE action = 'LOGIN_FAILED')
      SELECT id, user_id, action, status, ip_address, {txt('ts')} AS ts, CASE WHEN k >= 3 THEN 'BRUTE_FORCE_ATTEMPT' WHEN status = 'denied' THEN 'UNAUTHORIZED_ACCESS'
      WHEN status = 'failed' THEN 'OPERATION_FAILED' ELSE 'OTHER' END AS threat_level FROM audit LEFT JOIN f USING (id) WHERE status IN ('failed', 'denied') OR action = 'LOGIN_FAILED'"""


@query("vw25_security_events", _threat(15))
def _(t):
    return views.security_events(t.audit)


@query("vw25_security_events_day", _threat(1440))
def _(t):
    return views.security_events(t.audit, minutes=1440)


@query("vw26_active_users_summary", f"""SELECT u.id, any_value(username) AS username, any_value(email) AS email, any_value(role) AS role, any_value(hospital_code) AS hospital_code, {txt('any_value(last_login_at)')} AS last_login_at,
  {txt('any_value(created_at)')} AS created_at, count(s.session_id) AS active_sessions FROM users u LEFT JOIN sessions s ON s.user_id = u.id AND s.is_active WHERE u.is_active AND NOT is_deleted GROUP BY 1""")
def _(t):
    return views.active_users_summary(t.users, t.sessions)


@query("vw27_user_login_history", f"""SELECT u.id AS user_id, u.username, u.email, {txt('a.ts')} AS login_time, a.ip_address, a.status FROM users u LEFT JOIN audit a ON a.user_id = u.username
  AND a.action IN ('LOGIN', 'LOGIN_FAILED') AND a.ts > TIMESTAMP '2024-02-01' - INTERVAL 90 DAY WHERE NOT u.is_deleted""")
def _(t):
    return views.user_login_history(t.users, t.audit, _NOW)


@query("vw28_claims_summary_secure", f"SELECT {txt('date_trunc(chr(109) || chr(111) || chr(110) || chr(116) || chr(104), dateadm)::DATE')} AS month, count(*) AS claim_count, {s('reimb_nhso')} AS total_amount, count(DISTINCT pid) AS patient_count FROM claims_core WHERE hcode = '10012' GROUP BY 1")
def _(t):
    return views.claims_summary_secure(t.claims_core, "analyst", "10012")


@query("vw29_recent_imports_secure", f"SELECT filename, {txt('file_date')} AS file_date, status, imported_records, error_message FROM ledger WHERE ledger.file_date >= {AS_OF_SQL} - 30 ORDER BY ledger.file_date DESC, file_id DESC LIMIT 100")
def _(t):
    return views.recent_imports_secure(t.ledger, AS_OF, k=100)


@query("vw30_high_cost_months", f"SELECT {txt('make_date(year(dateadm), month(dateadm), 1)')} AS month, count(*) AS claims, {n('iphc > 0')} AS ip_high_cost, {n('ophc > 0')} AS op_high_cost FROM claims_core GROUP BY 1")
def _(t):
    return views.high_cost_months(t.claims_core)


@query("vw31_recent_claims", f"""SELECT tran_id, {txt('c.dateadm')} AS dateadm, {d('reimb_nhso')} AS reimb_nhso, filename FROM claims_core c LEFT JOIN (SELECT file_id, filename FROM ledger) l USING (file_id)
  ORDER BY c.dateadm DESC NULLS LAST, tran_id LIMIT 100""")
def _(t):
    return reports.recent_claims(t.claims_core, t.ledger).select("tran_id", "dateadm", "reimb_nhso", "filename")


@query("vw31_monthly_by_patient_type", f"SELECT {txt('make_date(year(dateadm), month(dateadm), 1)')} AS month, ptype, count(*) AS claims, {s('reimb_nhso')} AS total_reimb FROM claims_core GROUP BY 1, 2")
def _(t):
    return views.monthly_by_patient_type(t.claims_core)


# --- calendar -------------------------------------------------------------------------------

_HOL = "CASE strftime(d, '%m-%d') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in calendar.HOLIDAYS.items()) + " END"
_THD = "CASE month(d) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in calendar.THAI_MONTHS.items()) + " END"
_DAYS = "SELECT CAST(unnest(generate_series(min(dateadm), max(dateadm), INTERVAL 1 DAY)) AS DATE) AS d FROM claims_core"
_CAL = f"""CAST(strftime(d, '%Y%m%d') AS INT) AS date_id, {txt('d')} AS full_date, CAST(isodow(d) - 1 AS INT) AS day_of_week, dayname(d) AS day_name, CAST(day(d) AS INT) AS day_of_month,
  CAST(dayofyear(d) AS INT) AS day_of_year, CAST(weekofyear(d) AS INT) AS week_of_year, CAST(month(d) AS INT) AS month_number, monthname(d) AS month_name, {_THD} AS month_name_th,
  CAST(quarter(d) AS INT) AS quarter, CAST(year(d) AS INT) AS year, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year,
  {_FQ.replace('dateadm', 'd')} AS fiscal_quarter, isodow(d) >= 6 AS is_weekend, {_HOL} IS NOT NULL AS is_holiday, {_HOL} AS holiday_name"""


@query("dt01_date_dimension", f"SELECT {_CAL} FROM ({_DAYS})")
def _(t):
    return _dim(t)


@query("dt01_date_range", f"""SELECT {_CAL}, coalesce(n, 0) AS claims FROM (SELECT CAST(unnest(generate_series({FY_FROM}, {FY_TO}, INTERVAL 1 DAY)) AS DATE) AS d)
  LEFT JOIN (SELECT dateadm AS d, count(*) AS n FROM claims_core GROUP BY claims_core.dateadm) USING (d)""")
def _(t):
    """Every day of a fiscal year with its claims, also days without any."""
    days = calendar.date_dimension(t.spark, dt.date(1998, 10, 1), dt.date(1999, 9, 30))
    daily = t.claims_core.groupBy(F.col("dateadm").cast("date").alias("_d")).agg(F.count("*").alias("claims"))
    return days.join(daily, F.col("full_date") == F.col("_d"), "left").drop("_d").withColumn("claims", F.coalesce("claims", F.lit(0)))


@query("dt02_extend", f"SELECT {_CAL} FROM (SELECT CAST(unnest(generate_series(max(dateadm) + 1, DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM claims_core)")
def _(t):
    return calendar.extend(_dim(t), 2002)


@query("dt03_listing", f"""SELECT date_id, full_date, day_name, strftime(d, '%d/%m/') || (year + 543) AS date_be, CAST(year + 543 AS INT) AS year_be, CAST(fiscal_year + 543 AS INT) AS fiscal_year_be
  FROM (SELECT d, {_CAL} FROM ({_DAYS})) WHERE fiscal_year = {FY - 543} AND quarter = 4""")
def _(t):
    return calendar.listing(_dim(t), quarter=4, fy_be=FY).select("date_id", "full_date", "day_name", "date_be", "year_be", "fiscal_year_be")


@query("dt03_coverage", f"SELECT {txt('min(d)')} AS first, {txt('max(d)')} AS last, count(*) AS rows, CAST(max(d) - min(d) + 1 AS INT) AS covered_days FROM ({_DAYS})")
def _(t):
    return calendar.coverage(_dim(t))


@query("ag47_dim_coverage", f"SELECT {txt('min(d)')} AS first, {txt('max(d)')} AS last, count(*) AS rows, CAST(max(d) - min(d) + 1 AS INT) AS covered_days FROM (SELECT d FROM ({_DAYS}) WHERE day(d) <> 13)")
def _(t):
    return calendar.coverage(_dim(t).filter(F.col("day_of_month") != 13))
