"""Claim reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import fiscal_year
from ..plans import monthly, reports, sketches
from ..session import fresh_path
from .base import ERR, ERR_DASH, FY, FY_FROM, FY_TO, GAP, IS_IP, OK, YM, av, d, hu, n, query, rt, rtn, s, sw, txt

TREND = f"""SELECT {YM} AS month, count(*) AS claims, {s('reimb_nhso')} AS reimb, {s('paid')} AS paid,
  {s('claim_drg')} AS claim_drg, count(DISTINCT hn) AS patients
  FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12"""


def _summary_sql(rep: str, stm: str, smt: str) -> str:
    return f"""SELECT 'rep' AS feed, count(*) AS total_records, {s('reimb_nhso')} AS total_amount, count(DISTINCT file_id) AS files_count FROM claims WHERE {rep}
      UNION ALL SELECT 'stm', count(*), {s('paid_after_deduction')}, count(DISTINCT file_id) FROM stm_core WHERE {stm}
      UNION ALL SELECT 'smt', count(*), {s('total_amount')}, count(DISTINCT run_date) FROM transfers_core WHERE {smt}"""


@query("ag01_summary_all", _summary_sql("true", "true", "true"))
def _(t):
    return reports.summary(t.claims_core, t.stm_core, t.transfers_core)


@query("ag01_summary_months", _summary_sql(
    "dateadm BETWEEN DATE '1998-11-01' AND DATE '1999-02-28' AND scheme = 'UCS' AND ptype LIKE 'IP%'",
    "date_admit BETWEEN DATE '1998-11-01' AND DATE '1999-02-28'", "posting_date BETWEEN '25411101' AND '25420228'"))
def _(t):
    return reports.summary(t.claims, t.stm_core, t.transfers_core, FY, 11, 2, "UCS", "IP")


OVERVIEW = f"""SELECT count(*) AS total_claims, {s('reimb_nhso')} AS total_reimb, {s('paid')} AS total_paid, {s('claim_drg')} AS total_claim_drg,
  count(DISTINCT hn) AS unique_patients, {n(ERR)} AS total_denied_claims, {sw(ERR, 'claim_drg')} AS total_denied_amount,
  count(DISTINCT {YM}) AS active_months, {rt('sum(reimb_nhso)', 'sum(claim_drg)')} AS reimb_rate,
  {rt('sum(claim_drg)', 'count(*)', 2, 1)} AS avg_claim_per_case, {rt('sum(reimb_nhso)', 'count(*)', 2, 1)} AS avg_reimb_per_case,
  CAST(sum(claim_drg) - sum(reimb_nhso) AS DOUBLE) AS total_loss, {rt(n(ERR), 'count(*)')} AS denial_rate
  FROM claims_core WHERE dateadm IS NOT NULL"""


@query("ag02_overview", OVERVIEW)
def _(t):
    return reports.overview(t.claims_core)


@query("ag02_overview_year", OVERVIEW + f" AND dateadm BETWEEN {FY_FROM} AND {FY_TO}")
def _(t):
    return reports.overview(fiscal_year(t.claims_core, FY))


@query("ag02_sketched_year", f"""SELECT count(*) AS total_claims, {s('reimb_nhso')} AS total_reimb, {s('claim_drg')} AS total_claim_drg, {n(ERR)} AS total_denied_claims, count(DISTINCT {YM}) AS active_months,
  {rt('sum(reimb_nhso)', 'sum(claim_drg)')} AS reimb_rate, {rt(n(ERR), 'count(*)')} AS denial_rate, true AS patients_close, true AS median_close
  FROM claims_core WHERE dateadm BETWEEN {FY_FROM} AND {FY_TO}""")
def _(t):
    """A fiscal year from the sketch table; how far its estimates are off is told by the facts."""
    path = fresh_path(t.spark, "sketches")
    sketches.write_sketches(sketches.monthly_sketches(t.claims_core), path)
    year = sketches.between(t.spark, path, *sketches.fiscal_months(FY))
    facts = fiscal_year(t.claims_core, FY)
    patients = facts.agg(F.countDistinct("hn")).scalar()
    median = sketches.quantiles(year, [0.5]).select("value").scalar()
    rank = facts.where("claim_drg IS NOT NULL").agg(F.count_if(F.col("claim_drg") <= median) / F.count("*")).scalar()
    out = sketches.overview(year).withColumns({"_patients": patients, "_rank": rank})
    close = F.abs(F.col("unique_patients") - F.col("_patients")) <= F.greatest(F.lit(2.0), F.col("_patients") * 2 * sketches.PATIENTS_ERROR)
    out = out.withColumns({"patients_close": close, "median_close": F.abs(F.col("_rank") - 0.5) <= 2 * sketches.RANK_ERROR})
    return out.select("total_claims", "total_reimb", "total_claim_drg", "total_denied_claims", "active_months", "reimb_rate", "denial_rate", "patients_close", "median_close")


@query("ag03_overview_visits", f"""SELECT CASE WHEN {IS_IP} THEN 'IPD' ELSE 'OPD' END AS visit, {n(OK)} AS claims, count(*) AS total_claims,
  {sw(OK, 'claim_drg')} AS claim, {s('claim_drg')} AS total_claim, {sw(OK, 'reimb_nhso')} AS reimb, {n(ERR)} AS fail_claims,
  {sw(ERR, 'claim_drg')} AS fail_claim, {rt(f'sum(CASE WHEN {OK} THEN reimb_nhso END)', f'sum(CASE WHEN {OK} THEN claim_drg END)')} AS reimb_rate,
  {rt(f'sum(CASE WHEN {OK} THEN claim_drg END)', n(OK), 2, 1)} AS avg_claim,
  {rt(f'sum(CASE WHEN {OK} THEN reimb_nhso END)', n(OK), 2, 1)} AS avg_reimb, {rt(n(OK), 'count(*)')} AS success_rate
  FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1""")
def _(t):
    return reports.overview_visits(t.claims_core)


def _detail(kind: str, cond: str) -> str:
    return f"""SELECT '{kind}' AS kind, count(*) AS items, {s('reimb_amount')} AS reimb, {s('claim_amount')} AS claim, count(DISTINCT tran_id) AS cases,
      {rt('sum(reimb_amount)', 'sum(claim_amount)')} AS reimb_rate, {rt('sum(claim_amount)', 'count(DISTINCT tran_id)', 2, 1)} AS avg_claim_per_case,
      {rt('sum(reimb_amount)', 'count(DISTINCT tran_id)', 2, 1)} AS avg_reimb_per_case FROM details_core WHERE {cond}"""


@query("ag04_detail_totals", " UNION ALL ".join([_detail("drug", "true"), _detail("instrument", "row_number <= 3"), _detail("deny", "deny_code IS NOT NULL")]))
def _(t):
    x = t.details_core
    return reports.detail_totals(x, x.filter("row_number <= 3"), x.filter("deny_code IS NOT NULL"))


@query("ag05_per_bed", f"""SELECT beds, {hu('CAST(r AS DOUBLE) / beds / m')} AS reimb_per_bed_month, {hu('CAST(c - r AS DOUBLE) / beds / m')} AS loss_per_bed_month,
  {hu('CAST(k AS DOUBLE) / beds')} AS claims_per_bed, {hu('CAST(r AS DOUBLE) / k')} AS avg_per_claim FROM (
  SELECT sum(reimb_nhso) AS r, sum(claim_drg) AS c, count(*) AS k, count(DISTINCT {YM}) AS m, (SELECT actual_beds FROM offices WHERE hcode5 = '10004') AS beds
  FROM claims_core WHERE dateadm IS NOT NULL)""")
def _(t):
    return reports.per_bed(t.claims_core, t.offices.filter("hcode5 = '10004'"))


@query("ag06_monthly_trend", TREND)
def _(t):
    return reports.monthly_trend(t.claims_core)


@query("ag07_by_service", f"""SELECT coalesce(service_type, '') AS service_type, count(*) AS claims, {s('reimb_nhso')} AS reimb, {s('paid')} AS paid,
  {s('claim_drg')} AS claim_drg, CASE coalesce(service_type, '') WHEN '' THEN 'ไม่ระบุ' WHEN 'E' THEN 'ฉุกเฉิน (E)' WHEN 'R' THEN 'ส่งต่อ (R)'
  WHEN 'P' THEN 'ป้องกัน (P)' END AS label FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1""")
def _(t):
    return reports.by_service(t.claims_core)


@query("ag08_by_fund", f"""SELECT main_fund, count(*) AS claims, {s('reimb_nhso')} AS reimb, {s('paid')} AS paid, {s('claim_drg')} AS claim_drg
  FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1 ORDER BY sum(reimb_nhso) DESC LIMIT 10""")
def _(t):
    return reports.by_fund(t.claims_core)


@query("ag09_top_drg", f"""SELECT drg, count(*) AS cases, {hu(f'coalesce({av("rw")}, 0)', 4)} AS avg_rw, {s('claim_drg')} AS total_drg, {s('paid')} AS total_paid
  FROM claims_core WHERE dateadm IS NOT NULL AND drg <> '' GROUP BY 1 ORDER BY cases DESC, drg LIMIT 15""")
def _(t):
    return reports.top_drg(t.claims_core)


@query("ag10_rw_histogram", """SELECT CASE WHEN rw < 0.5 THEN '< 0.5' WHEN rw < 1 THEN '0.5-1.0' WHEN rw < 2 THEN '1.0-2.0' WHEN rw < 3 THEN '2.0-3.0'
  WHEN rw < 5 THEN '3.0-5.0' ELSE '>= 5.0' END AS rw_range, CASE WHEN rw < 0.5 THEN 1 WHEN rw < 1 THEN 2 WHEN rw < 2 THEN 3 WHEN rw < 3 THEN 4
  WHEN rw < 5 THEN 5 ELSE 6 END AS sort_order, count(*) AS cases FROM claims_core WHERE dateadm IS NOT NULL AND rw IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return reports.rw_histogram(t.claims_core)


@query("ag11_top_drugs", f"""SELECT substr(item_name, 1, 50) AS item_name, count(*) AS prescriptions, {s('quantity')} AS total_qty, {s('reimb_amount')} AS total_cost
  FROM details x JOIN claims_core c USING (tran_id) WHERE item_name IS NOT NULL GROUP BY item_name ORDER BY sum(reimb_amount) DESC, item_name LIMIT 15""")
def _(t):
    return reports.top_drugs(t.details, t.claims_core)


@query("ag12_drug_categories", f"""SELECT item_type, count(*) AS items, {s('claim_amount')} AS total_cost FROM details x JOIN claims_core c USING (tran_id)
  GROUP BY 1 ORDER BY sum(claim_amount) DESC, item_type LIMIT 10""")
def _(t):
    return reports.drug_categories(t.details, t.claims_core)


@query("ag13_top_instruments", f"""SELECT coalesce(item_name, item_code) AS name, count(*) AS uses, {s('quantity')} AS total_qty, {s('claim_amount')} AS total_claim,
  {s('reimb_amount')} AS total_reimb FROM details x JOIN claims_core c USING (tran_id) WHERE row_number <= 3
  GROUP BY 1 ORDER BY sum(claim_amount) DESC, name LIMIT 15""")
def _(t):
    return reports.top_instruments(t.details.filter("row_number <= 3"), t.claims_core)


@query("ag14_denial_codes", f"""SELECT deny_code, count(*) AS cases, {s('claim_amount')} AS total_claim FROM details_core x JOIN claims_core c USING (tran_id)
  WHERE deny_code IS NOT NULL GROUP BY 1 ORDER BY cases DESC, deny_code LIMIT 10""")
def _(t):
    return reports.denial_codes(t.details_core.filter("deny_code IS NOT NULL"), t.claims_core)


@query("ag14_error_codes", f"SELECT error_code, count(*) AS cases FROM claims_core WHERE dateadm IS NOT NULL AND {ERR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return reports.error_codes(t.claims_core)


@query("ag15_comparison", f"""SELECT {YM} AS month, {s('claim_drg')} AS claimed, {s('reimb_nhso')} AS approved, {s('paid')} AS paid,
  {rt('sum(reimb_nhso)', 'sum(claim_drg)')} AS approval_rate FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(t):
    return reports.comparison(t.claims_core)


def _denial_summary(cond: str) -> str:
    return f"""SELECT {n(cond)} AS total_denials, count(DISTINCT CASE WHEN {cond} THEN error_code END) AS unique_error_codes,
      {sw(cond, 'claim_drg')} AS total_denied_amount, {sw(cond, 'reimb_nhso')} AS total_reimb_lost, count(dateadm) AS total_claims,
      {sw('dateadm IS NOT NULL', 'claim_drg')} AS total_claims_amount, {rt(n(cond), 'count(dateadm)')} AS denial_rate FROM claims_core"""


@query("ag16_denial_summary", _denial_summary(ERR))
def _(t):
    return reports.denial_root_cause(t.claims_core)["summary"]


@query("ag16_denial_summary_code", _denial_summary("error_code = '305'") + f" WHERE dateadm BETWEEN {FY_FROM} AND {FY_TO}")
def _(t):
    return reports.denial_summary(fiscal_year(t.claims_core, FY), "305")


@query("ag16_denial_by_code", f"""SELECT error_code, count(*) AS count, {s('claim_drg')} AS amount, {rtn('count(*)', 'sum(count(*)) OVER ()')} AS percentage
  FROM claims_core WHERE {ERR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return reports.denial_root_cause(t.claims_core)["by_error_code"]


@query("ag16_denial_by_service", f"SELECT coalesce(service_type, 'Unknown') AS service_type, count(*) AS count, {s('claim_drg')} AS amount FROM claims_core WHERE {ERR} GROUP BY service_type")
def _(t):
    return reports.denial_root_cause(t.claims_core)["by_service_type"]


@query("ag16_denial_by_fund", f"""SELECT coalesce(main_fund, 'Unknown') AS main_fund, count(*) AS count, {s('claim_drg')} AS amount FROM claims_core WHERE {ERR}
  GROUP BY claims_core.main_fund ORDER BY 2 DESC, claims_core.main_fund NULLS FIRST LIMIT 10""")
def _(t):
    return reports.denial_root_cause(t.claims_core)["by_fund"]


@query("ag16_denial_trend", f"""SELECT {YM} AS month, count(*) AS count, {s('claim_drg')} AS amount FROM claims_core WHERE {ERR} AND dateadm IS NOT NULL
  GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(t):
    return reports.denial_root_cause(t.claims_core)["monthly_trend"]


EFF = f"""count(*) AS claims, {n(OK)} AS passed, {n(ERR)} AS denied, {s('claim_drg')} AS claimed, {s('reimb_nhso')} AS reimbursed,
  {rt(n(OK), 'count(*)', 1)} AS first_pass_rate, {rt(n(ERR), 'count(*)', 1)} AS denial_rate, {rt('sum(reimb_nhso)', 'sum(claim_drg)', 1)} AS reimb_rate,
  CAST(sum(claim_drg) - sum(reimb_nhso) AS DOUBLE) AS loss FROM claims_core WHERE dateadm IS NOT NULL"""


@query("ag17_efficiency", f"SELECT {EFF}")
def _(t):
    return reports.efficiency(t.claims_core)


@query("ag17_efficiency_by_visit", f"SELECT CASE WHEN {IS_IP} THEN 'IP' ELSE 'OP' END AS type, {EFF} GROUP BY 1")
def _(t):
    return reports.efficiency_by_visit(t.claims_core)


@query("ag17_efficiency_by_fund", f"SELECT coalesce(main_fund, 'ไม่ระบุ') AS fund, {EFF} GROUP BY 1 ORDER BY sum(claim_drg) DESC LIMIT 10")
def _(t):
    return reports.efficiency_by_fund(t.claims_core)


@query("ag17_efficiency_trend", f"SELECT month, claims, first_pass_rate, reimb_rate FROM (SELECT {YM} AS month, {EFF} GROUP BY 1 ORDER BY 1 DESC LIMIT 6)")
def _(t):
    return reports.efficiency_trend(t.claims_core)


_FIN = f"""count(*) AS total_cases, {s('coalesce(iphc, 0) + coalesce(ophc, 0)')} AS high_cost_care,
  {s('coalesce(ae_opae, 0) + coalesce(ae_ipnb, 0) + coalesce(ae_ipuc, 0)')} AS emergency, {s('coalesce(inst, 0) + coalesce(opinst, 0)')} AS prosthetics,
  {s('drug')} AS drug_costs, {s('claim_net')} AS total_claimed, {s('reimb_nhso')} AS total_reimbursed FROM claims_core"""


@query("ag18_financial_breakdown", f"""SELECT 'group' AS level, coalesce(main_inscl, 'UNKNOWN') AS scheme, coalesce(ptype, 'UNKNOWN') AS ptype, {_FIN}
  GROUP BY main_inscl, claims_core.ptype UNION ALL SELECT 'total', NULL, NULL, {_FIN}""")
def _(t):
    return reports.financial_breakdown(t.claims_core)


@query("ag19_error_stats", f"""SELECT count(*) AS total_records, {n(ERR_DASH)} AS error_count, {sw(ERR_DASH, 'claim_net')} AS error_amount,
  {s('claim_net')} AS total_claimed, {rt(n(ERR_DASH), 'count(*)')} AS error_rate FROM claims_core""")
def _(t):
    return reports.error_stats(t.claims_core)


@query("ag19_top_errors", f"SELECT error_code, count(*) AS count, {s('claim_net')} AS affected_amount FROM claims_core WHERE {ERR_DASH} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(t):
    return reports.top_errors(t.claims_core)


@query("ag20_scheme_summary", f"""SELECT coalesce(main_inscl, 'UNKNOWN') AS scheme, count(*) AS total_cases, {n("ptype = 'OP'")} AS op_cases, {n("ptype = 'IP'")} AS ip_cases,
  {s('claim_net')} AS total_claimed, {s('reimb_nhso')} AS total_reimbursed, {n(ERR_DASH)} AS error_count, {rt(n(ERR_DASH), 'count(*)')} AS error_rate
  FROM claims_core GROUP BY main_inscl""")
def _(t):
    return reports.scheme_summary(t.claims_core)


@query("ag21_facilities", f"""SELECT hcode, count(*) AS total_cases, {s('claim_net')} AS total_claimed, {s('reimb_nhso')} AS total_reimbursed, {n(ERR_DASH)} AS error_count,
  max(o.name) AS facility, max(o.province) AS province, {rt(n(ERR_DASH), 'count(*)')} AS error_rate
  FROM claims_core c LEFT JOIN offices o ON c.hcode = o.hcode5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    return reports.facilities(t.claims_core, t.offices)


@query("ag21_facility_totals", f"SELECT count(DISTINCT hcode) AS facilities, count(*) AS total_cases, {s('claim_net')} AS total_claimed, {s('reimb_nhso')} AS total_reimbursed FROM claims_core")
def _(t):
    return reports.facility_totals(t.claims_core)


@query("ag22_his_summary", f"""SELECT coalesce(reconcile_status, 'pending') AS status, count(*) AS count, {s('claim_net')} AS total_amount,
  {n('his_amount_diff <> 0')} AS diff_count, {s('abs(his_amount_diff)')} AS total_diff FROM claims_core GROUP BY 1""")
def _(t):
    return reports.his_summary(t.claims_core)


@query("ag22_his_list", f"""SELECT tran_id, his_vn, {d('his_amount_diff')} AS his_amount_diff, {txt('dateadm')} AS dateadm, coalesce(reconcile_status, 'pending') AS status
  FROM claims_core WHERE abs(his_amount_diff) >= 100 ORDER BY abs(claims_core.his_amount_diff) DESC, claims_core.dateadm DESC NULLS LAST, tran_id LIMIT 50""")
def _(t):
    return reports.his_list(t.claims_core, 100, k=50)


@query("ag23_filter_options", """SELECT 'scheme' AS option, scheme AS value, count(*) AS count FROM claims WHERE scheme IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'service_type', coalesce(service_type, ''), count(*) FROM claims GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'fund', main_fund, count(*) FROM claims WHERE main_fund IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)""")
def _(t):
    return reports.filter_options(t.claims)


def _side(p: str, cond: str) -> str:
    return f"""{n(cond)} AS {p}_claims, {sw(cond, 'claim_drg')} AS {p}_claimed, {sw(cond, 'reimb_nhso')} AS {p}_reimb, {sw(cond, 'paid')} AS {p}_paid,
      {n(f'{cond} AND {ERR}')} AS {p}_denials"""


CUR, PREV = f"dateadm BETWEEN {FY_FROM} AND {FY_TO}", "dateadm BETWEEN DATE '1997-10-01' AND DATE '1998-09-30'"


@query("ag25_yoy", f"""WITH y AS (SELECT {_side('cur', CUR)}, {_side('prev', PREV)} FROM claims_core),
  z AS (SELECT *, {rt('cur_denials', 'cur_claims')} AS cur_denial_rate, {rt('cur_reimb', 'cur_claimed')} AS cur_reimb_rate,
  {rt('prev_denials', 'prev_claims')} AS prev_denial_rate, {rt('prev_reimb', 'prev_claimed')} AS prev_reimb_rate FROM y)
  SELECT *, {FY} AS fiscal_year, {rt('cur_claims - prev_claims', 'prev_claims')} AS claims_change, {rt('(cur_claimed - prev_claimed)', 'prev_claimed')} AS claimed_change,
  {rt('(cur_reimb - prev_reimb)', 'prev_reimb')} AS reimb_change, {hu('cur_denial_rate - prev_denial_rate')} AS denial_rate_change,
  {hu('cur_reimb_rate - prev_reimb_rate')} AS reimb_rate_change FROM z""")
def _(t):
    return reports.yoy(t.claims_core, FY)


@query("ag25_yoy_monthly", f"""WITH m AS (SELECT CAST(month(dateadm) AS INT) AS month_num, {n(CUR)} AS current_claims, {sw(CUR, 'reimb_nhso')} AS current_reimb,
  {n(PREV)} AS prev_claims, {sw(PREV, 'reimb_nhso')} AS prev_reimb FROM claims_core WHERE {CUR} OR {PREV} GROUP BY 1)
  SELECT month_num, f.month, coalesce(current_claims, 0) AS current_claims, coalesce(current_reimb, 0) AS current_reimb, coalesce(prev_claims, 0) AS prev_claims,
  coalesce(prev_reimb, 0) AS prev_reimb, {rt('(coalesce(current_claims, 0) - coalesce(prev_claims, 0))', 'prev_claims')} AS claims_change,
  {rt('(coalesce(current_reimb, 0) - coalesce(prev_reimb, 0))', 'prev_reimb')} AS reimb_change
  FROM (VALUES (10,'ต.ค.'),(11,'พ.ย.'),(12,'ธ.ค.'),(1,'ม.ค.'),(2,'ก.พ.'),(3,'มี.ค.'),(4,'เม.ย.'),(5,'พ.ค.'),(6,'มิ.ย.'),(7,'ก.ค.'),(8,'ส.ค.'),(9,'ก.ย.')) f(month_num, month)
  LEFT JOIN m USING (month_num)""")
def _(t):
    return reports.yoy_monthly(t.claims_core, FY)


@query("ag25_default_year", "SELECT CAST(year(max(dateadm)) + CASE WHEN month(max(dateadm)) >= 10 THEN 544 ELSE 543 END AS INT) AS fiscal_year, count(*) AS claims FROM claims_core")
def _(t):
    return t.claims_core.agg(F.count("*").alias("claims")).withColumn("fiscal_year", reports.default_fiscal_year(t.claims_core))


def _risk(group: str, name: str, where: str, least: int, tail: str = "") -> str:
    rate = rtn(n(ERR), "count(*)")
    return f"""SELECT *, CASE WHEN error_rate > 10 THEN 'high' WHEN error_rate > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM (
      SELECT {group} AS {name}, count(*) AS total_claims, {n(ERR)} AS error_claims, {rate} AS error_rate FROM claims_core WHERE {where} GROUP BY 1
      HAVING count(*) >= {least}) r {tail}"""


@query("ag28_risk_by_service", _risk("service_type", "service_type", "service_type <> ''", 10))
def _(t):
    return reports.risk_by_service(t.claims_core)


@query("ag28_risk_by_fund", _risk("main_fund", "fund", "main_fund <> ''", 5))
def _(t):
    return reports.risk_by_fund(t.claims_core)


@query("ag28_risk_by_drg", _risk("substr(drg, 1, 3)", "drg_group", "drg <> ''", 5, "ORDER BY error_rate DESC, drg_group LIMIT 20"))
def _(t):
    return reports.risk_by_drg(t.claims_core)


_X = "coalesce(claim_drg, 0)"


@query("ag28_risk_by_amount", f"""SELECT *, CASE WHEN error_rate > 10 THEN 'high' WHEN error_rate > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM (
  SELECT CASE WHEN {_X} < 1000 THEN 'Under 1,000' WHEN {_X} < 5000 THEN '1,000-5,000' WHEN {_X} < 10000 THEN '5,000-10,000' WHEN {_X} < 50000 THEN '10,000-50,000'
  ELSE 'Over 50,000' END AS amount_range, CASE WHEN {_X} < 1000 THEN 1 WHEN {_X} < 5000 THEN 2 WHEN {_X} < 10000 THEN 3 WHEN {_X} < 50000 THEN 4 ELSE 5 END AS sort_order,
  count(*) AS total_claims, {n(ERR)} AS error_claims, {rtn(n(ERR), 'count(*)')} AS error_rate FROM claims_core GROUP BY 1, 2)""")
def _(t):
    return reports.risk_by_amount(t.claims_core)


@query("ag28_risk_summary", f"SELECT count(*) AS total_claims, {n(ERR)} AS total_errors, {rt(n(ERR), 'count(*)')} AS overall_error_rate FROM claims_core")
def _(t):
    return reports.risk_summary(t.claims_core)


_UNDER = "coalesce(claim_drg, 0) > coalesce(paid, 0) + 100"


@query("ag29_under_reimbursed", f"""SELECT tran_id, hn, {txt('dateadm')} AS dateadm, service_type, drg, {d('claim_drg')} AS claim_drg, {d('reimb_nhso')} AS reimb_nhso,
  {d('paid')} AS paid, {d(GAP)} AS potential_recovery FROM claims_core WHERE {_UNDER} AND {OK}
  ORDER BY coalesce(claims_core.claim_drg, 0) - coalesce(claims_core.paid, 0) DESC, tran_id LIMIT 30""")
def _(t):
    return reports.under_reimbursed(t.claims_core)


@query("ag29_fund_gaps", f"SELECT main_fund AS fund, count(*) AS claims, {d(f'sum({GAP})')} AS total_gap, {av(GAP)} AS avg_gap FROM claims_core WHERE {_UNDER} AND main_fund <> '' GROUP BY 1")
def _(t):
    return reports.fund_gaps(t.claims_core)


@query("ag29_resubmit", f"SELECT error_code, count(*) AS count, {s(_X)} AS total_value, {av(_X)} AS avg_value FROM claims_core WHERE {ERR} GROUP BY 1 ORDER BY sum({_X}) DESC, 1 LIMIT 15")
def _(t):
    return reports.resubmit(t.claims_core)


@query("ag29_opportunity_summary", f"""SELECT count(*) AS total_claims, {s('claim_drg')} AS total_claimed, {s('paid')} AS total_paid, {n(ERR)} AS error_claims,
  {sw(ERR, 'claim_drg')} AS error_claim_value, {d('sum(claim_drg) - sum(paid)')} AS total_gap, {rt('sum(paid)', 'sum(claim_drg)')} AS reimbursement_rate FROM claims_core""")
def _(t):
    return reports.opportunity_summary(t.claims_core)


_REP_M = f"""SELECT {YM} AS month_gregorian, CAST(year(dateadm) + 543 AS VARCHAR) || strftime(dateadm, '%m') AS month_be, coalesce(main_fund, 'UNKNOWN') AS main_fund,
  count(*) AS claim_count, {s('reimb_nhso')} AS reimb_nhso, {s('reimb_agency')} AS reimb_agency,
  CAST(coalesce(sum(reimb_nhso), 0) + coalesce(sum(reimb_agency), 0) AS DOUBLE) AS total_claim FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1, 2, claims_core.main_fund"""


@query("ag35_rep_monthly", _REP_M)
def _(t):
    return monthly.rep_monthly(t.claims_core)


@query("ag36_smt_monthly", f"""SELECT substr(posting_date, 1, 6) AS month_be, fund_group_desc, fund_name, count(*) AS payment_count, {s('total_amount')} AS total_amount,
  CAST(CAST(substr(posting_date, 1, 4) AS INT) - 543 AS VARCHAR) || '-' || substr(posting_date, 5, 2) AS month_gregorian FROM transfers GROUP BY 1, 2, 3, 6""")
def _(t):
    return monthly.smt_monthly(t.transfers)


@query("ag36_smt_monthly_vendor", f"""SELECT substr(posting_date, 1, 6) AS month_be, fund_group_desc, fund_name, count(*) AS payment_count, {s('total_amount')} AS total_amount,
  CAST(CAST(substr(posting_date, 1, 4) AS INT) - 543 AS VARCHAR) || '-' || substr(posting_date, 5, 2) AS month_gregorian FROM transfers
  WHERE ltrim(vendor_no, '0') = '10003' GROUP BY 1, 2, 3, 6""")
def _(t):
    return monthly.smt_monthly(t.transfers, "10003")


def _month_merge(rep_where: str, smt_where: str, join: str) -> str:
    return f"""WITH r AS (SELECT CAST(year(dateadm) + 543 AS VARCHAR) || strftime(dateadm, '%m') AS month_be, count(*) AS claim_count, count(DISTINCT tran_id) AS unique_claims,
      coalesce(sum(reimb_nhso), 0) AS reimb_nhso, coalesce(sum(reimb_agency), 0) AS reimb_agency FROM claims_core WHERE dateadm IS NOT NULL AND {rep_where} GROUP BY 1),
    p AS (SELECT substr(posting_date, 1, 6) AS month_be, count(*) AS payment_count, sum(total_amount) AS payment_amount, sum(wait_amount) AS wait_amount,
      sum(debt_amount) AS debt_amount FROM transfers_core WHERE {smt_where} GROUP BY 1)
    SELECT month_be, coalesce(claim_count, 0) AS claim_count, coalesce(unique_claims, 0) AS unique_claims, {d('coalesce(reimb_nhso, 0)')} AS reimb_nhso,
      {d('coalesce(reimb_agency, 0)')} AS reimb_agency, coalesce(payment_count, 0) AS payment_count, {d('coalesce(payment_amount, 0)')} AS payment_amount,
      {d('coalesce(wait_amount, 0)')} AS wait_amount, {d('coalesce(debt_amount, 0)')} AS debt_amount, claim_count IS NOT NULL AS has_rep_data,
      payment_count IS NOT NULL AS has_smt_data, {d('coalesce(reimb_nhso, 0) + coalesce(reimb_agency, 0)')} AS claim_total,
      {d('coalesce(payment_amount, 0) - coalesce(reimb_nhso, 0) - coalesce(reimb_agency, 0)')} AS difference,
      CAST(CAST(substr(month_be, 1, 4) AS INT) - 543 AS VARCHAR) || '-' || substr(month_be, 5, 2) AS month_gregorian,
      substr(month_be, 5, 2) || '/' || substr(month_be, 1, 4) AS month_display FROM {join}"""


MONTH_ALL = _month_merge("true", "true", "r FULL JOIN p USING (month_be)")
MONTH_FY = _month_merge(
    f"dateadm BETWEEN {FY_FROM} AND {FY_TO}", "posting_date BETWEEN '25411001' AND '25420930' AND ltrim(vendor_no, '0') = '10003'",
    "(SELECT CAST(unnest([254110,254111,254112,254201,254202,254203,254204,254205,254206,254207,254208,254209]) AS VARCHAR) AS month_be) f LEFT JOIN r USING (month_be) LEFT JOIN p USING (month_be)",
)


@query("jn17_monthly_reconciliation", MONTH_ALL)
def _(t):
    return monthly.monthly_reconciliation(t.claims_core, t.transfers_core)


@query("jn18_monthly_reconciliation_fy", MONTH_FY)
def _(t):
    return monthly.monthly_reconciliation_fy(t.claims_core, t.transfers_core, FY, "10003")


_MAP = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in monthly.FUND_GROUPS.items()) + ") m(code, grp)"


def _fund_sql(rep: str, pay: str, group: str) -> str:
    return f"""WITH r AS (SELECT coalesce(main_fund, 'UNKNOWN') AS rep_fund_code, count(*) AS claim_count, sum(reimb_nhso) AS claim_amount FROM claims_core
        WHERE dateadm IS NOT NULL AND {rep} GROUP BY main_fund),
      rm AS (SELECT r.*, coalesce(grp, 'ไม่ระบุ') AS smt_fund_name FROM r LEFT JOIN {_MAP} ON code = split_part(rep_fund_code, ',', 1)),
      p AS (SELECT {group} AS smt_fund_name, count(*) AS payment_count, sum(total_amount) AS payment_amount FROM transfers WHERE {pay} GROUP BY 1)
      SELECT rep_fund_code, smt_fund_name, claim_count, {d('claim_amount')} AS claim_amount, coalesce(payment_count, 0) AS payment_count,
        {d('coalesce(payment_amount, 0)')} AS payment_amount, payment_count IS NOT NULL AS matched, {d('coalesce(payment_amount, 0) - claim_amount')} AS difference
      FROM rm LEFT JOIN p USING (smt_fund_name)
      UNION ALL SELECT '-', smt_fund_name, 0, 0.0, payment_count, {d('payment_amount')}, false, {d('payment_amount')} FROM p
      WHERE smt_fund_name NOT IN (SELECT smt_fund_name FROM rm WHERE smt_fund_name <> 'ไม่ระบุ')"""


_GROUP = "CASE fund_group_desc WHEN 'ECONOMY' THEN 'กองทุนผู้ป่วยใน' WHEN 'SMALL' THEN 'กองทุนไตวายเรื้อรัง' ELSE fund_group_desc END"


def _thai_groups(t):
    g = F.col("fund_group_desc")
    return t.transfers.withColumn("fund_group_desc", F.when(g == "ECONOMY", "กองทุนผู้ป่วยใน").when(g == "SMALL", "กองทุนไตวายเรื้อรัง").otherwise(g))


@query("jn19_fund_reconciliation", _fund_sql("true", "true", _GROUP))
def _(t):
    return monthly.fund_reconciliation(t.claims_core, _thai_groups(t))


@query("jn19_fund_reconciliation_month", _fund_sql("strftime(dateadm, '%Y-%m') = '1999-03'", "substr(posting_date, 1, 6) = '254203'", _GROUP))
def _(t):
    return monthly.fund_reconciliation(t.claims_core, _thai_groups(t), "254203")


def _stats_sql(rep: str, pay: str) -> str:
    be = "strptime(CAST(CAST({0} AS BIGINT) - 5430000 AS VARCHAR), '%Y%m%d')::DATE"
    return f"""SELECT r.*, p.* FROM (SELECT count(*) AS total_claims, count(DISTINCT tran_id) AS unique_claims, {s('reimb_nhso')} AS total_reimb_nhso,
      {s('reimb_agency')} AS total_reimb_agency, {txt('min(dateadm)')} AS rep_first, {txt('max(dateadm)')} AS rep_last,
      {d('coalesce(sum(reimb_nhso), 0) + coalesce(sum(reimb_agency), 0)')} AS rep_amount FROM claims_core WHERE {rep}) r,
      (SELECT count(*) AS total_payments, {s('total_amount')} AS smt_amount, {s('wait_amount')} AS smt_wait, {s('debt_amount')} AS smt_debt,
      {txt(be.format('min(posting_date)'))} AS smt_first, {txt(be.format('max(posting_date)'))} AS smt_last FROM transfers_core WHERE {pay}) p"""


@query("ag37_summary_stats", _stats_sql("true", "true"))
def _(t):
    return monthly.summary_stats(t.claims_core, t.transfers_core)


@query("ag37_summary_stats_fy", _stats_sql(f"dateadm BETWEEN {FY_FROM} AND {FY_TO}", "posting_date BETWEEN '25411001' AND '25420930' AND ltrim(vendor_no, '0') = '10003'"))
def _(t):
    return monthly.summary_stats(t.claims_core, t.transfers_core, FY, "10003")


@query("ag38_performance", f"""WITH m AS ({MONTH_ALL.replace('WITH r AS', 'WITH r AS', 1)}), st AS ({_stats_sql('true', 'true')}),
  a AS (SELECT count(*) AS total_months, {n('has_rep_data AND has_smt_data AND claim_total > 0 AND abs(difference / nullif(claim_total, 0)) < 0.01')} AS matched_months,
  {n('has_rep_data AND has_smt_data AND difference < 0')} AS underpaid_months, {n('has_rep_data AND NOT has_smt_data')} AS pending_months,
  (SELECT month_be FROM m WHERE has_rep_data ORDER BY claim_total DESC, month_be DESC LIMIT 1) AS top_month FROM m)
  SELECT total_claims, a.*, {rt('matched_months', 'total_months', 6)} AS payment_accuracy, {rt('underpaid_months', 'total_months', 6)} AS underpayment_rate,
  {rt('pending_months', 'total_months', 6)} AS pending_rate, {rt('smt_amount', 'rep_amount', 6)} AS claim_to_payment_ratio,
  {hu('(smt_amount - rep_amount) / total_claims', 6)} AS avg_difference, {rt('rep_amount', 'smt_amount', 6)} AS coverage_rate,
  {rt('rep_amount', 'total_claims', 6, 1)} AS avg_claim_amount, CASE WHEN smt_amount > rep_amount THEN round(smt_amount - rep_amount, 2) ELSE 0.0 END AS missing_amount,
  CASE WHEN rep_amount / smt_amount * 100 < 20 THEN 'critical' WHEN rep_amount / smt_amount * 100 < 50 THEN 'warning' WHEN rep_amount / smt_amount * 100 < 80 THEN 'caution'
  ELSE 'good' END AS alert_level, CAST(floor(smt_amount / (rep_amount / total_claims)) AS BIGINT) AS expected_claims,
  greatest(0, CAST(floor(smt_amount / (rep_amount / total_claims)) AS BIGINT) - total_claims) AS missing_claims FROM a, st""")
def _(t):
    return monthly.performance(monthly.summary_stats(t.claims_core, t.transfers_core), monthly.monthly_reconciliation(t.claims_core, t.transfers_core))


_FYQ = "CAST(year({0}) + CASE WHEN month({0}) >= 10 THEN 544 ELSE 543 END AS INT)"


@query("ag40_fiscal_years", f"""SELECT {_FYQ.format('dateadm')} AS fiscal_year FROM claims_core WHERE dateadm IS NOT NULL
  UNION SELECT CAST(substr(posting_date, 1, 4) AS INT) + CASE WHEN CAST(substr(posting_date, 5, 2) AS INT) >= 10 THEN 1 ELSE 0 END FROM transfers_core""")
def _(t):
    return reports.fiscal_years(t.claims_core, t.transfers_core)


def _ext(code: str) -> str:
    return f"""SELECT {code} AS code, count(*) AS total_claims, {s('claim_net')} AS total_amount, {n('his_matched')} AS matched,
      {n('his_matched IS DISTINCT FROM true')} AS unmatched, {rt(n('his_matched'), 'count(*)', 4, 1)} AS match_rate FROM claims
      WHERE dateadm BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1"""


@query("ag41_external_summary", _ext("upper(substr(rep_no, 1, 3))") + " UNION ALL " + _ext("'ALL'"))
def _(t):
    return reports.external_summary(t.claims.filter("dateadm BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"))


@query("ag53_monthly_export", f"SELECT month, claims, claimed, reimbursed, denied, reimb_rate FROM (SELECT {YM} AS month, {EFF} GROUP BY 1)")
def _(t):
    return reports.monthly_export(t.claims_core)


@query("ag53_denial_export", f"SELECT error_code, count(*) AS count, {s('claim_drg')} AS amount, {rtn('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM claims_core WHERE {ERR} GROUP BY 1")
def _(t):
    return reports.denial_export(t.claims_core)
