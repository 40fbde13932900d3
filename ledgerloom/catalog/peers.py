"""Hospitals compared, targets, alerts and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..plans import alerts, peers
from .base import AS_OF, AS_OF_SQL, ERR, FY, FY_FROM, FY_TO, OK, YM, av, d, hu, n, query, rt, rtn, s, sw, txt

_IN_FY = f"run_date BETWEEN {FY_FROM} AND {FY_TO}"
_IN_PREV = "run_date BETWEEN DATE '1997-10-01' AND DATE '1998-09-30'"
VENDOR = "10003"
_MINE = "vendor_no IN ('10003', '0000010003')"
_SUMS = f"{s('total_amount')} AS total_amount, {s('wait_amount')} AS wait_amount, {s('debt_amount')} AS debt_amount"


@query("ag30_hospitals", f"""SELECT vendor_no, count(*) AS records, {_SUMS}, {s('bond_amount')} AS bond_amount, {txt('min(run_date)')} AS first_date, {txt('max(run_date)')} AS last_date,
  h.name AS hospital_name FROM transfers_core LEFT JOIN offices h ON h.hcode5 = ltrim(vendor_no, '0') OR h.hcode5 = vendor_no WHERE {_IN_FY} GROUP BY vendor_no, h.name""")
def _(t):
    return peers.hospitals(t.transfers_core, t.offices, FY)


@query("ag31_timeseries", f"SELECT vendor_no, strftime(run_date, '%Y-%m') AS month, count(*) AS records, {_SUMS} FROM transfers_core WHERE run_date BETWEEN DATE '1998-10-01' AND DATE '1999-03-31' GROUP BY 1, 2")
def _(t):
    return peers.timeseries(t.transfers_core, FY, 10, 3)


@query("ag31_timeseries_nested", f"""SELECT vendor_no, CAST(count(*) AS INT) AS months, {d('max(v)')} AS march FROM (SELECT vendor_no, strftime(run_date, '%Y-%m') AS m, CASE WHEN strftime(run_date, '%Y-%m') = '1999-03'
  THEN sum(total_amount) END AS v FROM transfers_core WHERE {_IN_FY} GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    out = peers.timeseries_nested(t.transfers_core, FY)
    return out.select("vendor_no", F.size("months").alias("months"), F.try_element_at("months", F.lit("1999-03")).alias("march"))


_RFY = "CAST(year(run_date) + CASE WHEN month(run_date) >= 10 THEN 544 ELSE 543 END AS INT)"


@query("ag32_vendor_years", f"""WITH m AS (SELECT {_RFY} AS year, count(*) AS records, sum(total_amount) AS total_amount FROM transfers_core
  WHERE TRY_CAST(regexp_replace(vendor_no, '[^0-9]', '', 'g') AS BIGINT) = 10003 GROUP BY 1)
  SELECT year, coalesce(records, 0) AS records, {d('coalesce(total_amount, 0)')} AS total_amount, records IS NOT NULL AS has_data
  FROM (SELECT CAST(unnest(range(2530, 2545)) AS INT) AS year UNION SELECT year FROM m) y LEFT JOIN m USING (year)""")
def _(t):
    return peers.vendor_years(t.transfers_core, VENDOR, AS_OF, since=2530)


_FUND = "CASE fund_name WHEN 'Brand#1' THEN 'IP_CF' WHEN 'Brand#2' THEN 'ค่าผู้ป่วยนอก' WHEN 'Brand#3' THEN 'กองทุน central reimburse' WHEN 'Brand#4' THEN 'ควบคุมและป้องกัน' ELSE fund_name END"
_CAT = "CASE WHEN fund = 'IP_CF' THEN 'IPD' WHEN fund = 'ค่าผู้ป่วยนอก' THEN 'OPD' WHEN fund = 'กองทุน central reimburse' THEN 'CR' WHEN fund = 'ควบคุมและป้องกัน' THEN 'PP' ELSE 'OTHER' END"


def _named(t):
    return t.transfers.withColumn("fund_name", F.expr(_FUND))


_HS = f"""WITH x AS (SELECT *, {_FUND} AS fund FROM transfers WHERE {_MINE}), a AS (SELECT {n(_IN_FY)} AS record_count, {sw(_IN_FY, 'total_amount')} AS total_amount,
  {sw(_IN_FY, 'wait_amount')} AS wait_amount, {sw(_IN_FY, 'debt_amount')} AS debt_amount, {sw(_IN_FY, 'bond_amount')} AS bond_amount, {sw(_IN_PREV, 'total_amount')} AS prev_total,
  {sw(f"{_IN_FY} AND {_CAT} = 'IPD'", 'total_amount')} AS ipd_amount, {sw(f"{_IN_FY} AND {_CAT} = 'IPD'", 'wait_amount')} AS iw, {sw(f"{_IN_FY} AND {_CAT} = 'IPD'", 'debt_amount')} AS idb,
  {sw(f"{_IN_FY} AND {_CAT} = 'OPD'", 'total_amount')} AS opd_amount, (SELECT max(actual_beds) FROM offices WHERE hcode5 = '{VENDOR}') AS actual_beds FROM x)"""
_SCORE = """CAST(floor(least(100.0, wait_ratio / 20 * 100) * 0.3 + least(100.0, debt_ratio / 15 * 100) * 0.4 + CASE WHEN g >= 0 THEN 0 ELSE least(100.0, abs(g) * 2) END * 0.3) AS INT)"""


@query("ag33_hospital_summary", f"""{_HS}, b AS (SELECT * EXCLUDE (iw, idb), {rt('wait_amount', 'total_amount', 6)} AS wait_ratio, {rt('debt_amount', 'total_amount', 6)} AS debt_ratio,
  {rt('ipd_amount', 'total_amount', 1)} AS ipd_ratio, {rt('opd_amount', 'total_amount', 1)} AS opd_ratio, {rt('ipd_amount', 'actual_beds', 2, 1)} AS ipd_revenue_per_bed,
  {rt('iw', 'actual_beds', 2, 1)} AS wait_per_bed, {rt('idb', 'actual_beds', 2, 1)} AS debt_per_bed, (total_amount - prev_total) / prev_total * 100 AS g FROM a)
  SELECT * EXCLUDE (g), {hu('g', 1)} AS growth_yoy, {_SCORE} AS risk_score, CASE WHEN {_SCORE} < 40 THEN 'low' WHEN {_SCORE} < 70 THEN 'medium' ELSE 'high' END AS risk_level FROM b""")
def _(t):
    return peers.hospital_summary(_named(t), t.offices, VENDOR, FY)


@query("ag33_hospital_categories", f"""WITH x AS (SELECT *, {_FUND} AS fund FROM transfers WHERE {_MINE} AND {_IN_FY}), c AS (SELECT {_CAT} AS category, count(*) AS records, {_SUMS} FROM x GROUP BY 1)
  SELECT category, coalesce(records, 0) AS records, coalesce(total_amount, 0) AS total_amount, coalesce(wait_amount, 0) AS wait_amount, coalesce(debt_amount, 0) AS debt_amount,
  {rt('coalesce(total_amount, 0)', '(SELECT sum(total_amount) FROM x)', 1)} AS ratio FROM (VALUES ('OPD'),('IPD'),('CR'),('PP'),('OTHER')) f(category) LEFT JOIN c USING (category)""")
def _(t):
    return peers.hospital_categories(_named(t), VENDOR, FY)


@query("ag33_hospital_funds", f"""SELECT fund_name, fund_group, fund_group_desc, {s('total_amount')} AS amount, count(*) AS records, {rt('sum(total_amount)', 'sum(sum(total_amount)) OVER ()', 6)} AS percentage
  FROM transfers WHERE {_MINE} AND {_IN_FY} GROUP BY 1, 2, 3""")
def _(t):
    return peers.hospital_funds(t.transfers, VENDOR, FY)


@query("ag33_hospital_months", f"SELECT strftime(run_date, '%Y-%m') AS month, count(*) AS records, {_SUMS} FROM transfers_core WHERE {_MINE} AND {_IN_FY} GROUP BY 1")
def _(t):
    return peers.hospital_months(t.transfers_core, VENDOR, FY)


REGION = "ASIA"
_INREG = f"{_IN_FY} AND ltrim(vendor_no, '0') IN (SELECT hcode5 FROM offices WHERE health_region = '{REGION}')"


@query("ag34_region_average", f"""SELECT *, {rt('avg_wait_amount', 'avg_total_amount', 6)} AS avg_wait_ratio, {rt('avg_debt_amount', 'avg_total_amount', 6)} AS avg_debt_ratio FROM (
  SELECT count(*) AS hospital_count, {av('a')} AS avg_total_amount, {av('b')} AS avg_wait_amount, {av('c')} AS avg_debt_amount, {d('sum(a)')} AS total_amount
  FROM (SELECT sum(total_amount) AS a, sum(wait_amount) AS b, sum(debt_amount) AS c FROM transfers_core WHERE {_INREG} GROUP BY vendor_no))""")
def _(t):
    return peers.region_average(t.transfers_core, t.offices, REGION, FY)


@query("ag34_region_funds", f"""SELECT fund_name, fund_group, {av('a')} AS avg_amount, {d('sum(a)')} AS total_amount FROM (SELECT vendor_no, fund_name, fund_group, sum(total_amount) AS a
  FROM transfers WHERE {_INREG} GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return peers.region_funds(t.transfers, t.offices, REGION, FY)


@query("ag34_region_months", f"SELECT strftime(run_date, '%Y-%m') AS month, {s('total_amount')} AS total_amount, {av('total_amount')} AS avg_amount FROM transfers_core WHERE {_INREG} GROUP BY 1")
def _(t):
    return peers.region_months(t.transfers_core, t.offices, REGION, FY)


@query("ag51_risk_scores", f"""WITH a AS (SELECT CAST(ltrim(vendor_no, '0') AS BIGINT) AS vendor, {sw(_IN_FY, 'total_amount')} AS total_amount, {sw(_IN_FY, 'wait_amount')} AS w, {sw(_IN_FY, 'debt_amount')} AS b,
  {sw(_IN_PREV, 'total_amount')} AS p FROM transfers_core WHERE {_IN_FY} OR {_IN_PREV} GROUP BY 1),
  r AS (SELECT vendor, total_amount, {rt('w', 'total_amount', 6)} AS wait_ratio, {rt('b', 'total_amount', 6)} AS debt_ratio, CASE WHEN p > 0 THEN (total_amount - p) / p * 100 ELSE 0 END AS g FROM a)
  SELECT vendor, total_amount, {_SCORE} AS risk_score, CASE WHEN {_SCORE} < 40 THEN 'low' WHEN {_SCORE} < 70 THEN 'medium' ELSE 'high' END AS risk_level FROM r""")
def _(t):
    return peers.risk_all(t.transfers_core, FY)


@query("ag52_ranking", f"""WITH h AS (SELECT vendor_no, sum(total_amount) AS v FROM transfers_core WHERE {_IN_FY} GROUP BY 1), m AS (SELECT sum(total_amount) AS v FROM transfers_core WHERE {_IN_FY} AND {_MINE}),
  r AS (SELECT count(*) FILTER (WHERE h.v > m.v) + 1 AS rank, count(*) AS total FROM h, m)
  SELECT rank, total, CAST(trunc((1 - CAST(rank AS DOUBLE) / CAST(total AS DOUBLE)) * 100) AS BIGINT) AS percentile FROM r""")
def _(t):
    return peers.ranking(t.transfers_core, VENDOR, FY)


_BM = f"""SELECT {rt('sum(reimb_nhso)', 'sum(claim_drg)')} AS reimb_rate, {rt(n("error_code NOT IN ('', '0')"), 'count(*)')} AS denial_rate,
  {hu(av("CASE WHEN ptype = 'IP' THEN claim_drg END"))} AS avg_claim_ip, {hu(av("CASE WHEN ptype = 'OP' THEN claim_drg END"))} AS avg_claim_op, {hu(av('rw'), 4)} AS avg_rw,
  count(*) AS total_claims, {txt('min(dateadm)')} AS min_date, {txt('max(dateadm)')} AS max_date FROM claims_core WHERE claim_drg > 0"""


@query("ag26_benchmark_metrics", _BM)
def _(t):
    return peers.benchmark_metrics(t.claims_core)


# Targets per region: the region's own claims stand in for its peers.
def _targets(t):
    region = F.coalesce("main_inscl", F.lit("national"))
    per = t.claims_core.groupBy(region.alias("region")).agg(
        F.floor(F.count("*") / 100).alias("denial_rate"), F.floor(F.count("*") / 50).alias("reimb_rate"), F.floor(F.count("hn") / 2).alias("avg_claim_ip")
    )
    per = per.withColumn("avg_claim_ip", F.when(F.col("region") != "OFC", F.col("avg_claim_ip")))
    long = per.unpivot(["region"], ["denial_rate", "reimb_rate", "avg_claim_ip"], "metric_name", "value").filter("value IS NOT NULL")
    return long.withColumn("fiscal_year", F.lit(2568))


_TGT = """per AS (SELECT coalesce(main_inscl, 'national') AS region, count(*) AS k FROM claims_core GROUP BY 1),
  tgt AS (SELECT 'denial_rate' AS metric_name, region, floor(k / 100.0) AS value FROM per UNION ALL SELECT 'reimb_rate', region, floor(k / 50.0) FROM per
  UNION ALL SELECT 'avg_claim_ip', region, floor(k / 2.0) FROM per WHERE region <> 'OFC'),
  best AS (SELECT metric_name, CAST(value AS DOUBLE) AS benchmark_value FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN region = 'OFC' THEN 0 ELSE 1 END) AS rn
  FROM tgt WHERE region IN ('OFC', 'national')) WHERE rn = 1)"""
_CMP = f"""{_TGT}, bm AS ({_BM}), long AS (SELECT 'reimb_rate' AS metric_name, reimb_rate AS hospital_value FROM bm UNION ALL SELECT 'denial_rate', denial_rate FROM bm
  UNION ALL SELECT 'avg_claim_ip', avg_claim_ip FROM bm UNION ALL SELECT 'avg_rw', avg_rw FROM bm),
  cmp AS (SELECT metric_name, hospital_value, benchmark_value, {hu('hospital_value - benchmark_value')} AS difference, CASE WHEN metric_name = 'avg_claim_ip'
  THEN {rt('(hospital_value - benchmark_value)', 'benchmark_value', 1)} END AS difference_pct, CASE WHEN hospital_value > benchmark_value THEN 'above' WHEN hospital_value < benchmark_value THEN 'below' ELSE 'equal' END AS status,
  CASE metric_name WHEN 'denial_rate' THEN hospital_value <= benchmark_value WHEN 'reimb_rate' THEN hospital_value >= benchmark_value END AS is_good FROM long JOIN best USING (metric_name))"""


@query("ag27_benchmark_compare", f"WITH {_CMP} SELECT * FROM cmp")
def _(t):
    return peers.benchmark_compare(peers.benchmark_metrics(t.claims_core), _targets(t), "OFC", 2568)


@query("ag27_benchmark_score", f"""WITH {_CMP} SELECT *, CASE WHEN scored = 0 THEN 'unknown' WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'needs_improvement' END AS overall_status
  FROM (SELECT {n('is_good')} AS good, count(is_good) AS scored, CAST(round({n('is_good')} / nullif(count(is_good), 0) * 100) AS INT) AS score FROM cmp)""")
def _(t):
    return peers.benchmark_score(peers.benchmark_compare(peers.benchmark_metrics(t.claims_core), _targets(t), "OFC", 2568))


_START = "DATE '2001-07-01'"
_ALERTS = f"""WITH now AS (SELECT count(*) AS k, {rt(n(ERR), 'count(*)')} AS denial, {rt('sum(paid)', 'sum(claim_drg)')} AS rate FROM claims_core WHERE dateadm >= {_START}),
  m AS (SELECT {YM} AS month, CAST(sum(reimb_nhso) AS DOUBLE) AS v FROM claims_core WHERE dateadm >= DATE '2001-05-01' GROUP BY 1 ORDER BY 1 DESC LIMIT 2),
  mom AS (SELECT round((max_by(v, month) - min_by(v, month)) / min_by(v, month) * 100, 2) AS c FROM m),
  w AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM claims_core WHERE coalesce(paid, 0) = 0 AND claim_drg > 0 AND dateadm < {AS_OF_SQL} - 30),
  al AS (SELECT CASE WHEN denial > 10 THEN 'denial_rate_high' ELSE 'denial_rate_warning' END AS id, 'denial_rate' AS metric, CASE WHEN denial > 10 THEN 'critical' ELSE 'warning' END AS severity,
    denial AS value, CASE WHEN denial > 10 THEN 10.0 ELSE 5.0 END AS threshold FROM now WHERE denial > 5
  UNION ALL SELECT CASE WHEN rate < 85 THEN 'reimb_rate_low' ELSE 'reimb_rate_warning' END, 'reimb_rate', CASE WHEN rate < 85 THEN 'critical' ELSE 'warning' END, rate,
    CASE WHEN rate < 85 THEN 85.0 ELSE 90.0 END FROM now WHERE rate < 90
  UNION ALL SELECT CASE WHEN c < -20 THEN 'revenue_decline' ELSE 'revenue_decline_warning' END, 'mom_change', CASE WHEN c < -20 THEN 'critical' ELSE 'warning' END, c,
    CASE WHEN c < -20 THEN -20.0 ELSE -10.0 END FROM mom WHERE c < -10
  UNION ALL SELECT 'pending_claims', 'pending_claims', 'warning', n, 100.0 FROM w WHERE n > 100)"""


@query("ag49_alerts", f"{_ALERTS} SELECT id, metric, severity, {d('value')} AS value, {d('threshold')} AS threshold FROM al")
def _(t):
    return alerts.alerts(t.claims_core, AS_OF)


@query("ag49_alert_counts", f"""{_ALERTS} SELECT count(*) AS total, {n("severity = 'critical'")} AS critical_count, {n("severity = 'warning'")} AS warning_count FROM al""")
def _(t):
    return alerts.alert_counts(alerts.alerts(t.claims_core, AS_OF))


_INS = f"""WITH r AS (SELECT {YM} AS month, {rtn(n(ERR), 'count(*)')} AS v FROM claims_core WHERE dateadm IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 2),
  pr AS (SELECT max(month) AS month, max_by(v, month) AS c, min_by(v, month) AS p FROM r),
  sv AS (SELECT service_type, {rtn(n(ERR), 'count(*)')} AS v FROM claims_core WHERE service_type <> '' GROUP BY 1 HAVING count(*) >= 20 AND {rtn(n(ERR), 'count(*)')} > 15 ORDER BY 2 DESC, 1 LIMIT 3),
  pd AS (SELECT CAST(sum(coalesce(paid, 0)) AS DOUBLE) / CAST(sum(coalesce(claim_drg, 0)) AS DOUBLE) * 100 AS v FROM claims_core WHERE dateadm >= DATE '2001-04-15'),
  te AS (SELECT error_code, count(*) AS k FROM claims_core WHERE {ERR} AND dateadm >= DATE '2001-04-15' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
  w AS (SELECT count(*) AS k FROM claims_core WHERE dateadm < {AS_OF_SQL} - 60 AND coalesce(paid, 0) = 0 AND {OK}),
  ins AS (SELECT 'denial_up' AS insight, 'warning' AS type, 'Denial Rate' AS category, 'high' AS priority, month AS subject, CAST(c AS DOUBLE) AS value, 30 AS points FROM pr WHERE c > p * 1.2
  UNION ALL SELECT 'denial_down', 'success', 'Denial Rate', 'low', month, c, 0 FROM pr WHERE c < p * 0.8
  UNION ALL SELECT 'service', 'warning', 'Service Type', 'medium', service_type, v, 15 FROM sv
  UNION ALL SELECT 'paid_low', 'warning', 'Reimbursement', 'high', NULL, {hu('v')}, 25 FROM pd WHERE v < 85
  UNION ALL SELECT 'paid_high', 'success', 'Reimbursement', 'low', NULL, {hu('v')}, 0 FROM pd WHERE v >= 95
  UNION ALL SELECT 'top_error', 'info', 'Error Analysis', 'medium', error_code, k, 10 FROM te
  UNION ALL SELECT 'pending', 'warning', 'Pending Claims', 'medium', NULL, k, 15 FROM w WHERE k > 10)"""


@query("ag50_insights", f"{_INS} SELECT insight, type, category, priority, subject, CAST(value AS DOUBLE) AS value, points FROM ins")
def _(t):
    return alerts.insights(t.claims_core, AS_OF)


@query("ag50_insight_score", f"""{_INS} SELECT count(*) AS total_insights, CAST(least(100, sum(points)) AS INT) AS priority_score, CASE WHEN sum(points) >= 60 THEN 'critical' WHEN sum(points) >= 30 THEN 'warning'
  ELSE 'good' END AS health_status FROM ins""")
def _(t):
    return alerts.insight_score(alerts.insights(t.claims_core, AS_OF))


@query("ag54_inbox", f"SELECT id, {txt('created_at')} AS created_at, alert_type, severity, is_read, is_dismissed FROM notices WHERE NOT is_dismissed AND severity = 'critical' AND NOT is_read ORDER BY notices.created_at DESC, id DESC LIMIT 100")
def _(t):
    return alerts.inbox(t.notices, "critical", unread_only=True, k=100)


@query("ag54_unread", f"SELECT severity, count(*) AS unread FROM notices WHERE NOT is_dismissed AND NOT is_read GROUP BY 1")
def _(t):
    return alerts.unread(t.notices)


@query("ag54_mark_read", "SELECT id, is_read OR id % 4 = 0 AS is_read FROM notices")
def _(t):
    return merge.mark_notices(t.notices, t.notices.filter("id % 4 = 0")).select("id", "is_read")
