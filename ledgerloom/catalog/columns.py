"""Column helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fiscal, money, text
from .base import hu, query, rt, txt

_FYQ = "CAST(year({0}) + CASE WHEN month({0}) >= 10 THEN 544 ELSE 543 END AS INT)"


@query("sc01_months", f"""SELECT tran_id, {txt("date_trunc('month', dateadm)::DATE")} AS month_start, strftime(dateadm, '%Y-%m') AS ym,
  CAST(year(dateadm) AS INT) AS y, CAST(month(dateadm) AS INT) AS m FROM claims_core""")
def _(t):
    return t.claims_core.select("tran_id", fiscal.month_of("dateadm").alias("month_start"), fiscal.ym("dateadm").alias("ym"), F.year("dateadm").alias("y"), F.month("dateadm").alias("m"))


@query("sc02_intervals", f"SELECT tran_id, {txt('(dateadm - INTERVAL 2 MONTH)::DATE')} AS two_months, {txt('dateadm - 30')} AS thirty_days FROM claims_core")
def _(t):
    return t.claims_core.select("tran_id", fiscal.minus_months("dateadm", 2).alias("two_months"), fiscal.minus_days("dateadm", 30).alias("thirty_days"))


@query("sc03_numbers", """SELECT row, c1, CAST(TRY_CAST(trim(replace(c7, ',', '')) AS DECIMAL(15,2)) AS DOUBLE) AS amount,
  CAST(coalesce(TRY_CAST(trim(replace(c7, ',', '')) AS DECIMAL(15,2)), 0) AS DOUBLE) AS amount0 FROM raw_claims""")
def _(t):
    return t.raw_claims.select("row", "c1", money.num("c7").alias("amount"), money.num0("c7").alias("amount0"))


@query("sc04_numeric_guard", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(c7, '^[0-9]+\\.?[0-9]*$')) AS plain, count(*) FILTER (WHERE regexp_matches(c0, '^[0-9]+\\.?[0-9]*$')) AS seq FROM raw_claims")
def _(t):
    return t.raw_claims.agg(F.count("*").alias("n"), F.count_if(money.is_numeric("c7")).alias("plain"), F.count_if(money.is_numeric("c0")).alias("seq"))


@query("sc05_buddhist_dates", f"""SELECT ref_doc_no, vendor_no, posting_date, {txt("strptime(CAST(CAST(posting_date AS BIGINT) - 5430000 AS VARCHAR), '%Y%m%d')::DATE")} AS day,
  substr(posting_date, 1, 6) AS be_month, CAST(CAST(substr(posting_date, 1, 4) AS INT) - 543 AS VARCHAR) || '-' || substr(posting_date, 5, 2) AS ym,
  posting_date AS back FROM transfers_core""")
def _(t):
    day = fiscal.be_to_date("posting_date")
    return t.transfers_core.select(
        "ref_doc_no", "vendor_no", "posting_date", day.alias("day"), fiscal.to_be_month(day).alias("be_month"),
        fiscal.be_month_to_ym(F.substring("posting_date", 1, 6)).alias("ym"), fiscal.to_be_date(day).alias("back"),
    )


@query("sc06_fiscal_parts", f"""SELECT {_FYQ.format('dateadm')} AS fy, CAST(CASE WHEN month(dateadm) >= 10 THEN 1 WHEN month(dateadm) <= 3 THEN 2 WHEN month(dateadm) <= 6 THEN 3
  ELSE 4 END AS INT) AS fq, 'FY ' || {_FYQ.format('dateadm')} || ' (1 Oct ' || ({_FYQ.format('dateadm')} - 544) || ' - 30 Sep ' || ({_FYQ.format('dateadm')} - 543) || ')' AS label,
  'ปีงบประมาณ ' || {_FYQ.format('dateadm')} || ' (1 ต.ค. ' || ({_FYQ.format('dateadm')} - 1) || ' - 30 ก.ย. ' || {_FYQ.format('dateadm')} || ')' AS label_th,
  count(*) AS claims FROM claims_core WHERE dateadm IS NOT NULL GROUP BY ALL""")
def _(t):
    rows = t.claims_core.filter("dateadm IS NOT NULL").select(fiscal.fiscal_year("dateadm").alias("fy"), fiscal.fiscal_quarter("dateadm").cast("int").alias("fq"))
    out = rows.groupBy("fy", "fq").agg(F.count("*").alias("claims"))
    return out.withColumns({"label": fiscal.fy_label(F.col("fy"), "en"), "label_th": fiscal.fy_label(F.col("fy"))})


@query("sc07_padding", "SELECT vendor_no, lpad(vendor_no, 10, '0') AS padded, ltrim(vendor_no, '0') AS stripped, count(*) AS n FROM transfers_core GROUP BY ALL")
def _(t):
    out = t.transfers_core.groupBy("vendor_no").agg(F.count("*").alias("n"))
    return out.withColumns({"padded": text.pad("vendor_no", 10), "stripped": text.strip0("vendor_no")})


@query("sc08_pieces", "SELECT tran_id, substr(drg, 1, 3) AS drg3, split_part(main_fund, ',', 1) AS fund, upper(substr(rep_no, 1, 3)) AS code, substr(name, 1, 12) AS short_name FROM claims")
def _(t):
    return t.claims.select("tran_id", text.prefix("drg", 3).alias("drg3"), text.first_token("main_fund").alias("fund"), F.upper(text.prefix("rep_no", 3)).alias("code"), text.cut("name", 12).alias("short_name"))


@query("sc09_ratios", f"""SELECT tran_id, {rt('paid', 'claim_drg')} AS r2, {rt('paid', 'claim_drg', 1)} AS r1, {rt('reimb_nhso', 'paid', 4, 1)} AS r4,
  {hu('CAST(reimb_nhso AS DOUBLE) / nullif(CAST(paid AS DOUBLE), 0) * 100')} AS rn FROM claims_core""")
def _(t):
    c = F.col
    return t.claims_core.select(
        "tran_id", money.ratio(c("paid"), c("claim_drg")).alias("r2"), money.ratio(c("paid"), c("claim_drg"), 1).alias("r1"),
        money.ratio(c("reimb_nhso"), c("paid"), 4, 1).alias("r4"), money.ratio_or_null(c("reimb_nhso"), c("paid")).alias("rn"),
    )


@query("sc10_features", """SELECT tran_id, round(ln(1 + CAST(claim_drg AS DOUBLE)), 6) AS log_amount, CASE WHEN regexp_extract(error_code, '(\\d+)', 1) IN ('') THEN 0
  ELSE coalesce(CAST(nullif(regexp_extract(error_code, '(\\d+)', 1), '') AS INT), 0) END AS code_num, coalesce(contains(error_code, '998'), false) AS is_998 FROM claims_core""")
def _(t):
    return t.claims_core.select(
        "tran_id", F.round(F.log1p(F.col("claim_drg").cast("double")), 6).alias("log_amount"), text.first_digits("error_code").alias("code_num"), text.has("error_code", "998").alias("is_998")
    )


_MASK = "text"
for _p, _r in text.SECRET_PATTERNS:
    _MASK = f"regexp_replace({_MASK}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r}', 'gi')"


@query("sc11_masking", f"SELECT doc_id, md5({_MASK}) AS masked_md5, ({_MASK}) <> text AS changed FROM documents")
def _(t):
    masked = text.mask_text("text")
    return t.documents.select("doc_id", F.md5(masked).alias("masked_md5"), (masked != F.col("text")).alias("changed"))


@query("sc12_redaction", """SELECT event_id, '{"' || CASE WHEN event_id % 3 = 0 THEN 'Api_Key' ELSE 'k' END || '":"' ||
  CASE WHEN event_id % 3 = 0 THEN '***REDACTED***' ELSE regexp_extract(props, '(\\d+)', 1) END || '"}' AS params FROM events""")
def _(t):
    name = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", '"k"', '"Api_Key"')).otherwise(F.col("props"))
    return t.events.select("event_id", F.to_json(text.redact_params(text.parse_json(name))).alias("params"))


@query("sc13_json", "SELECT job_id, CAST(json_extract(parameters, '$.k') AS BIGINT) AS k FROM jobs")
def _(t):
    return t.jobs.select("job_id", text.parse_json("parameters", "k bigint")["k"].alias("k"))


@query("sc14_human_size", f"""WITH x AS (SELECT p_partkey, CAST(p_partkey * p_partkey * 977 AS BIGINT) AS bytes FROM part)
  SELECT p_partkey, CASE WHEN bytes < 1e3 THEN bytes || ' Bytes' WHEN bytes < 1e6 THEN printf('%.1f kB', round(bytes / 1e3 + 1e-9, 1)) WHEN bytes < 1e9 THEN printf('%.1f MB', round(bytes / 1e6 + 1e-9, 1))
  ELSE printf('%.1f GB', round(bytes / 1e9 + 1e-9, 1)) END AS size FROM x""")
def _(t):
    return t.part.select("p_partkey", (F.col("p_partkey") * F.col("p_partkey") * 977).alias("bytes")).select("p_partkey", money.human_size("bytes").alias("size"))


@query("sc15_digest", "SELECT md5(text) AS md5, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY ALL")
def _(t):
    return t.documents.groupBy(text.digest("text", "md5").alias("md5"), text.digest("text").alias("sha")).agg(F.count("*").alias("copies"))


@query("sc16_quality_flags", """SELECT file_id, coalesce(regexp_matches(hospital_code, '^\\d{5}$'), false) AS ok_hospital, statement_month BETWEEN 1 AND 12 AS ok_month,
  statement_year BETWEEN 2560 AND 2600 AS ok_year, scheme IN ('UCS','OFC','SSS','LGO') AS ok_scheme,
  regexp_matches(filename, '^[A-Za-z0-9_.-]+$') AND NOT contains(filename, '..') AS ok_filename FROM stm_files""")
def _(t):
    f = F.col
    return t.stm_files.select("file_id", *[v.alias(k) for k, v in text.quality_flags(f("statement_year"), f("statement_month"), f("hospital_code"), f("scheme"), f("filename")).items()])
