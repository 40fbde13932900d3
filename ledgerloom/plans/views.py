"""The standing views: one aggregate or join each.

Row order is left to the reader of a view.  A denied claim here is any code other than ``'-'``, so a
blank counts.  Calendar attributes come from the date dimension, which has one row per day and is
small by construction, so it is broadcast; facts are summed per day first where that is cheaper.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_error, mean, ratio_or_null, total, zero
from ..operators.filters import secure
from ..operators.joins import enrich, left_match, statement_view
from ..operators.windows import trailing_count


def _denied() -> Column:
    return is_error(blank_counts=True, exclude=("-",))


def with_calendar(df: DataFrame, dim_date: DataFrame, *cols: str) -> DataFrame:
    """Rows whose admission day is in the calendar, with the named calendar columns."""
    days = dim_date.select("full_date", *cols)
    return df.join(days, F.col("dateadm").cast("date") == F.col("full_date")).drop("full_date")


def daily_claim_summary(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.col("dateadm").cast("date").alias("service_date"), "ptype", "main_inscl").agg(
        F.count("*").alias("claim_count"), F.sum("reimb_nhso").alias("total_reimbursement"),
        F.count_if(_denied()).alias("error_count"), F.count_if("his_matched").alias("matched_count"),
    )


def unmatched_claims(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    rows = claims.filter(F.col("his_matched") == False)  # noqa: E712 - null is neither
    rows = rows.select("tran_id", "file_id", "hn", "an", "pid", "ptype", "dateadm", "datedsc", "reimb_nhso", "error_code")
    return rows.join(ledger.select("file_id", "filename", "file_date"), "file_id", "left")


def import_status(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("file_type", "status").agg(
        F.count("*").alias("file_count"), *[F.sum(c).alias(c) for c in ("total_records", "imported_records", "failed_records")],
        F.min("file_date").alias("earliest_file"), F.max("file_date").alias("latest_file"),
    )


def drug_analytics(details: DataFrame) -> DataFrame:
    return details.groupBy("item_code", "item_name", "item_type").agg(
        F.count("*").alias("prescription_count"), F.sum("quantity").alias("total_quantity"), F.sum("claim_amount").alias("total_claim"),
        F.sum("reimb_amount").alias("total_reimb"), mean("unit_price").alias("avg_unit_price"), F.count_if(is_error()).alias("error_count"),
    )


def deny_analytics(denials: DataFrame) -> DataFrame:
    return denials.groupBy("deny_code", "fund_code").agg(
        F.count("*").alias("deny_count"), F.sum("claim_amount").alias("total_denied_amount"), F.countDistinct("tran_id").alias("affected_cases")
    )


def instrument_analytics(details: DataFrame) -> DataFrame:
    return details.groupBy("item_code", "item_name").agg(
        F.count("*").alias("usage_count"), F.sum("quantity").alias("total_claim_qty"), F.sum("claim_amount").alias("total_claim"),
        F.sum("reimb_amount").alias("total_reimb"), ratio_or_null(F.sum("reimb_amount"), F.sum("claim_amount")).alias("approval_rate"),
    )


def monthly_summary(file_totals: DataFrame) -> DataFrame:
    claim = F.col("ip_claim") + F.col("drug_claim") + F.col("inst_claim")
    reimb = F.col("ip_reimb") + F.col("drug_reimb") + F.col("inst_reimb")
    return file_totals.groupBy("rep_period", "file_type").agg(
        *[F.sum(c).alias(c) for c in ("total_cases", "passed_cases", "failed_cases")],
        F.sum(claim).alias("total_claim"), F.sum(reimb).alias("total_reimb"), F.sum("reimb_total").alias("grand_total"),
    )


def monthly_revenue_by_fund(claims: DataFrame, dim_date: DataFrame) -> DataFrame:
    cal = ("year", "month_number", "month_name_th", "fiscal_year", "fiscal_quarter")
    return with_calendar(claims, dim_date, *cal).groupBy(*cal, "ptype", "main_fund", "scheme").agg(
        F.count("*").alias("total_cases"), F.sum("claim_drg").alias("total_claimed"), F.sum("reimb_nhso").alias("total_reimb_nhso"),
        F.sum("reimb_agency").alias("total_reimb_agency"), mean("reimb_nhso").alias("avg_reimb_nhso"), F.count_if(_denied()).alias("denied_cases"),
    )


def daily_revenue(claims: DataFrame) -> DataFrame:
    rows = claims.filter(F.col("dateadm").isNotNull())
    return rows.groupBy(F.col("dateadm").cast("date").alias("service_date"), "ptype", "main_inscl").agg(
        F.count("*").alias("total_cases"), F.sum("reimb_nhso").alias("total_reimb"), mean("reimb_nhso").alias("avg_reimb"), F.count_if(_denied()).alias("denied_count"),
    )


def error_analysis(claims: DataFrame, error_dim: DataFrame) -> DataFrame:
    sums = claims.filter(_denied()).groupBy("error_code", "ptype").agg(
        F.count("*").alias("total_cases"), F.sum("claim_drg").alias("total_claimed"), F.sum("reimb_nhso").alias("total_reimb"),
        F.round(mean(F.col("claim_drg") - F.col("reimb_nhso")), 2).alias("avg_denied_amount"),
    )
    sums = sums.withColumn("total_denied_amount", F.col("total_claimed") - F.col("total_reimb"))
    return enrich(sums, error_dim.select("code", "type", "description"), "error_code", "code").drop("code")


def fund_performance(claims: DataFrame, fund_dim: DataFrame) -> DataFrame:
    sums = claims.groupBy("main_fund", "sub_fund", "ptype").agg(
        F.count("*").alias("total_cases"), F.sum("claim_drg").alias("total_claimed"), F.sum("reimb_nhso").alias("total_reimb"),
        F.round(mean("reimb_nhso"), 2).alias("avg_reimb"), ratio_or_null(F.sum("reimb_nhso"), F.sum("claim_drg")).alias("reimb_rate_pct"),
    )
    return enrich(sums, fund_dim, "main_fund", "fund_code").drop("fund_code")


_MONTH = ("year", "month_number", "month_name_th")


def hc_analysis(claims: DataFrame, dim_date: DataFrame) -> DataFrame:
    hc = zero("iphc") + zero("ophc")
    rows = claims.filter((zero("iphc") > 0) | (zero("ophc") > 0))
    return with_calendar(rows, dim_date, *_MONTH).groupBy(*_MONTH, "ptype").agg(
        F.count("*").alias("total_cases"), F.sum(zero("iphc")).alias("total_iphc"), F.sum(zero("ophc")).alias("total_ophc"),
        F.sum(hc).alias("total_hc"), mean(hc).alias("avg_hc"),
    )


def ae_analysis(claims: DataFrame, dim_date: DataFrame) -> DataFrame:
    rows = claims.filter((zero("ae_opae") > 0) | (zero("ae_ipnb") > 0) | (zero("ae_ipuc") > 0))
    everything = F.lit(0)
    for c in ("ae_opae", "ae_ipnb", "ae_ipuc", "ae_ip3sss", "ae_ip7sss", "ae_carae", "ae_caref", "ae_caref_puc"):
        everything = everything + zero(c)
    parts = {"total_opae": "ae_opae", "total_ipnb": "ae_ipnb", "total_ipuc": "ae_ipuc", "total_carae": "ae_carae"}
    return with_calendar(rows, dim_date, *_MONTH).groupBy(*_MONTH, "ptype").agg(
        F.count("*").alias("total_cases"), *[F.sum(zero(c)).alias(n) for n, c in parts.items()], F.sum(everything).alias("total_ae")
    )


def dmis_analysis(claims: DataFrame, dim_date: DataFrame) -> DataFrame:
    rows = claims.filter((zero("cataract_amt") > 0) | (zero("dmisrc_amt") > 0) | (zero("rcuhosc_amt") > 0) | (zero("dmis_dm") > 0))
    parts = {
        "total_cataract": "cataract_amt", "total_dmisrc": "dmisrc_amt", "total_rcuhosc": "rcuhosc_amt", "total_rcuhosr": "rcuhosr_amt",
        "total_stroke_drug": "dmis_stroke_drug", "total_dm": "dmis_dm", "total_pp": "dmis_pp",
    }
    return with_calendar(rows, dim_date, *_MONTH).groupBy(*_MONTH).agg(
        F.count("*").alias("total_cases"), *[F.sum(zero(c)).alias(n) for n, c in parts.items()]
    )


def denial_breakdown(claims: DataFrame, dim_date: DataFrame) -> DataFrame:
    kinds = ("deny_hc", "deny_ae", "deny_inst", "deny_ip", "deny_dmis")
    return with_calendar(claims, dim_date, *_MONTH).groupBy(*_MONTH, "ptype").agg(
        F.count("*").alias("total_cases"), *[F.count_if(F.col(k) != "-").alias(k + "_count") for k in kinds]
    )


def file_import_summary(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    sums = claims.groupBy("file_id").agg(F.sum("reimb_nhso").alias("_r"), F.sum("claim_drg").alias("_c"))
    secs = F.unix_timestamp(F.col("import_completed_at").cast("timestamp")) - F.unix_timestamp(F.col("import_started_at").cast("timestamp"))
    out = ledger.join(sums, "file_id", "left")
    return out.withColumns({"duration_seconds": secs, "total_reimb": zero("_r"), "total_claimed": zero("_c")}).drop("_r", "_c")


def hospital_comparison(claims: DataFrame, dim_date: DataFrame, offices: DataFrame) -> DataFrame:
    sums = with_calendar(claims, dim_date, "year", "month_number").groupBy("hcode", "year", "month_number").agg(
        F.count("*").alias("total_cases"), F.sum("reimb_nhso").alias("total_reimb"), mean("reimb_nhso").alias("avg_reimb"),
        F.count_if(_denied()).alias("denied_cases"), ratio_or_null(F.count_if(_denied()), F.count("*")).alias("denial_rate_pct"),
    )
    dim = offices.select("hcode5", F.col("name").alias("hospital_name"), "health_region")
    return enrich(sums, dim, "hcode", "hcode5").drop("hcode5")


def drg_distribution(claims: DataFrame, drg_dim: DataFrame) -> DataFrame:
    sums = claims.filter(F.col("drg") != "-").groupBy("drg").agg(
        F.count("*").alias("total_cases"), mean("rw").alias("avg_rw"), F.sum("reimb_nhso").alias("total_reimb"), mean("reimb_nhso").alias("avg_reimb")
    )
    return enrich(sums, drg_dim, "drg", "drg_code").drop("drg_code")


def payment_type_analysis(claims: DataFrame, dim_date: DataFrame) -> DataFrame:
    rows = claims.filter(F.col("payment_type").isNotNull())
    return with_calendar(rows, dim_date, "year", "month_number").groupBy("payment_type", "ptype", "year", "month_number").agg(
        F.count("*").alias("total_cases"), F.sum("reimb_nhso").alias("total_reimb"), mean("reimb_nhso").alias("avg_reimb")
    )


def stm_rep_reconciliation(stm: DataFrame, claims: DataFrame, files: DataFrame) -> DataFrame:
    return statement_view(stm, claims, files)


def stm_statistics(files: DataFrame, receivables: DataFrame) -> DataFrame:
    """Receivables per statement group; summed per file first so a file counts once."""
    sums = receivables.groupBy("file_id").agg(
        *[F.sum(c).alias(c) for c in ("rep_count", "patient_count", "total_paid", "net_receivable")]
    )
    rows = files.filter(F.col("status") == "completed").join(sums, "file_id", "left")
    return rows.groupBy("hospital_code", "scheme", "file_type", "statement_year", "statement_month").agg(
        F.count("*").alias("file_count"), F.sum("rep_count").alias("total_rep_count"), F.sum("patient_count").alias("total_patient_count"),
        F.sum("total_paid").alias("total_paid"), F.sum("net_receivable").alias("total_net_receivable"),
    )


_CHANGES = ("CREATE", "UPDATE", "DELETE")


def audit_log_stats(audit: DataFrame, as_of: dt.datetime) -> DataFrame:
    a, s = F.col("action"), F.col("status")
    days = audit.select(F.col("ts").cast("date").alias("d")).distinct().agg(F.count("d")).scalar()
    out = audit.agg(
        F.count("*").alias("total_events"), F.countDistinct("user_id").alias("unique_users"),
        F.count_if(s == "failed").alias("failed_events"), F.count_if(s == "denied").alias("denied_events"),
        F.count_if(a == "LOGIN").alias("total_logins"), F.count_if(a == "LOGIN_FAILED").alias("failed_logins"),
        F.count_if(a.isin(*_CHANGES)).alias("data_changes"), F.count_if(a == "EXPORT").alias("data_exports"),
        F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
    )
    since = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_event").cast("timestamp"))
    return out.withColumns({"active_days": days, "seconds_since_last_event": since})


def user_activity_summary(audit: DataFrame) -> DataFrame:
    """Activity per user with the distinct addresses used; :func:`user_addresses` has them a row each."""
    a = F.col("action")
    return audit.filter(F.col("user_id").isNotNull()).groupBy("user_id", "user_email").agg(
        F.count("*").alias("total_actions"), F.countDistinct(F.col("ts").cast("date")).alias("active_days"),
        F.count_if(a.isin(*_CHANGES)).alias("data_modifications"), F.count_if(a == "READ").alias("data_reads"),
        F.count_if(a == "EXPORT").alias("data_exports"), F.count_if(F.col("status") == "failed").alias("failed_actions"),
        F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"), F.array_sort(F.collect_set("ip_address")).alias("ip_addresses"),
    )


def user_addresses(audit: DataFrame) -> DataFrame:
    """One row for each user and address, however many addresses a user has."""
    known = audit.filter(F.col("user_id").isNotNull() & F.col("ip_address").isNotNull())
    return known.groupBy("user_id", "ip_address").agg(F.count("*").alias("actions"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))


# Words shown for an action.
ACCESS_WORDS = {"READ": "Viewed", "EXPORT": "Exported", "UPDATE": "Modified", "DELETE": "Deleted"}


def data_access_log(audit: DataFrame) -> DataFrame:
    words = F.create_map(*[F.lit(x) for kv in ACCESS_WORDS.items() for x in kv])
    rows = audit.filter(F.col("action").isin(*ACCESS_WORDS))
    return rows.select("id", "user_id", "user_email", "action", "resource_type", "ts", "ip_address", F.try_element_at(words, F.col("action")).alias("access_type"))


def security_events(audit: DataFrame, minutes: int = 15, threshold: int = 3) -> DataFrame:
    """Failed and refused actions with a threat level; repeated failed logins within the window stand out."""
    rows = audit.filter(F.col("status").isin("failed", "denied") | (F.col("action") == "LOGIN_FAILED"))
    rows = rows.select("id", "user_id", "action", "status", "ip_address", "ts")
    login = F.col("action") == "LOGIN_FAILED"
    counted = trailing_count(rows.filter(login), "user_id", "ts", minutes * 60)
    other = rows.filter(~login).withColumn("n_recent", F.lit(0).cast("bigint"))
    level = (
        F.when(login & (F.col("n_recent") >= threshold), "BRUTE_FORCE_ATTEMPT")
        .when(F.col("status") == "denied", "UNAUTHORIZED_ACCESS")
        .when(F.col("status") == "failed", "OPERATION_FAILED")
        .otherwise("OTHER")
    )
    return counted.unionByName(other).withColumn("threat_level", level).drop("n_recent")


def active_users_summary(users: DataFrame, sessions: DataFrame) -> DataFrame:
    open_ = sessions.filter("is_active").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    rows = users.filter(F.col("is_active") & ~F.col("is_deleted")).join(open_, "id", "left")
    return rows.withColumn("active_sessions", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n", "is_active", "is_deleted")


def order_nulls_last(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last())


def user_login_history(users: DataFrame, audit: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    """Users with their logins of the last days; a user without any keeps one row."""
    since = F.lit(as_of - dt.timedelta(days=days))
    logins = audit.filter(F.col("action").isin("LOGIN", "LOGIN_FAILED") & (F.col("ts") > since))
    logins = logins.select(F.col("user_id").alias("username"), F.col("ts").alias("login_time"), "ip_address", "status")
    return users.filter(~F.col("is_deleted")).select(F.col("id").alias("user_id"), "username", "email").transform(left_match, logins, "username")


def claims_summary_secure(claims: DataFrame, role: str | None, hospital: str | None) -> DataFrame:
    rows = secure(claims, role, hospital)
    return rows.groupBy(F.trunc("dateadm", "MM").alias("month")).agg(
        F.count("*").alias("claim_count"), total("reimb_nhso").alias("total_amount"), F.countDistinct("pid").alias("patient_count")
    )


def recent_imports_secure(ledger: DataFrame, as_of: dt.date, role: str | None = None, hospital: str | None = None, *, k: int) -> DataFrame:
    rows = secure(ledger, role, hospital, "hospital_code").filter(F.col("file_date") >= F.date_sub(F.lit(as_of), 30))
    return rows.orderBy(F.desc("file_date"), F.desc("file_id")).limit(k).select("filename", "file_date", "status", "imported_records", "error_message")


def high_cost_months(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.trunc("dateadm", "MM").alias("month")).agg(
        F.count("*").alias("claims"), F.count_if(zero("iphc") > 0).alias("ip_high_cost"), F.count_if(zero("ophc") > 0).alias("op_high_cost")
    )


def monthly_by_patient_type(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.trunc("dateadm", "MM").alias("month"), "ptype").agg(F.count("*").alias("claims"), total("reimb_nhso").alias("total_reimb"))
