"""Claim reports: totals, trends, breakdowns, denials, efficiency, opportunities.

Each report is one scan with conditional aggregates where its figures allow it.  Groupings keep the
raw column as the key and label it afterwards, so a null group never merges with a real label.
Top-k lists end in a unique tie-breaker.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.money import change, is_error, mean, ratio, total, zero
from ..functions.text import cut, prefix
from ..operators.filters import SERVICE_LABELS, fiscal_months, fiscal_months_be, label, search
from ..operators.windows import compare_with_group, error_rates, share


def dated(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("dateadm").isNotNull())


def topk(df: DataFrame, by: str, k: int, tie: str, desc: bool = True) -> DataFrame:
    lead = F.col(by).desc() if desc else F.col(by).asc()
    return df.orderBy(lead, F.col(tie)).limit(k)


def latest_k_ascending(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(k).orderBy(by)


def order_rank(df: DataFrame, col: str, ranking: list[str], *then: Column) -> DataFrame:
    """Sort by position in ``ranking``; unknown values last."""
    rank = F.lit(len(ranking))
    for i, word in reversed(list(enumerate(ranking))):
        rank = F.when(F.col(col) == word, i).otherwise(rank)
    return df.orderBy(rank, *then)


def _visit_is_ip() -> Column:
    return F.col("an").isNotNull() & (F.col("an") != "")


# --- totals ---------------------------------------------------------------------------------


def summary(claims: DataFrame, stm: DataFrame, smt: DataFrame, fy: int | None = None, first: int = 10, last: int = 9, scheme: str | None = None, file_type: str | None = None) -> DataFrame:
    """Rows, amount and files of each feed, optionally within months of a fiscal year."""
    if fy:
        claims = fiscal_months(claims, fy, first, last)
        stm = fiscal_months(stm, fy, first, last, "date_admit")
        smt = fiscal_months_be(smt, fy, first, last)
    if scheme:
        claims = claims.filter(F.col("scheme") == scheme)
    if file_type:
        claims = claims.filter(F.col("ptype").startswith(file_type))

    def one(feed: str, df: DataFrame, amount: str, file: str) -> DataFrame:
        return df.agg(
            F.lit(feed).alias("feed"), F.count("*").alias("total_records"),
            total(F.col(amount).cast("decimal(15,2)")).cast("decimal(25,2)").alias("total_amount"),
            F.countDistinct(file).alias("files_count"),
        )

    return (
        one("rep", claims, "reimb_nhso", "file_id")
        .unionByName(one("stm", stm, "paid_after_deduction", "file_id"))
        .unionByName(one("smt", smt, "total_amount", "run_date"))
    )


def overview(claims: DataFrame, approx: bool = False) -> DataFrame:
    """Headline totals, rates and averages as one row."""
    rows = dated(claims)
    patients = F.approx_count_distinct("hn") if approx else F.countDistinct("hn")
    months = rows.select(fiscal.month_of("dateadm").alias("m")).distinct().agg(F.count("*")).scalar()
    out = rows.agg(
        F.count("*").alias("total_claims"), total("reimb_nhso").alias("total_reimb"), total("paid").alias("total_paid"),
        total("claim_drg").alias("total_claim_drg"), patients.alias("unique_patients"),
        F.count_if(is_error()).alias("total_denied_claims"),
        total(F.when(is_error(), F.col("claim_drg"))).alias("total_denied_amount"),
    ).withColumn("active_months", months)
    c = F.col
    return out.withColumns(
        {
            "reimb_rate": ratio(c("total_reimb"), c("total_claim_drg")),
            "avg_claim_per_case": ratio(c("total_claim_drg"), c("total_claims"), scale=1),
            "avg_reimb_per_case": ratio(c("total_reimb"), c("total_claims"), scale=1),
            "total_loss": c("total_claim_drg") - c("total_reimb"),
            "denial_rate": ratio(c("total_denied_claims"), c("total_claims")),
        }
    )


def overview_visits(claims: DataFrame) -> DataFrame:
    """Outpatient and inpatient claims by outcome, one row per visit kind."""
    ok = ~is_error()
    out = dated(claims).groupBy(F.when(_visit_is_ip(), "IPD").otherwise("OPD").alias("visit")).agg(
        F.count_if(ok).alias("claims"), F.count("*").alias("total_claims"),
        total(F.when(ok, F.col("claim_drg"))).alias("claim"), total("claim_drg").alias("total_claim"),
        total(F.when(ok, F.col("reimb_nhso"))).alias("reimb"),
        F.count_if(~ok).alias("fail_claims"), total(F.when(~ok, F.col("claim_drg"))).alias("fail_claim"),
    )
    c = F.col
    return out.withColumns(
        {
            "reimb_rate": ratio(c("reimb"), c("claim")),
            "avg_claim": ratio(c("claim"), c("claims"), scale=1),
            "avg_reimb": ratio(c("reimb"), c("claims"), scale=1),
            "success_rate": ratio(c("claims"), c("total_claims")),
        }
    )


def detail_totals(drugs: DataFrame, instruments: DataFrame, denials: DataFrame) -> DataFrame:
    """Items, amounts, cases and averages of each kind of detail line."""

    def one(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(
            F.lit(kind).alias("kind"), F.count("*").alias("items"), total("reimb_amount").alias("reimb"),
            total("claim_amount").alias("claim"), F.countDistinct("tran_id").alias("cases"),
        )

    out = one("drug", drugs).unionByName(one("instrument", instruments)).unionByName(one("deny", denials))
    c = F.col
    return out.withColumns(
        {
            "reimb_rate": ratio(c("reimb"), c("claim")),
            "avg_claim_per_case": ratio(c("claim"), c("cases"), scale=1),
            "avg_reimb_per_case": ratio(c("reimb"), c("cases"), scale=1),
        }
    )


def per_bed(claims: DataFrame, office: DataFrame) -> DataFrame:
    """Money per bed and month.  ``office`` is the one facility row; no beds gives zeros."""
    beds = office.agg(F.coalesce(F.max("actual_beds"), F.lit(0))).scalar()
    o = overview(claims).withColumn("beds", beds)
    c = F.col
    months = F.greatest(c("active_months"), F.lit(1))

    def each(x: Column) -> Column:
        return F.when(c("beds") > 0, F.round(x.cast("double") / c("beds") / months, 2)).otherwise(F.lit(0.0))

    return o.select(
        "beds", each(c("total_reimb")).alias("reimb_per_bed_month"), each(c("total_loss")).alias("loss_per_bed_month"),
        F.when(c("beds") > 0, F.round(c("total_claims").cast("double") / c("beds"), 2)).otherwise(F.lit(0.0)).alias("claims_per_bed"),
        c("avg_reimb_per_case").alias("avg_per_claim"),
    )


# --- trends and breakdowns ------------------------------------------------------------------


def monthly_trend(claims: DataFrame, months: int = 12) -> DataFrame:
    """The latest months in ascending order."""
    by_month = dated(claims).groupBy(fiscal.ym("dateadm").alias("month")).agg(
        F.count("*").alias("claims"), total("reimb_nhso").alias("reimb"), total("paid").alias("paid"),
        total("claim_drg").alias("claim_drg"), F.countDistinct("hn").alias("patients"),
    )
    return latest_k_ascending(by_month, "month", months)


def by_service(claims: DataFrame) -> DataFrame:
    kind = F.coalesce("service_type", F.lit(""))
    out = dated(claims).groupBy(kind.alias("service_type")).agg(
        F.count("*").alias("claims"), total("reimb_nhso").alias("reimb"), total("paid").alias("paid"), total("claim_drg").alias("claim_drg"),
    )
    return out.withColumn("label", label("service_type", SERVICE_LABELS)).orderBy(F.desc("reimb"), "service_type")


def by_fund(claims: DataFrame, k: int = 10) -> DataFrame:
    out = dated(claims).groupBy("main_fund").agg(
        F.count("*").alias("claims"), total("reimb_nhso").alias("reimb"), total("paid").alias("paid"), total("claim_drg").alias("claim_drg"),
    )
    return topk(out, "reimb", k, "main_fund")


def top_drg(claims: DataFrame, k: int = 15) -> DataFrame:
    rows = dated(claims).filter(F.col("drg").isNotNull() & (F.col("drg") != ""))
    out = rows.groupBy("drg").agg(
        F.count("*").alias("cases"), F.round(F.coalesce(mean("rw"), F.lit(0.0)), 4).alias("avg_rw"),
        total("claim_drg").alias("total_drg"), total("paid").alias("total_paid"),
    )
    return topk(out, "cases", k, "drg")


# Upper bounds and names of the relative-weight buckets.
WEIGHT_BUCKETS = [(0.5, "< 0.5"), (1.0, "0.5-1.0"), (2.0, "1.0-2.0"), (3.0, "2.0-3.0"), (5.0, "3.0-5.0"), (None, ">= 5.0")]


def rw_histogram(claims: DataFrame) -> DataFrame:
    slot, name = F.lit(len(WEIGHT_BUCKETS)), F.lit(WEIGHT_BUCKETS[-1][1])
    for i in range(len(WEIGHT_BUCKETS) - 2, -1, -1):
        bound, text = WEIGHT_BUCKETS[i]
        slot = F.when(F.col("rw") < bound, i + 1).otherwise(slot)
        name = F.when(F.col("rw") < bound, text).otherwise(name)
    rows = dated(claims).filter(F.col("rw").isNotNull())
    return rows.groupBy(name.alias("rw_range"), slot.alias("sort_order")).agg(F.count("*").alias("cases")).orderBy("sort_order")


def detail_with_claim(details: DataFrame, claims: DataFrame) -> DataFrame:
    """Detail lines of known claims.  A claim that came in several files repeats its lines."""
    return details.join(claims.select("tran_id", F.col("dateadm").alias("claim_date")), "tran_id")


def top_drugs(details: DataFrame, claims: DataFrame, k: int = 15) -> DataFrame:
    rows = detail_with_claim(details.filter(F.col("item_name").isNotNull() & (F.col("item_name") != "")), claims)
    out = rows.groupBy("item_name").agg(
        F.count("*").alias("prescriptions"), total("quantity").alias("total_qty"), total("reimb_amount").alias("total_cost")
    )
    return topk(out, "total_cost", k, "item_name").withColumn("item_name", cut("item_name", 50))


def drug_categories(details: DataFrame, claims: DataFrame, k: int = 10) -> DataFrame:
    out = detail_with_claim(details, claims).groupBy("item_type").agg(F.count("*").alias("items"), total("claim_amount").alias("total_cost"))
    return topk(out, "total_cost", k, "item_type")


def top_instruments(details: DataFrame, claims: DataFrame, k: int = 15) -> DataFrame:
    rows = detail_with_claim(details, claims)
    name = F.coalesce("item_name", "item_code")
    out = rows.groupBy(name.alias("name")).agg(
        F.count("*").alias("uses"), total("quantity").alias("total_qty"), total("claim_amount").alias("total_claim"), total("reimb_amount").alias("total_reimb"),
    )
    return topk(out, "total_claim", k, "name")


def denial_codes(denials: DataFrame, claims: DataFrame, k: int = 10) -> DataFrame:
    out = detail_with_claim(denials, claims).groupBy("deny_code").agg(F.count("*").alias("cases"), total("claim_amount").alias("total_claim"))
    return topk(out, "cases", k, "deny_code")


def error_codes(claims: DataFrame, k: int = 10) -> DataFrame:
    out = dated(claims).filter(is_error()).groupBy("error_code").agg(F.count("*").alias("cases"))
    return topk(out, "cases", k, "error_code")


def comparison(claims: DataFrame, months: int = 12) -> DataFrame:
    """Claimed, approved and paid by month with the approval rate."""
    out = dated(claims).groupBy(fiscal.ym("dateadm").alias("month")).agg(
        total("claim_drg").alias("claimed"), total("reimb_nhso").alias("approved"), total("paid").alias("paid")
    )
    out = latest_k_ascending(out, "month", months)
    return out.withColumn("approval_rate", ratio(F.col("approved"), F.col("claimed")))


# --- denials --------------------------------------------------------------------------------


def denied(claims: DataFrame, code: str | None = None) -> DataFrame:
    rows = claims.filter(is_error())
    return rows.filter(F.col("error_code") == code) if code else rows


def denial_summary(claims: DataFrame, code: str | None = None) -> DataFrame:
    """Denials against all dated claims, in one scan."""
    bad = is_error() & (F.col("error_code") == code if code else F.lit(True))
    out = claims.agg(
        F.count_if(bad).alias("total_denials"), F.countDistinct(F.when(bad, F.col("error_code"))).alias("unique_error_codes"),
        total(F.when(bad, F.col("claim_drg"))).alias("total_denied_amount"),
        total(F.when(bad, F.col("reimb_nhso"))).alias("total_reimb_lost"),
        F.count("dateadm").alias("total_claims"),
        total(F.when(F.col("dateadm").isNotNull(), F.col("claim_drg"))).alias("total_claims_amount"),
    )
    return out.withColumn("denial_rate", ratio(F.col("total_denials"), F.col("total_claims")))


def denial_by_code(claims: DataFrame, k: int = 15) -> DataFrame:
    out = denied(claims).groupBy("error_code").agg(F.count("*").alias("count"), total("claim_drg").alias("amount"))
    return topk(share(out), "count", k, "error_code")


def denial_by(claims: DataFrame, col: str, k: int | None = None) -> DataFrame:
    out = denied(claims).groupBy(col).agg(F.count("*").alias("count"), total("claim_drg").alias("amount"))
    out = topk(out, "count", k, col) if k else out.orderBy(F.desc("count"), col)
    return out.select(F.coalesce(col, F.lit("Unknown")).alias(col), "count", "amount")


def denial_trend(claims: DataFrame, months: int = 12) -> DataFrame:
    out = dated(denied(claims)).groupBy(fiscal.ym("dateadm").alias("month")).agg(F.count("*").alias("count"), total("claim_drg").alias("amount"))
    return latest_k_ascending(out, "month", months)


def denial_root_cause(claims: DataFrame, code: str | None = None) -> dict[str, DataFrame]:
    """The parts of the root-cause report; cache ``claims`` first if all of them are wanted."""
    rows = claims.filter(F.col("error_code") == code) if code else claims
    return {
        "summary": denial_summary(claims, code),
        "by_error_code": denial_by_code(rows),
        "by_service_type": denial_by(rows, "service_type"),
        "by_fund": denial_by(rows, "main_fund", 10),
        "monthly_trend": denial_trend(rows),
    }


def _efficiency(df: DataFrame, *group: Column) -> DataFrame:
    ok = ~is_error()
    out = df.groupBy(*group).agg(
        F.count("*").alias("claims"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("denied"),
        total("claim_drg").alias("claimed"), total("reimb_nhso").alias("reimbursed"),
    )
    c = F.col
    return out.withColumns(
        {
            "first_pass_rate": ratio(c("passed"), c("claims"), 1),
            "denial_rate": ratio(c("denied"), c("claims"), 1),
            "reimb_rate": ratio(c("reimbursed"), c("claimed"), 1),
            "loss": c("claimed") - c("reimbursed"),
        }
    )


def efficiency(claims: DataFrame) -> DataFrame:
    return _efficiency(dated(claims))


def efficiency_by_visit(claims: DataFrame) -> DataFrame:
    return _efficiency(dated(claims), F.when(_visit_is_ip(), "IP").otherwise("OP").alias("type"))


def efficiency_by_fund(claims: DataFrame, k: int = 10) -> DataFrame:
    return topk(_efficiency(dated(claims), F.coalesce("main_fund", F.lit("ไม่ระบุ")).alias("fund")), "claimed", k, "fund")


def efficiency_trend(claims: DataFrame, months: int = 6) -> DataFrame:
    """Last months over all data, whatever date filter the rest of the report uses."""
    out = _efficiency(dated(claims), fiscal.ym("dateadm").alias("month"))
    return latest_k_ascending(out, "month", months).select("month", "claims", "first_pass_rate", "reimb_rate")


def financial_breakdown(claims: DataFrame) -> DataFrame:
    """Cost groups by scheme and patient type with the grand total row (``level = 'total'``)."""
    z = zero
    rows = claims.select(
        "main_inscl", "ptype", "claim_net", "reimb_nhso",
        (z("iphc") + z("ophc")).alias("hc"), (z("ae_opae") + z("ae_ipnb") + z("ae_ipuc")).alias("ae"),
        (z("inst") + z("opinst")).alias("prosthetics"), z("drug").alias("drug"),
    )
    names = {
        "high_cost_care": "hc", "emergency": "ae", "prosthetics": "prosthetics", "drug_costs": "drug",
        "total_claimed": "claim_net", "total_reimbursed": "reimb_nhso",
    }
    keys = [F.col("main_inscl"), F.col("ptype")]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("total_cases"), *[total(c).alias(n) for n, c in names.items()])
    out = groups.groupingSets([keys, []], *keys).agg(
        F.grouping_id().alias("gid"), F.coalesce(F.sum("total_cases"), F.lit(0)).alias("total_cases"), *[total(n).alias(n) for n in names]
    )
    leaf = F.col("gid") == 0
    return out.withColumns(
        {
            "level": F.when(leaf, "group").otherwise("total"),
            "scheme": F.when(leaf, F.coalesce("main_inscl", F.lit("UNKNOWN"))),
            "ptype": F.when(leaf, F.coalesce("ptype", F.lit("UNKNOWN"))),
        }
    ).drop("gid", "main_inscl")


_NO_DASH = ("-",)


def error_stats(claims: DataFrame) -> DataFrame:
    bad = is_error(exclude=_NO_DASH)
    out = claims.agg(
        F.count("*").alias("total_records"), F.count_if(bad).alias("error_count"),
        total(F.when(bad, F.col("claim_net"))).alias("error_amount"), total("claim_net").alias("total_claimed"),
    )
    return out.withColumn("error_rate", ratio(F.col("error_count"), F.col("total_records")))


def top_errors(claims: DataFrame, k: int = 15) -> DataFrame:
    out = claims.filter(is_error(exclude=_NO_DASH)).groupBy("error_code").agg(F.count("*").alias("count"), total("claim_net").alias("affected_amount"))
    return topk(out, "count", k, "error_code")


def scheme_summary(claims: DataFrame) -> DataFrame:
    bad = is_error(exclude=_NO_DASH)
    out = claims.groupBy("main_inscl").agg(
        F.count("*").alias("total_cases"), F.count_if(F.col("ptype") == "OP").alias("op_cases"), F.count_if(F.col("ptype") == "IP").alias("ip_cases"),
        total("claim_net").alias("total_claimed"), total("reimb_nhso").alias("total_reimbursed"), F.count_if(bad).alias("error_count"),
    )
    return out.withColumns(
        {
            "scheme": F.coalesce("main_inscl", F.lit("UNKNOWN")),
            "error_rate": ratio(F.col("error_count"), F.col("total_cases")),
        }
    ).drop("main_inscl")


def facilities(claims: DataFrame, offices: DataFrame, k: int = 20) -> DataFrame:
    """Top facilities by cases.  Claims are summed per code before the facility is looked up."""
    bad = is_error(exclude=_NO_DASH)
    sums = claims.filter(F.col("hcode").isNotNull()).groupBy("hcode").agg(
        F.count("*").alias("total_cases"), total("claim_net").alias("total_claimed"), total("reimb_nhso").alias("total_reimbursed"),
        F.count_if(bad).alias("error_count"),
    )
    top = topk(sums, "total_cases", k, "hcode")
    dim = offices.select(F.col("hcode5").alias("hcode"), F.col("name").alias("facility"), "province")
    return top.join(dim, "hcode", "left").withColumn("error_rate", ratio(F.col("error_count"), F.col("total_cases")))


def facility_totals(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("hcode").isNotNull()).agg(
        F.countDistinct("hcode").alias("facilities"), F.count("*").alias("total_cases"),
        total("claim_net").alias("total_claimed"), total("reimb_nhso").alias("total_reimbursed"),
    )


def his_summary(claims: DataFrame) -> DataFrame:
    """Match status against the hospital system; no status yet counts as pending."""
    diff = F.col("his_amount_diff")
    return claims.groupBy(F.coalesce("reconcile_status", F.lit("pending")).alias("status")).agg(
        F.count("*").alias("count"), total("claim_net").alias("total_amount"),
        F.count_if(diff.isNotNull() & (diff != 0)).alias("diff_count"), total(F.abs(diff)).alias("total_diff"),
    )


def his_list(claims: DataFrame, threshold: float = 0, *, k: int) -> DataFrame:
    rows = claims.filter(F.abs("his_amount_diff") >= F.lit(threshold).cast("decimal(10,2)"))
    return rows.orderBy(F.abs("his_amount_diff").desc(), F.col("dateadm").desc(), "tran_id").limit(k).select(
        "tran_id", "his_vn", "his_amount_diff", "dateadm", F.coalesce("reconcile_status", F.lit("pending")).alias("status")
    )


def filter_options(claims: DataFrame, k: int = 20) -> DataFrame:
    """Choices with counts: schemes, service types and the most used funds.

    Rows are counted once per combination; the three lists are rolled up from those counts.
    """
    cells = claims.groupBy("scheme", F.coalesce("service_type", F.lit("")).alias("service_type"), "main_fund").agg(F.count("*").alias("n"))
    keys = [F.col("scheme"), F.col("service_type"), F.col("main_fund")]
    n = cells.groupingSets([[keys[0]], [keys[1]], [keys[2]]], *keys).agg(F.grouping_id().alias("gid"), F.sum("n").alias("count"))
    # A bit is 1 where the column is rolled up: 011 scheme, 101 service type, 110 fund.
    which = F.when(F.col("gid") == 3, "scheme").when(F.col("gid") == 5, "service_type").otherwise("fund")
    flat = n.select(which.alias("option"), F.coalesce("scheme", "service_type", "main_fund").alias("value"), "count")
    flat = flat.filter(F.col("value").isNotNull())
    small = flat.filter(F.col("option") != "fund")
    return small.unionByName(topk(flat.filter(F.col("option") == "fund"), "count", k, "value"))


def dashboard_status(ledger: DataFrame, smt: DataFrame, matched_stm: DataFrame) -> DataFrame:
    """Files by import status, transfers and matched statements as one row."""
    s = F.col("status")
    files = ledger.agg(F.struct(
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.count_if(~s.isin("completed", "failed")).alias("pending"),
    )).scalar()
    pay = matched_stm.agg(F.struct(
        F.count_if(F.col("rep_matched")).alias("stm_matched"), F.count_if(~F.col("rep_matched")).alias("stm_unmatched")
    )).scalar()
    out = smt.agg(F.count("*").alias("transfers"), total("total_amount").alias("transfer_amount"), F.max("run_date").alias("last_sync"))
    return out.withColumn("f", files).withColumn("p", pay).select("f.*", "transfers", "transfer_amount", "last_sync", "p.*")


# --- years ----------------------------------------------------------------------------------


def default_fiscal_year(claims: DataFrame) -> Column:
    """Fiscal year of the latest claim, as a scalar column."""
    return claims.agg(fiscal.fiscal_year(F.max("dateadm"))).scalar()


def _two_years(claims: DataFrame, fy: int) -> DataFrame:
    lo, _ = fiscal.bounds(fy - 1)
    _, hi = fiscal.bounds(fy)
    rows = claims.filter(F.col("dateadm").between(F.lit(lo), F.lit(hi)))
    return rows.withColumn("cur", F.col("dateadm") >= F.lit(fiscal.bounds(fy)[0]))


def yoy(claims: DataFrame, fy: int) -> DataFrame:
    """One fiscal year against the one before it, both from one scan."""
    rows = _two_years(claims, fy)

    def side(p: str, here: Column) -> list[Column]:
        return [
            F.count_if(here).alias(f"{p}_claims"), total(F.when(here, F.col("claim_drg"))).alias(f"{p}_claimed"),
            total(F.when(here, F.col("reimb_nhso"))).alias(f"{p}_reimb"), total(F.when(here, F.col("paid"))).alias(f"{p}_paid"),
            F.count_if(here & is_error()).alias(f"{p}_denials"),
        ]

    out = rows.agg(*side("cur", F.col("cur")), *side("prev", ~F.col("cur")))
    c = F.col
    for p in ("cur", "prev"):
        out = out.withColumns(
            {
                f"{p}_denial_rate": ratio(c(f"{p}_denials"), c(f"{p}_claims")),
                f"{p}_reimb_rate": ratio(c(f"{p}_reimb"), c(f"{p}_claimed")),
            }
        )
    return out.withColumns(
        {
            "fiscal_year": F.lit(fy),
            "claims_change": change(c("cur_claims"), c("prev_claims")),
            "claimed_change": change(c("cur_claimed"), c("prev_claimed")),
            "reimb_change": change(c("cur_reimb"), c("prev_reimb")),
            "denial_rate_change": F.round(c("cur_denial_rate") - c("prev_denial_rate"), 2),
            "reimb_rate_change": F.round(c("cur_reimb_rate") - c("prev_reimb_rate"), 2),
        }
    )


# Thai short month names by month number.
THAI_SHORT_MONTHS = {
    10: "ต.ค.", 11: "พ.ย.", 12: "ธ.ค.", 1: "ม.ค.", 2: "ก.พ.", 3: "มี.ค.",
    4: "เม.ย.", 5: "พ.ค.", 6: "มิ.ย.", 7: "ก.ค.", 8: "ส.ค.", 9: "ก.ย.",
}


def yoy_monthly(claims: DataFrame, fy: int) -> DataFrame:
    """All twelve fiscal months, zeros where a year has no claims."""
    cur = F.col("cur")
    sums = _two_years(claims, fy).groupBy(F.month("dateadm").alias("month_num")).agg(
        F.count_if(cur).alias("current_claims"), total(F.when(cur, F.col("reimb_nhso"))).alias("current_reimb"),
        F.count_if(~cur).alias("prev_claims"), total(F.when(~cur, F.col("reimb_nhso"))).alias("prev_reimb"),
    )
    spark = claims.sparkSession
    frame = spark.createDataFrame([(i, m, THAI_SHORT_MONTHS[m]) for i, m in enumerate(fiscal.FISCAL_MONTHS)], "pos int, month_num int, month string")
    out = frame.join(sums, "month_num", "left").na.fill(0, ["current_claims", "prev_claims"])
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in ("current_reimb", "prev_reimb")})
    c = F.col
    return out.withColumns(
        {
            "claims_change": change(c("current_claims"), c("prev_claims")),
            "reimb_change": change(c("current_reimb"), c("prev_reimb")),
        }
    ).orderBy("pos").drop("pos")


def fiscal_years(claims: DataFrame, smt: DataFrame) -> DataFrame:
    """Fiscal years with data in either feed, newest first."""
    a = dated(claims).select(fiscal.fiscal_year("dateadm").alias("fiscal_year")).distinct()
    b = smt.select(fiscal.fiscal_year_be("posting_date").alias("fiscal_year")).filter("fiscal_year IS NOT NULL").distinct()
    return a.unionByName(b).distinct().orderBy(F.desc("fiscal_year"))


# --- risk and opportunities -----------------------------------------------------------------

# Claim amount bands (upper bound, name).
AMOUNT_BANDS = [(1000, "Under 1,000"), (5000, "1,000-5,000"), (10000, "5,000-10,000"), (50000, "10,000-50,000"), (None, "Over 50,000")]


def _filled(claims: DataFrame, col: str) -> DataFrame:
    return claims.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def risk_by_service(claims: DataFrame) -> DataFrame:
    return error_rates(_filled(claims, "service_type"), F.col("service_type"), "service_type", 10)


def risk_by_fund(claims: DataFrame) -> DataFrame:
    return error_rates(_filled(claims, "main_fund"), F.col("main_fund"), "fund", 5)


def risk_by_drg(claims: DataFrame, k: int = 20) -> DataFrame:
    return topk(error_rates(_filled(claims, "drg"), prefix("drg", 3), "drg_group", 5), "error_rate", k, "drg_group")


def risk_by_amount(claims: DataFrame) -> DataFrame:
    amount, name, slot = zero("claim_drg"), F.lit(AMOUNT_BANDS[-1][1]), F.lit(len(AMOUNT_BANDS))
    for i in range(len(AMOUNT_BANDS) - 2, -1, -1):
        bound, text = AMOUNT_BANDS[i]
        name, slot = F.when(amount < bound, text).otherwise(name), F.when(amount < bound, i + 1).otherwise(slot)
    rows = claims.withColumn("amount_range", F.concat_ws("|", slot.cast("string"), name))
    out = error_rates(rows, F.col("amount_range"), "band")
    return out.select(
        F.split_part("band", F.lit("|"), F.lit(2)).alias("amount_range"),
        F.split_part("band", F.lit("|"), F.lit(1)).cast("int").alias("sort_order"),
        "total_claims", "error_claims", "error_rate", "risk_level",
    ).orderBy("sort_order")


def risk_summary(claims: DataFrame) -> DataFrame:
    out = claims.agg(F.count("*").alias("total_claims"), F.count_if(is_error()).alias("total_errors"))
    return out.withColumn("overall_error_rate", ratio(F.col("total_errors"), F.col("total_claims")))


def _gap() -> Column:
    return zero("claim_drg") - zero("paid")


def under_reimbursed(claims: DataFrame, k: int = 30) -> DataFrame:
    rows = claims.filter((zero("claim_drg") > zero("paid") + 100) & ~is_error())
    out = rows.select("tran_id", "hn", "dateadm", "service_type", "drg", "claim_drg", "reimb_nhso", "paid", _gap().alias("potential_recovery"))
    return topk(out, "potential_recovery", k, "tran_id")


def fund_gaps(claims: DataFrame) -> DataFrame:
    rows = _filled(claims, "main_fund").filter(zero("claim_drg") > zero("paid") + 100).withColumn("gap", _gap())
    return rows.groupBy(F.col("main_fund").alias("fund")).agg(
        F.count("*").alias("claims"), F.sum("gap").alias("total_gap"), mean("gap").alias("avg_gap")
    )


def coding_opportunities(claims: DataFrame, k: int = 20) -> DataFrame:
    """Claims whose weight is under 70 % of their DRG group's mean though the amount is high."""
    rows = claims.filter(F.col("drg").isNotNull() & F.col("rw").isNotNull())
    both = compare_with_group(rows.select("tran_id", "hn", "drg", "rw", "claim_drg"), prefix("drg", 3), "rw", "avg_rw")
    weight = F.col("rw").cast("double")
    hit = both.filter((weight < F.col("avg_rw") * 0.7) & (F.col("claim_drg") > 5000))
    out = hit.select("tran_id", "hn", "drg", "rw", "claim_drg", F.round("avg_rw", 3).alias("avg_rw_for_drg"), F.round(F.col("avg_rw") - weight, 3).alias("rw_gap"))
    return topk(out, "claim_drg", k, "tran_id")


def resubmit(claims: DataFrame, k: int = 15) -> DataFrame:
    out = claims.filter(is_error()).groupBy("error_code").agg(
        F.count("*").alias("count"), total(zero("claim_drg")).alias("total_value"), mean(zero("claim_drg")).alias("avg_value")
    )
    return topk(out, "total_value", k, "error_code")


def opportunity_summary(claims: DataFrame) -> DataFrame:
    out = claims.agg(
        F.count("*").alias("total_claims"), total("claim_drg").alias("total_claimed"), total("paid").alias("total_paid"),
        F.count_if(is_error()).alias("error_claims"), total(F.when(is_error(), F.col("claim_drg"))).alias("error_claim_value"),
    )
    return out.withColumns(
        {"total_gap": F.col("total_claimed") - F.col("total_paid"), "reimbursement_rate": ratio(F.col("total_paid"), F.col("total_claimed"))}
    )


# --- exports --------------------------------------------------------------------------------


def monthly_export(claims: DataFrame) -> DataFrame:
    rows = _efficiency(dated(claims), fiscal.ym("dateadm").alias("month"))
    return rows.select("month", "claims", "claimed", "reimbursed", "denied", "reimb_rate")


def denial_export(claims: DataFrame) -> DataFrame:
    out = denied(claims).groupBy("error_code").agg(F.count("*").alias("count"), total("claim_drg").alias("amount"))
    return share(out)


def external_summary(claims: DataFrame) -> DataFrame:
    """Totals and match rate overall and by the batch number's first three characters."""
    rows = claims.withColumn("code", F.coalesce(F.upper(prefix("rep_no", 3)), F.lit("UNKNOWN")))
    hit = F.coalesce(F.col("his_matched"), F.lit(False))
    cells = rows.groupBy("code").agg(
        F.count("*").alias("total_claims"), total("claim_net").alias("total_amount"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"),
    )
    names = ("total_claims", "total_amount", "matched", "unmatched")
    out = cells.groupingSets([[F.col("code")], []], F.col("code")).agg(F.grouping("code").alias("g"), *[total(c).alias(c) for c in names])
    return out.withColumns(
        {"code": F.when(F.col("g") == 1, "ALL").otherwise(F.col("code")), "match_rate": ratio(F.col("matched"), F.col("total_claims"), 4, 1)}
    ).drop("g")


def recent_claims(claims: DataFrame, ledger: DataFrame, k: int = 100) -> DataFrame:
    """Newest claims with the file they came from: the top-k is taken before the lookup."""
    top = claims.orderBy(F.desc_nulls_last("dateadm"), "tran_id").limit(k)
    return top.join(ledger.select("file_id", "filename"), "file_id", "left")
