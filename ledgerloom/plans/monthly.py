"""Claims against transfers by month and by fund, and how well they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.money import ratio, total, zero
from ..functions.text import first_token, prefix
from ..operators.filters import fiscal_year, fiscal_year_be, same_vendor

# Claim fund code to transfer fund group.
FUND_GROUPS = {
    "IP01": "กองทุนผู้ป่วยใน",
    "IP02": "กองทุนผู้ป่วยใน",
    "IP03": "กองทุนผู้ป่วยใน",
    "OP01": "กองทุนผู้ป่วยนอก",
    "OP02": "กองทุนผู้ป่วยนอก",
    "HC02": "กองทุนสร้างเสริมสุขภาพและป้องกันโรค",
    "HC16": "กองทุนค่าบริการทางการแพทย์",
    "DM14": "บริการควบคุมป้องกันและรักษาผู้ป่วยโรคเบาหวานและความดันโลหิตสูง",
    "KT01": "กองทุนไตวายเรื้อรัง",
    "AIDS": "กองทุนเอดส์",
    "RH01": "ค่าบริการฟื้นฟูสมรรถภาพด้านการแพทย์",
    "TM01": "งบแพทย์แผนไทย",
    "ONTOP": "กองทุน CENTRAL REIMBURSE",
}
NO_GROUP = "ไม่ระบุ"


def rep_monthly(claims: DataFrame) -> DataFrame:
    """Claims by month and fund."""
    rows = claims.filter(F.col("dateadm").isNotNull())
    out = rows.groupBy(fiscal.ym("dateadm").alias("month_gregorian"), "main_fund").agg(
        F.count("*").alias("claim_count"), total("reimb_nhso").alias("reimb_nhso"), total("reimb_agency").alias("reimb_agency")
    )
    year, month = F.left("month_gregorian", F.lit(4)).cast("int"), F.right("month_gregorian", F.lit(2))
    return out.withColumns(
        {
            "month_be": F.concat((year + fiscal.ERA).cast("string"), month),
            "main_fund": F.coalesce("main_fund", F.lit("UNKNOWN")),
            "total_claim": F.col("reimb_nhso") + F.col("reimb_agency"),
        }
    )


def _transfers(smt: DataFrame, vendor: str | None) -> DataFrame:
    rows = smt.filter(F.col("posting_date").isNotNull())
    return rows.filter(same_vendor(vendor)) if vendor else rows


def smt_monthly(smt: DataFrame, vendor: str | None = None) -> DataFrame:
    """Transfers by month, fund group and fund."""
    out = _transfers(smt, vendor).groupBy(prefix("posting_date", 6).alias("month_be"), "fund_group_desc", "fund_name").agg(
        F.count("*").alias("payment_count"), total("total_amount").alias("total_amount")
    )
    return out.withColumn("month_gregorian", fiscal.be_month_to_ym("month_be"))


def _by_month(claims: DataFrame, smt: DataFrame, vendor: str | None) -> tuple[DataFrame, DataFrame]:
    rep = claims.filter(F.col("dateadm").isNotNull()).groupBy(fiscal.to_be_month("dateadm").alias("month_be")).agg(
        F.count("*").alias("claim_count"), F.countDistinct("tran_id").alias("unique_claims"),
        total("reimb_nhso").alias("reimb_nhso"), total("reimb_agency").alias("reimb_agency"),
    )
    pay = _transfers(smt, vendor).groupBy(prefix("posting_date", 6).alias("month_be")).agg(
        F.count("*").alias("payment_count"), total("total_amount").alias("payment_amount"),
        total("wait_amount").alias("wait_amount"), total("debt_amount").alias("debt_amount"),
    )
    return rep, pay


def _merged(out: DataFrame) -> DataFrame:
    money = ("reimb_nhso", "reimb_agency", "payment_amount", "wait_amount", "debt_amount")
    flags = {"has_rep_data": F.col("claim_count").isNotNull(), "has_smt_data": F.col("payment_count").isNotNull()}
    out = out.withColumns(flags).na.fill(0, ["claim_count", "unique_claims", "payment_count"])
    out = out.withColumns({c: zero(c) for c in money})
    out = out.withColumn("claim_total", F.col("reimb_nhso") + F.col("reimb_agency"))
    return out.withColumns(
        {
            "difference": F.col("payment_amount") - F.col("claim_total"),
            "month_gregorian": fiscal.be_month_to_ym("month_be"),
            "month_display": fiscal.be_month_label("month_be"),
        }
    )


def monthly_reconciliation(claims: DataFrame, smt: DataFrame, vendor: str | None = None) -> DataFrame:
    """Months of either feed; both sides are aggregated before they meet."""
    rep, pay = _by_month(claims, smt, vendor)
    return _merged(rep.join(pay, "month_be", "full_outer"))


def monthly_reconciliation_fy(claims: DataFrame, smt: DataFrame, fy: int, vendor: str | None = None) -> DataFrame:
    """All twelve months of a fiscal year, with or without data."""
    rep, pay = _by_month(fiscal_year(claims, fy), fiscal_year_be(smt, fy), vendor)
    months = claims.sparkSession.createDataFrame([(m,) for m in fiscal.months_be(fy)], "month_be string")
    return _merged(months.join(rep, "month_be", "left").join(pay, "month_be", "left"))


def fund_reconciliation(claims: DataFrame, smt: DataFrame, month_be: str | None = None, vendor: str | None = None) -> DataFrame:
    """Claim funds beside the transfer group they map to; groups no claim maps to follow.

    Several claim funds may share a group, whose payment then stands beside each of them.
    """
    rep = claims.filter(F.col("dateadm").isNotNull())
    pay = _transfers(smt, vendor)
    if month_be:
        rep = rep.filter(fiscal.to_be_month("dateadm") == month_be)
        pay = pay.filter(prefix("posting_date", 6) == month_be)
    rep = rep.groupBy("main_fund").agg(F.count("*").alias("claim_count"), total("reimb_nhso").alias("claim_amount"))
    pay = pay.groupBy("fund_group_desc").agg(F.count("*").alias("payment_count"), total("total_amount").alias("payment_amount"))
    groups = F.create_map(*[F.lit(x) for kv in FUND_GROUPS.items() for x in kv])
    rep = rep.withColumn("rep_fund_code", F.coalesce("main_fund", F.lit("UNKNOWN"))).withColumn(
        "smt_fund_name", F.coalesce(F.try_element_at(groups, first_token("rep_fund_code")), F.lit(NO_GROUP))
    )
    pay = pay.withColumnRenamed("fund_group_desc", "smt_fund_name")
    both = rep.join(pay, "smt_fund_name", "left").withColumn("matched", F.col("payment_count").isNotNull())
    mapped = rep.filter(F.col("smt_fund_name") != NO_GROUP).select("smt_fund_name").distinct()
    rest = pay.join(mapped, "smt_fund_name", "left_anti").withColumns(
        {"rep_fund_code": F.lit("-"), "claim_count": F.lit(0).cast("bigint"), "claim_amount": F.lit(0).cast("decimal(22,2)"), "matched": F.lit(False)}
    )
    cols = ["rep_fund_code", "smt_fund_name", "claim_count", "claim_amount", "payment_count", "payment_amount", "matched"]
    out = both.select(*cols).unionByName(rest.select(*cols)).na.fill(0, ["payment_count"]).withColumn("payment_amount", zero("payment_amount"))
    return out.withColumn("difference", F.col("payment_amount") - F.col("claim_amount")).orderBy(F.desc("payment_amount"), "rep_fund_code")


def summary_stats(claims: DataFrame, smt: DataFrame, fy: int | None = None, vendor: str | None = None) -> DataFrame:
    """Both feeds of a fiscal year (or all time) as one row."""
    if fy:
        claims, smt = fiscal_year(claims, fy), fiscal_year_be(smt, fy)
    pay = _transfers(smt, vendor).agg(F.struct(
        F.count("*").alias("total_payments"), total("total_amount").alias("smt_amount"), total("wait_amount").alias("smt_wait"),
        total("debt_amount").alias("smt_debt"), fiscal.be_to_date(F.min("posting_date")).alias("smt_first"),
        fiscal.be_to_date(F.max("posting_date")).alias("smt_last"),
    )).scalar()
    out = claims.agg(
        F.count("*").alias("total_claims"), F.countDistinct("tran_id").alias("unique_claims"),
        total("reimb_nhso").alias("total_reimb_nhso"), total("reimb_agency").alias("total_reimb_agency"),
        F.min("dateadm").alias("rep_first"), F.max("dateadm").alias("rep_last"),
    )
    return out.withColumn("rep_amount", F.col("total_reimb_nhso") + F.col("total_reimb_agency")).withColumn("p", pay).select("*", "p.*").drop("p")


def performance(summary: DataFrame, months: DataFrame) -> DataFrame:
    """Agreement of claims and payments over the months, and how complete the claims look."""
    c = F.col
    both = c("has_rep_data") & c("has_smt_data")
    close = both & (c("claim_total") > 0) & (F.abs(c("difference").cast("double") / F.nullif(c("claim_total").cast("double"), F.lit(0.0))) < 0.01)
    m = months.agg(F.struct(
        F.count("*").alias("total_months"), F.count_if(close).alias("matched_months"),
        F.count_if(both & (c("difference") < 0)).alias("underpaid_months"),
        F.count_if(c("has_rep_data") & ~c("has_smt_data")).alias("pending_months"),
        F.max_by("month_be", F.when(c("has_rep_data") & (c("claim_total") > 0), F.struct("claim_total", "month_be"))).alias("top_month"),
    )).scalar()
    s = summary.select("total_claims", "rep_amount", "smt_amount").withColumn("m", m).select("*", "m.*").drop("m")
    rep, pay, n = c("rep_amount"), c("smt_amount"), c("total_claims")

    def of_months(x: str) -> Column:
        return ratio(c(x), c("total_months"), 6)

    out = s.withColumns(
        {
            "payment_accuracy": of_months("matched_months"), "underpayment_rate": of_months("underpaid_months"), "pending_rate": of_months("pending_months"),
            "claim_to_payment_ratio": ratio(pay, rep, 6), "avg_difference": ratio(pay - rep, n, 6, 1),
            "coverage_rate": ratio(rep, pay, 6), "avg_claim_amount": ratio(rep, n, 6, 1),
            "missing_amount": F.when(pay > rep, (pay - rep).cast("double")).otherwise(F.lit(0.0)),
        }
    )
    cover = c("coverage_rate")
    out = out.withColumns(
        {
            "alert_level": F.when(cover < 20, "critical").when(cover < 50, "warning").when(cover < 80, "caution").otherwise("good"),
            "expected_claims": F.when(rep > 0, F.floor(pay.cast("double") / (rep.cast("double") / n.cast("double")))).otherwise(F.lit(0)).cast("bigint"),
        }
    )
    return out.withColumn("missing_claims", F.greatest(F.lit(0), c("expected_claims") - n)).drop("rep_amount", "smt_amount")
