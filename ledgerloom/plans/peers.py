"""One hospital against the others: transfers per vendor, region averages, ranks, targets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.money import is_error, mean, ratio, total, zero
from ..functions.text import digits_key
from ..operators.filters import fiscal_months, fiscal_year, lookup, vendor_eq
from ..operators.joins import by_either_code
from ..operators.windows import prefer, standing

_SUMS = ("total_amount", "wait_amount", "debt_amount", "bond_amount")


def hospitals(smt: DataFrame, offices: DataFrame, fy: int | None = None) -> DataFrame:
    """Totals per vendor with the facility's name; summed before the name is looked up."""
    rows = fiscal_year(smt, fy, "run_date") if fy else smt
    sums = rows.groupBy("vendor_no").agg(
        F.count("*").alias("records"), *[total(c).alias(c) for c in _SUMS],
        F.min("run_date").alias("first_date"), F.max("run_date").alias("last_date"),
    )
    dim = offices.select("hcode5", F.col("name").alias("hospital_name"))
    return by_either_code(sums, dim, "vendor_no", "hcode5").drop("hcode5").orderBy(F.desc("total_amount"), "vendor_no")


def timeseries(smt: DataFrame, fy: int | None = None, first: int = 10, last: int = 9) -> DataFrame:
    rows = fiscal_months(smt, fy, first, last, "run_date") if fy else smt
    return rows.groupBy("vendor_no", fiscal.ym("run_date").alias("month")).agg(
        F.count("*").alias("records"), *[total(c).alias(c) for c in _SUMS[:3]]
    )


def timeseries_nested(smt: DataFrame, fy: int | None = None) -> DataFrame:
    """One row per vendor with a month -> amount map."""
    pairs = F.sort_array(F.collect_list(F.struct("month", "total_amount")))
    return timeseries(smt, fy).groupBy("vendor_no").agg(F.map_from_entries(pairs).alias("months"))


def vendor_years(smt: DataFrame, vendor: str, as_of: dt.date, since: int = 2565) -> DataFrame:
    """Every fiscal year from ``since`` (or the first with data) to now, zeros where none."""
    mine = vendor_eq(smt, vendor).groupBy(fiscal.fiscal_year("run_date").alias("year")).agg(
        F.count("*").alias("records"), total("total_amount").alias("total_amount")
    )
    now = fiscal.fiscal_year_of(as_of)
    frame = smt.sparkSession.range(since, now + 1).select(F.col("id").cast("int").alias("year"))
    years = frame.unionByName(mine.select("year")).distinct()
    out = years.join(mine, "year", "left").withColumn("has_data", F.col("records").isNotNull()).na.fill(0, ["records"])
    return out.withColumn("total_amount", zero("total_amount")).orderBy(F.desc("year"))


# Words in a fund's name that decide its category.
IPD_WORDS, IPD_CODE = ["ผู้ป่วยใน"], "IP_CF"
OPD_WORDS, OPD_CODE = ["ผู้ป่วยนอก"], "OP_CF"
CENTRAL_WORDS = ["CENTRAL REIMBURSE"]
PREVENTION_PATTERNS = ["%สร้างเสริมสุขภาพ%", "%ป้องกันโรค%", "%ควบคุม%ป้องกัน%"]
FUND_CATEGORIES = ["OPD", "IPD", "CR", "PP", "OTHER"]


def fund_category(fund: Column) -> Column:
    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | fund.ilike(p)
        return out

    return (
        F.when(any_of([f"%{w}%" for w in IPD_WORDS]) | (fund == IPD_CODE), "IPD")
        .when(any_of([f"%{w}%" for w in OPD_WORDS]) | (fund == OPD_CODE), "OPD")
        .when(any_of([f"%{w}%" for w in CENTRAL_WORDS]), "CR")
        .when(any_of(PREVENTION_PATTERNS), "PP")
        .otherwise("OTHER")
    )


def _mine(smt: DataFrame, vendor: str) -> DataFrame:
    """Rows of one vendor in either written form."""
    short = vendor.lstrip("0")
    return smt.filter(F.col("vendor_no").isin(vendor.zfill(10), short))


def hospital_summary(smt: DataFrame, offices: DataFrame, vendor: str, fy: int) -> DataFrame:
    """A vendor's year in one row: totals, growth, wait and debt ratios, money per bed, risk.

    This year and last year come from one scan of the vendor's rows.
    """
    lo, _ = fiscal.bounds(fy - 1)
    start, hi = fiscal.bounds(fy)
    rows = _mine(smt, vendor).filter(F.col("run_date").between(F.lit(lo), F.lit(hi)))
    now = F.col("run_date") >= F.lit(start)
    ipd = now & (fund_category(F.col("fund_name")) == "IPD")
    opd = now & (fund_category(F.col("fund_name")) == "OPD")

    def s(name: str, cond: Column) -> Column:
        return total(F.when(cond, F.col(name)))

    beds = lookup(offices, vendor.lstrip("0")).agg(F.coalesce(F.max("actual_beds"), F.lit(0))).scalar()
    out = rows.agg(
        F.count_if(now).alias("record_count"), *[s(c, now).alias(c) for c in _SUMS], s("total_amount", ~now).alias("prev_total"),
        s("total_amount", ipd).alias("ipd_amount"), s("wait_amount", ipd).alias("ipd_wait"), s("debt_amount", ipd).alias("ipd_debt"),
        s("total_amount", opd).alias("opd_amount"),
    ).withColumn("actual_beds", beds)
    c = F.col

    def bed(x: str) -> Column:
        return ratio(c(x), c("actual_beds"), 2, 1)

    out = out.withColumns(
        {
            "growth_raw": ratio(c("total_amount") - c("prev_total"), c("prev_total"), 12),
            "wait_ratio": ratio(c("wait_amount"), c("total_amount"), 6),
            "debt_ratio": ratio(c("debt_amount"), c("total_amount"), 6),
            "ipd_ratio": ratio(c("ipd_amount"), c("total_amount"), 1),
            "opd_ratio": ratio(c("opd_amount"), c("total_amount"), 1),
            "ipd_revenue_per_bed": bed("ipd_amount"), "wait_per_bed": bed("ipd_wait"), "debt_per_bed": bed("ipd_debt"),
        }
    )
    out = out.withColumns({"growth_yoy": F.round("growth_raw", 1), "risk_score": risk_score(c("wait_ratio"), c("debt_ratio"), c("growth_raw"))})
    return out.withColumn("risk_level", risk_level(c("risk_score"))).drop("growth_raw", "ipd_wait", "ipd_debt")


def risk_score(wait: Column, debt: Column, growth: Column) -> Column:
    """0..100 from the wait share, the debt share and a falling total."""
    w = F.least(F.lit(100.0), wait / 20 * 100)
    d = F.least(F.lit(100.0), debt / 15 * 100)
    g = F.when(growth >= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.abs(growth) * 2))
    return F.floor(w * 0.3 + d * 0.4 + g * 0.3).cast("int")


def risk_level(score: Column) -> Column:
    return F.when(score < 40, "low").when(score < 70, "medium").otherwise("high")


def risk_all(smt: DataFrame, fy: int) -> DataFrame:
    """The risk score of every vendor at once."""
    lo, _ = fiscal.bounds(fy - 1)
    start, hi = fiscal.bounds(fy)
    rows = smt.filter(F.col("run_date").between(F.lit(lo), F.lit(hi)))
    now = F.col("run_date") >= F.lit(start)
    sums = rows.groupBy(digits_key("vendor_no").alias("vendor")).agg(
        *[total(F.when(now, F.col(c))).alias(c) for c in _SUMS[:3]], total(F.when(~now, F.col("total_amount"))).alias("prev_total")
    )
    c = F.col
    score = risk_score(
        ratio(c("wait_amount"), c("total_amount"), 6), ratio(c("debt_amount"), c("total_amount"), 6),
        ratio(c("total_amount") - c("prev_total"), c("prev_total"), 12),
    )
    out = sums.withColumn("risk_score", score)
    return out.withColumn("risk_level", risk_level(c("risk_score"))).select("vendor", "total_amount", "risk_score", "risk_level")


def hospital_categories(smt: DataFrame, vendor: str, fy: int) -> DataFrame:
    """The five fund categories, zeros where a vendor has none, with their share."""
    rows = fiscal_year(_mine(smt, vendor), fy, "run_date")
    sums = rows.groupBy(fund_category(F.col("fund_name")).alias("category")).agg(F.count("*").alias("records"), *[total(c).alias(c) for c in _SUMS[:3]])
    frame = smt.sparkSession.createDataFrame([(c,) for c in FUND_CATEGORIES], "category string")
    out = frame.join(sums, "category", "left").na.fill(0, ["records"]).withColumns({c: zero(c) for c in _SUMS[:3]})
    whole = out.agg(F.sum("total_amount")).scalar()
    return out.withColumn("ratio", ratio(F.col("total_amount"), whole, 1))


def hospital_funds(smt: DataFrame, vendor: str, fy: int) -> DataFrame:
    rows = fiscal_year(_mine(smt, vendor), fy, "run_date")
    out = rows.groupBy("fund_name", "fund_group", "fund_group_desc").agg(total("total_amount").alias("amount"), F.count("*").alias("records"))
    whole = rows.agg(F.sum("total_amount")).scalar()
    return out.withColumn("percentage", ratio(F.col("amount"), whole, 6)).withColumn("fund_name", F.coalesce("fund_name", F.lit("ไม่ระบุ")))


def hospital_months(smt: DataFrame, vendor: str, fy: int) -> DataFrame:
    rows = fiscal_year(_mine(smt, vendor), fy, "run_date")
    return rows.groupBy(fiscal.ym("run_date").alias("month")).agg(F.count("*").alias("records"), *[total(c).alias(c) for c in _SUMS[:3]]).orderBy("month")


def ranking(smt: DataFrame, vendor: str, fy: int) -> DataFrame:
    """A vendor's place among all vendors of the year."""
    rows = fiscal_year(smt, fy, "run_date")
    totals = rows.groupBy("vendor_no").agg(F.sum("total_amount").alias("total"))
    mine = _mine(rows, vendor).agg(total("total_amount")).scalar()
    return standing(totals, "total", mine)


def _region_rows(smt: DataFrame, offices: DataFrame, region: str, fy: int) -> DataFrame:
    """Transfers of a region's hospitals: the region's codes in both written forms, then a semi join."""
    rows = fiscal_year(smt, fy, "run_date")
    codes = offices.filter(F.col("health_region") == region).select("hcode5")
    forms = codes.select(F.explode(F.array(F.col("hcode5"), F.lpad("hcode5", 10, "0"))).alias("vendor_no")).distinct()
    return rows.join(forms, "vendor_no", "left_semi")


def region_average(smt: DataFrame, offices: DataFrame, region: str, fy: int) -> DataFrame:
    per = _region_rows(smt, offices, region, fy).groupBy("vendor_no").agg(*[F.sum(c).alias(c) for c in _SUMS[:3]])
    out = per.agg(
        F.count("*").alias("hospital_count"),
        *[F.coalesce(mean(c), F.lit(0.0)).alias("avg_" + c) for c in _SUMS[:3]],
        total("total_amount").alias("total_amount"),
    )
    c = F.col
    return out.withColumns(
        {"avg_wait_ratio": ratio(c("avg_wait_amount"), c("avg_total_amount"), 6), "avg_debt_ratio": ratio(c("avg_debt_amount"), c("avg_total_amount"), 6)}
    )


def region_funds(smt: DataFrame, offices: DataFrame, region: str, fy: int) -> DataFrame:
    per = _region_rows(smt, offices, region, fy).groupBy("vendor_no", "fund_name", "fund_group").agg(F.sum("total_amount").alias("amount"))
    return per.groupBy("fund_name", "fund_group").agg(mean("amount").alias("avg_amount"), F.sum("amount").alias("total_amount"))


def region_months(smt: DataFrame, offices: DataFrame, region: str, fy: int) -> DataFrame:
    """Month totals; the average is per transfer row."""
    rows = _region_rows(smt, offices, region, fy)
    return rows.groupBy(fiscal.ym("run_date").alias("month")).agg(total("total_amount").alias("total_amount"), mean("total_amount").alias("avg_amount"))


# --- targets --------------------------------------------------------------------------------


def benchmark_metrics(claims: DataFrame, inpatient: Column | None = None, outpatient: Column | None = None) -> DataFrame:
    """Rates and averages to hold against targets.

    What marks an inpatient or outpatient claim differs between feeds, so both are parameters.
    """
    ip = F.col("ptype") == "IP" if inpatient is None else inpatient
    op = F.col("ptype") == "OP" if outpatient is None else outpatient
    rows = claims.filter(F.col("claim_drg") > 0)
    amount = F.col("claim_drg")
    return rows.agg(
        ratio(total("reimb_nhso"), F.sum("claim_drg")).alias("reimb_rate"),
        ratio(F.count_if(is_error(exclude=("0",))), F.count("*")).alias("denial_rate"),
        F.round(mean(F.when(ip, amount)), 2).alias("avg_claim_ip"), F.round(mean(F.when(op, amount)), 2).alias("avg_claim_op"),
        F.round(mean("rw"), 4).alias("avg_rw"), F.count("*").alias("total_claims"),
        F.min("dateadm").alias("min_date"), F.max("dateadm").alias("max_date"),
    )


# Metric, whether more is better (1), less is better (-1) or neither (0), digits.
METRICS = [("reimb_rate", 1, 2), ("denial_rate", -1, 2), ("avg_claim_ip", 0, 2), ("avg_claim_op", 0, 2), ("avg_rw", 1, 4)]


def benchmark_compare(metrics: DataFrame, targets: DataFrame, region: str, fy: int, level: str | None = None) -> DataFrame:
    """Own metrics against targets; the region's own target is preferred over the national one."""
    place = level or region
    t = targets.filter(F.col("region").isin(place, "national") & (F.col("fiscal_year") == fy))
    best = prefer(t, ["metric_name"], F.when(F.col("region") == place, 0).otherwise(1))
    own = [
        F.struct(
            F.lit(m).alias("metric_name"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("hospital_value"),
            F.lit(sign).alias("sign"), F.lit(digits).alias("digits"),
        )
        for m, sign, digits in METRICS
    ]
    long = metrics.select(F.explode(F.array(*own)).alias("m")).select("m.*")
    rows = long.join(best.select("metric_name", F.col("value").cast("double").alias("benchmark_value")), "metric_name")
    diff, sign = F.col("hospital_value") - F.col("benchmark_value"), F.col("sign")
    return rows.withColumns(
        {
            "difference": F.when(F.col("digits") == 4, F.round(diff, 4)).otherwise(F.round(diff, 2)),
            "difference_pct": F.when(sign == 0, ratio(diff, F.col("benchmark_value"), 1)),
            "status": F.when(diff > 0, "above").when(diff < 0, "below").otherwise("equal"),
            "is_good": F.when(sign != 0, diff * sign >= 0),
        }
    ).drop("sign", "digits")


def benchmark_score(comparison: DataFrame) -> DataFrame:
    out = comparison.agg(F.count_if(F.col("is_good")).alias("good"), F.count("is_good").alias("scored"))
    score = F.when(F.col("scored") > 0, F.round(F.col("good") / F.col("scored") * 100)).otherwise(0).cast("int")
    s = F.col("score")
    status = (
        F.when(F.col("scored") == 0, "unknown").when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").otherwise("needs_improvement")
    )
    return out.withColumn("score", score).withColumn("overall_status", status)
