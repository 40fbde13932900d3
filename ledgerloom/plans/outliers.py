"""Unusual amounts and weights, and the revenue projection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.money import total, zero
from ..operators.quantiles import distribution, fences
from .reports import topk

_SHOWN = ["tran_id", "hn", "dateadm", "service_type", "drg"]


def amount_statistics(claims: DataFrame, approx: bool = False) -> DataFrame:
    return fences(distribution(claims, "claim_drg", approx))


def high_value(claims: DataFrame, k: int = 20, approx: bool = False) -> DataFrame:
    """The largest claims above the upper fence with their distance from the mean in deviations."""
    stats = amount_statistics(claims, approx).select(F.struct("upper", "mean", "std")).scalar()
    top = claims.select(*_SHOWN, "claim_drg", "reimb_nhso", "error_code").orderBy(F.desc("claim_drg"), "tran_id").limit(k)
    rows = top.withColumn("s", stats).filter(F.col("claim_drg") > F.col("s.upper"))
    z = (F.col("claim_drg").cast("double") - F.col("s.mean")) / F.col("s.std")
    return rows.withColumn("deviation", F.when(F.col("s.std") > 0, F.round(z, 2)).otherwise(F.lit(0.0))).drop("s")


def outlier_counts(claims: DataFrame, approx: bool = False) -> DataFrame:
    """Claims above the upper and below the lower fence (never under zero)."""
    stats = amount_statistics(claims, approx).select(F.struct("lower", "upper")).scalar()
    rows = claims.select(zero("claim_drg").cast("double").alias("x")).withColumn("s", stats)
    return rows.agg(
        F.count("*").alias("total_claims"), F.count_if(F.col("x") > F.col("s.upper")).alias("high_value_anomalies"),
        F.count_if(F.col("x") < F.greatest(F.col("s.lower"), F.lit(0.0))).alias("low_value_anomalies"),
    )


def variance_outliers(claims: DataFrame, k: int = 20, times: int = 3) -> DataFrame:
    """Claims whose claimed and reimbursed amounts differ by over three mean differences."""
    rows = claims.filter(F.col("claim_drg").isNotNull() & F.col("reimb_nhso").isNotNull())
    rows = rows.withColumn("variance", F.col("claim_drg") - F.col("reimb_nhso"))
    gap = F.abs(F.col("variance"))
    limit = rows.agg(F.sum(gap).cast("double") / F.count("*") * times).scalar()
    out = rows.select(*_SHOWN, "claim_drg", "reimb_nhso", "paid", "variance").orderBy(gap.desc(), "tran_id").limit(k)
    return out.withColumn("limit", limit).filter(gap > F.col("limit")).drop("limit")


def rw_outliers(claims: DataFrame, k: int = 15) -> DataFrame:
    """Weights over the mean plus two deviations."""
    rows = claims.filter(F.col("rw").isNotNull())
    x = F.col("rw").cast("double")
    limit = rows.agg((F.sum("rw").cast("double") / F.count("rw") + 2 * F.stddev_samp(x))).scalar()
    out = rows.select("tran_id", "hn", "dateadm", "drg", "rw", "claim_drg").orderBy(F.desc("rw"), "tran_id").limit(k)
    return out.withColumn("limit", limit).filter(x > F.col("limit")).drop("limit")


def monthly_history(claims: DataFrame, as_of: dt.date, months: int = 24) -> DataFrame:
    rows = claims.filter(F.col("dateadm") >= F.add_months(F.lit(as_of), -months))
    return rows.groupBy(fiscal.ym("dateadm").alias("month")).agg(
        F.count("*").alias("claims"), total("claim_drg").alias("claimed"), total("reimb_nhso").alias("reimb"), total("paid").alias("paid")
    )


def forecast(claims: DataFrame, as_of: dt.date, horizon: int = 6, from_intercept: bool = False) -> DataFrame:
    """Projected reimbursement per coming month; no rows with under six months of history.

    The trend of the last six months is added to their mean and scaled by the same month a year
    ago.  ``from_intercept`` starts the trend line at its own intercept instead of the mean.
    """
    history = monthly_history(claims, as_of)  # at most 25 rows from here on
    six = history.orderBy(F.desc("month")).limit(6)
    six = six.withColumn("i", (F.row_number().over(Window.orderBy("month")) - 1).cast("double"))
    y = F.col("reimb").cast("double")
    base = six.agg(
        F.count("*").alias("n"), F.avg(y).alias("avg"), F.regr_slope(y, F.col("i")).alias("slope"),
        F.max("month").alias("last"), F.avg("claims").alias("claims"),
    ).filter("n = 6")
    ahead = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    start = F.to_date(F.concat("last", F.lit("-01")))
    ahead = ahead.withColumn("month", F.date_format(F.add_months(start, F.col("i")), "yyyy-MM"))
    ahead = ahead.withColumn("year_ago", F.date_format(F.add_months(start, F.col("i") - 12), "yyyy-MM"))
    past = history.select(F.col("month").alias("year_ago"), F.col("reimb").cast("double").alias("past"))
    rows = ahead.join(past, "year_ago", "left")
    origin = F.col("avg") - F.col("slope") * 2.5 if from_intercept else F.col("avg")
    projected = origin + F.col("slope") * (F.col("n") + F.col("i") - 1)
    season = F.when(F.col("avg") > 0, F.coalesce(F.col("past") / F.col("avg"), F.lit(1.0))).otherwise(F.lit(1.0))
    rows = rows.withColumn("v", projected * season)
    return rows.select(
        "month", F.round("v", 2).alias("projected_reimb"), F.round("claims").cast("bigint").alias("projected_claims"),
        F.greatest(F.lit(50), 95 - F.col("i") * 7).alias("confidence"),
        F.round(F.col("v") * 0.85, 2).alias("lower_bound"), F.round(F.col("v") * 1.15, 2).alias("upper_bound"),
    ).orderBy("month")
