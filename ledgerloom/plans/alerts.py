"""Threshold alerts and insight rules over the latest months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.money import is_error, ratio, ratio_or_null, total, zero
from ..operators.filters import aged_unpaid, is_aged_unpaid
from ..operators.windows import change_between_months
from .reports import order_rank

# Alert thresholds as (id, metric, threshold, severity), the severe one first.
DENIAL_LIMITS = [("denial_rate_high", 10, "critical"), ("denial_rate_warning", 5, "warning")]
PAID_LIMITS = [("reimb_rate_low", 85, "critical"), ("reimb_rate_warning", 90, "warning")]
DECLINE_LIMITS = [("revenue_decline", -20, "critical"), ("revenue_decline_warning", -10, "warning")]
PENDING_LIMIT = 100
SEVERITIES = ["critical", "warning", "info"]


def _first_rule(metric: str, value: Column, limits: list[tuple[str, float, str]], below: bool) -> Column:
    """A struct for the first limit that ``value`` breaks, null if none."""
    out = F.lit(None)
    for name, limit, severity in reversed(limits):
        hit = value < limit if below else value > limit
        rule = F.struct(
            F.lit(name).alias("id"), F.lit(metric).alias("metric"), F.lit(severity).alias("severity"),
            value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"),
        )
        out = F.when(hit, rule).otherwise(out)
    return out


def alerts(claims: DataFrame, as_of: dt.date, paid: str = "paid") -> DataFrame:
    """Alerts for the month of ``as_of``, most severe first."""
    start = as_of.replace(day=1)
    since = F.add_months(F.lit(start), -2)
    now = claims.filter(F.col("dateadm") >= F.lit(start)).agg(F.struct(
        F.count("*").alias("n"), F.count_if(is_error()).alias("denied"), total("claim_drg").alias("claimed"), total(paid).alias("paid")
    )).scalar()
    months = claims.filter(F.col("dateadm") >= since).groupBy(fiscal.ym("dateadm").alias("month")).agg(total("reimb_nhso").alias("reimb"))
    mom = change_between_months(months, "month", "reimb").agg(F.max("change_pct")).scalar()
    waiting = aged_unpaid(claims, 30, as_of).agg(F.count("*")).scalar()
    one = claims.sparkSession.range(1).select(now.alias("now"), mom.alias("mom"), waiting.alias("waiting"))
    c = F.col
    denial = ratio(c("now.denied"), c("now.n"))
    rate = ratio(c("now.paid"), c("now.claimed"))
    rules = F.array(
        F.when(c("now.n") > 0, _first_rule("denial_rate", denial, DENIAL_LIMITS, False)),
        F.when((c("now.n") > 0) & (c("now.claimed") > 0), _first_rule("reimb_rate", rate, PAID_LIMITS, True)),
        _first_rule("mom_change", c("mom"), DECLINE_LIMITS, True),
        _first_rule("pending_claims", c("waiting"), [("pending_claims", PENDING_LIMIT, "warning")], False),
    )
    out = one.select(F.explode(F.array_compact(rules)).alias("a")).select("a.*")
    return order_rank(out, "severity", SEVERITIES, F.col("id"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    s = F.col("severity")
    return alerts.agg(F.count("*").alias("total"), F.count_if(s == "critical").alias("critical_count"), F.count_if(s == "warning").alias("warning_count"))


# Points per insight and its priority.
POINTS = {"denial_up": 30, "service": 15, "paid_low": 25, "top_error": 10, "pending": 15}
PRIORITIES = ["high", "medium", "low"]


def _insight(kind: str, type: str, category: str, priority: str, subject: Column, value: Column, points: int) -> list[Column]:
    return [
        F.lit(kind).alias("insight"), F.lit(type).alias("type"), F.lit(category).alias("category"), F.lit(priority).alias("priority"),
        subject.cast("string").alias("subject"), value.cast("double").alias("value"), F.lit(points).alias("points"),
    ]


def insights(claims: DataFrame, as_of: dt.date) -> DataFrame:
    """Findings worth acting on, by priority.

    Facts are read once: summed by month, service and code, which leaves few rows; each of those is then dealt to
    the rules, and the rules work on sums.
    """
    c, none = F.col, F.lit(None).cast("string")
    bad, recent = is_error(), F.coalesce(F.col("dateadm") >= F.add_months(F.lit(as_of), -3), F.lit(False))
    named = F.when(c("service_type") != "", c("service_type"))
    small = claims.groupBy(fiscal.ym("dateadm").alias("month"), named.alias("service"), F.when(bad & recent, c("error_code")).alias("code")).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(bad & recent).alias("fresh"),
        F.sum(F.when(recent, zero("claim_drg"))).alias("claimed"), F.sum(F.when(recent, zero("paid"))).alias("paid"), F.count_if(is_aged_unpaid(60, as_of, only_clean=True)).alias("waiting"),
    )

    def sums(rule: str, key: Column, n: Column | str, bad: Column | str, x: str = "claimed") -> Column:
        return F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.col(n).alias("n"), F.col(bad).alias("bad"), F.col(x).alias("claimed"), F.col("paid").alias("paid"))

    dealt = F.array(sums("month", c("month"), "n", "bad"), sums("service", c("service"), "n", "bad"), sums("paid", none, "n", "bad"), sums("code", c("code"), "fresh", "bad"), sums("pending", none, "waiting", "bad"))
    by_rule = small.select(F.inline(dealt)).where(c("key").isNotNull() | c("rule").isin("paid", "pending"))
    by_rule = by_rule.groupBy("rule", "key").agg(*[F.sum(x).alias(x) for x in ("n", "bad", "claimed", "paid")])
    rate = ratio_or_null(c("bad"), c("n"))
    by_rule = by_rule.withColumn("rate", rate).where((c("rule") != "service") | ((c("n") >= 20) & (c("rate") > 15)))
    # Months, services and codes: a few rows for each rule.
    first = Window.partitionBy("rule").orderBy(F.when(c("rule") == "month", c("key")).desc(), F.when(c("rule") == "service", c("rate")).desc(), F.when(c("rule") == "code", c("n")).desc(), "key")
    ranked = by_rule.withColumns({"place": F.row_number().over(first), "previous": F.lead("rate").over(first)})
    share = c("paid").cast("double") / c("claimed").cast("double") * 100

    def found(hit: Column, *finding) -> Column:
        names = ("insight", "type", "category", "priority", "subject", "value", "points")
        return F.when(hit, F.struct(*[x.alias(n) for n, x in zip(names, _insight(*finding), strict=True)]))

    is_ = lambda rule: c("rule") == rule
    latest_month = is_("month") & (c("place") == 1)
    findings = F.array(
        found(latest_month & (c("rate") > c("previous") * 1.2), "denial_up", "warning", "Denial Rate", "high", c("key"), c("rate"), POINTS["denial_up"]),
        found(latest_month & (c("rate") < c("previous") * 0.8), "denial_down", "success", "Denial Rate", "low", c("key"), c("rate"), 0),
        found(is_("service") & (c("place") <= 3), "service", "warning", "Service Type", "medium", c("key"), c("rate"), POINTS["service"]),
        found(is_("paid") & (c("claimed") > 0) & (share < 85), "paid_low", "warning", "Reimbursement", "high", none, F.round(share, 2), POINTS["paid_low"]),
        found(is_("paid") & (c("claimed") > 0) & (share >= 95), "paid_high", "success", "Reimbursement", "low", none, F.round(share, 2), 0),
        found(is_("code") & (c("place") == 1) & (c("n") > 0), "top_error", "info", "Error Analysis", "medium", c("key"), c("n"), POINTS["top_error"]),
        found(is_("pending") & (c("n") > 10), "pending", "warning", "Pending Claims", "medium", none, c("n"), POINTS["pending"]),
    )
    out = ranked.select(F.explode(findings).alias("f")).where("f IS NOT NULL").select("f.*")
    return order_rank(out, "priority", PRIORITIES, F.col("insight"), F.col("subject"))


def insight_score(insights: DataFrame) -> DataFrame:
    points = total("points")
    health = F.when(F.col("points") >= 60, "critical").when(F.col("points") >= 30, "warning").otherwise("good")
    out = insights.agg(F.count("*").alias("total_insights"), points.cast("bigint").alias("points"))
    return out.select("total_insights", F.least(F.lit(100), F.col("points")).cast("int").alias("priority_score"), health.alias("health_status"))


def inbox(notices: DataFrame, severity: str | None = None, kind: str | None = None, unread_only: bool = False, *, k: int) -> DataFrame:
    """Open notices, newest first."""
    rows = notices.filter(~F.col("is_dismissed"))
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if kind:
        rows = rows.filter(F.col("alert_type") == kind)
    if unread_only:
        rows = rows.filter(~F.col("is_read"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def unread(notices: DataFrame) -> DataFrame:
    open_ = notices.filter(~F.col("is_dismissed") & ~F.col("is_read"))
    return open_.groupBy("severity").agg(F.count("*").alias("unread"))
