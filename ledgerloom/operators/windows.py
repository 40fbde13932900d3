"""Latest-per-key, shares, ranks, trailing counts and forward fill.

None of these puts all rows of one key into one task: ``latest`` is cut to one row per key before
its shuffle, and the ordered operators work on bounded blocks of a key and carry totals between
blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import is_error, ratio, ratio_or_null


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The ``row_number() = 1`` filter is pushed into the window as a group limit, so every map task
    sends at most one row per key whatever the key's size.  Rows are dealt out by more than the key, so
    that a join on the key shuffles the one row per key again and can split a key that is hot on its
    other side.
    """
    w = Window.partitionBy(*keys, F.hash(*keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def share(grouped: DataFrame, count: str = "count", out: str = "percentage", dp: int = 2) -> DataFrame:
    """Add each group's share of all groups.  Take it before any limit."""
    whole = grouped.agg(F.sum(count)).scalar()
    return grouped.withColumn(out, ratio_or_null(F.col(count), whole, dp))


def standing(totals: DataFrame, value: str, mine: Column) -> DataFrame:
    """Rank of one value among all: one more than the number above it, with a percentile."""
    above = F.count_if(F.col(value) > mine)
    out = totals.agg(F.count("*").alias("total"), (above + 1).alias("rank"))
    rest = (1 - F.col("rank").cast("double") / F.col("total").cast("double")) * 100
    return out.select(
        "rank", "total", F.when(F.col("total") > 0, rest.cast("bigint")).otherwise(F.lit(0)).alias("percentile")
    )


def change_between_months(monthly: DataFrame, month: str, value: str, keep: int = 2) -> DataFrame:
    """Latest month against the one before it, percent.  ``monthly`` has one row per month."""
    recent = monthly.orderBy(F.desc(month)).limit(keep)
    w = Window.orderBy(month)  # at most ``keep`` rows
    prev = F.lag(value).over(w)
    return (
        recent.withColumn("previous", prev)
        .orderBy(F.desc(month))
        .limit(1)
        .select(
            F.col(month),
            F.col(value).alias("current"),
            "previous",
            F.when(F.col("previous") > 0, ratio(F.col(value).cast("double") - F.col("previous").cast("double"), F.col("previous"))).alias("change_pct"),
        )
    )


def trailing_count(df: DataFrame, by: str, ts: str, seconds: int, out: str = "n_recent") -> DataFrame:
    """For each row, how many rows of the same key fall in ``(ts - seconds, ts]``, peers included.

    Every row adds one at its time and takes it back ``seconds`` later, so the answer is a running
    sum, which costs one pass where a sliding frame would recount itself at every row.  Rows of one
    key and moment are first added up, map-side, so what is put in order is moments and not rows,
    however hard a key is hit.  The sum is taken inside blocks of ``seconds`` and the total of the
    earlier blocks is joined on, so a busy key is spread over as many tasks as it has blocks.  The
    answers are joined to the rows by key and moment.  A null key has no peers and counts 0.
    """
    width = seconds * 1_000_000
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    known = rows.filter(F.col(by).isNotNull() & F.col("_us").isNotNull())
    moments = known.groupBy(by, "_us").agg(F.count("*").alias("_d"))
    steps = moments.unionByName(moments.select(by, (F.col("_us") + width).alias("_us"), (-F.col("_d")).alias("_d")))
    steps = steps.groupBy(by, "_us").agg(F.sum("_d").alias("_d")).withColumn("_b", F.floor(F.col("_us") / width))
    earlier = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.groupBy(by, "_b").agg(F.sum("_d").alias("_t")).withColumn("_carry", F.sum("_t").over(earlier)).drop("_t")
    upto = Window.partitionBy(by, "_b").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    n = F.sum("_d").over(upto) + F.coalesce("_carry", F.lit(0))
    counted = steps.join(carry, [by, "_b"], "left").select(F.col(by).alias("_by"), F.col("_us").alias("_at"), n.cast("bigint").alias("_n"))
    # A row without key or time is spread by itself and finds nothing.
    moment = F.coalesce(F.when(F.col(by).isNotNull(), F.col("_us")), F.xxhash64(*df.columns))
    joined = rows.join(counted, (F.col(by) == F.col("_by")) & (moment == F.col("_at")), "left")
    return joined.select(*df.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias(out))


def gap_sessions(df: DataFrame, by: str, ts: str, gap: int) -> DataFrame:
    """Sessions per key: a row within ``gap`` seconds of the one before it continues the session.

    Rows of one key in the same ``gap``-wide block always share a session, so each block is first
    reduced to its first and last time and its count.  Only blocks, whose number depends on the
    time covered and not on the rows, are put in order per key.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width = gap * 1_000_000
    blocks = df.withColumn("_us", us).groupBy(by, F.floor(F.col("_us") / width).alias("_b")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.min("_us").alias("_a"), F.max("_us").alias("_z"), F.count("*").alias("_n")
    )
    w = Window.partitionBy(by).orderBy("_b")
    opens = F.coalesce((F.col("_a") - F.lag("_z").over(w) >= width).cast("int"), F.lit(1))
    runs = blocks.withColumn("_open", opens).withColumn("_run", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "_run").agg(
        F.min("_first").alias("session_start"), (F.max("_last") + F.expr(f"INTERVAL '{gap}' SECOND")).alias("session_end"), F.sum("_n").alias("events")
    ).drop("_run")


def fill_down(df: DataFrame, by: str, order: str, value: Column, out: str, default: str | None = None, block: int = 50_000) -> DataFrame:
    """Carry the last non-null ``value`` down the rows of each ``by`` in integer ``order``.

    Done in blocks of ``block`` positions: each block's last value is aggregated map-side, carried
    over the (few) blocks of a key, and joined back, so one very long file is not one task.
    """
    rows = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block).cast("bigint"))
    blocks = rows.groupBy(by, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    inside = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry"), F.lit(default))
    return rows.join(carried, [by, "_b"], "left").withColumn(out, filled).drop("_v", "_b", "_carry")


def compare_with_group(df: DataFrame, group: Column, value: str, out: str = "group_avg") -> DataFrame:
    """Each row beside its group's mean.

    The means are aggregated first and joined back (AQE broadcasts them if they turn out small), so
    a group that holds most rows is never sorted in one task as a window would.
    """
    rows = df.withColumn("_g", group)
    means = rows.groupBy("_g").agg((F.sum(value).cast("double") / F.count(value).cast("double")).alias(out))
    return rows.join(means, "_g").withColumnRenamed("_g", "group_key")


def prefer(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """One row per key with the smallest rank."""
    return latest(df, keys, [rank.asc()])


def error_rates(df: DataFrame, group: Column, name: str, min_rows: int = 1) -> DataFrame:
    """Claims, errors, error rate and risk level per group with at least ``min_rows`` claims."""
    rate = ratio_or_null(F.count_if(is_error()), F.count("*"))
    out = df.groupBy(group.alias(name)).agg(
        F.count("*").alias("total_claims"), F.count_if(is_error()).alias("error_claims"), rate.alias("error_rate")
    )
    level = F.when(F.col("error_rate") > 10, "high").when(F.col("error_rate") > 5, "medium").otherwise("low")
    return out.filter(F.col("total_claims") >= min_rows).withColumn("risk_level", level)
