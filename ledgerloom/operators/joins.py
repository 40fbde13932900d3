"""Joins between feeds.

Statuses are settled by joins that AQE can split when one claim id is hot.  Spark splits both sides of
an inner join, the left side of a left or anti join, and no side of a full outer join; and it splits a
side only where a shuffle made for the join stands directly under it.  So :func:`full_match` and
:func:`left_match` are an inner join plus the rows that found nothing, and sides with one row per key
come from :func:`one_per_key`, which leaves the join a shuffle of its own.  A blank key is no key.
Where only sums per key are needed no join is used at all: both feeds are tagged, stacked and
aggregated once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_error, zero
from ..functions.text import strip0
from .filters import date_range


def keyed(key: str) -> Column:
    """Whether a row has a key: neither null nor blank.

    Says so of null by itself, as an inner join would: the scans below an inner and an anti join are then alike and
    share an exchange.
    """
    return F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")


def one_per_key(df: DataFrame, keys: str | Sequence[str], *aggs: Column) -> DataFrame:
    """One row per key, hashed by more than the key.

    A join on the key then shuffles it again, one row per key, and AQE can split a hot key on the other
    side; grouped by the key alone, the rows would stay where the aggregate left them and nothing could be
    split.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    grouped = df.groupBy(*keys, F.hash(*keys).alias("_apart"))
    return grouped.agg(*aggs).drop("_apart") if aggs else grouped.agg(F.lit(True).alias("_one")).select(*keys)


def _left_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    found = left.join(right, key)
    return found.unionByName(left.join(one_per_key(right, key), key, "left_anti"), allowMissingColumns=True)


def _full_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of rows that all have a key: each side is shuffled once and read by both its joins."""
    alone = right.join(one_per_key(left, key), key, "left_anti")
    return _left_match(left, right, key).unionByName(alone, allowMissingColumns=True)


def left_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left equi join on ``key`` that tolerates a key that is hot on either side."""
    found = _left_match(left.filter(keyed(key)), right.filter(keyed(key)), key)
    return found.unionByName(left.filter(~keyed(key)), allowMissingColumns=True)


def full_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer equi join on ``key`` that tolerates a key that is hot on either side.

    ``right`` must not reuse a column name of ``left`` other than ``key``.
    """
    found = _full_match(left.filter(keyed(key)), right.filter(keyed(key)), key)
    keyless = left.filter(~keyed(key)).unionByName(right.filter(~keyed(key)), allowMissingColumns=True)
    return found.unionByName(keyless, allowMissingColumns=True)


def _status(diff: Column, has_left: Column, has_right: Column, tol: float) -> Column:
    return (
        F.when(~has_right, "rep_only")
        .when(~has_left, "stm_only")
        .when(F.abs(diff) < F.lit(tol).cast("decimal(10,4)"), "matched")
        .otherwise("diff_amount")
    )


def reconcile(
    claims: DataFrame,
    stm: DataFrame,
    key: str = "tran_id",
    tol: float = 0.01,
    date_from: str | None = None,
    date_to: str | None = None,
    has_error: bool = False,
) -> DataFrame:
    """Claims against statements, one row per pair or unmatched row.

    ``diff`` is what was claimed less what was paid; an amount that is missing, or whose side is, counts as 0.
    Date and error filters apply to each side before the join, as they cannot be pushed through it.
    Rows whose key is null or blank never match and are left out.
    """
    rep = date_range(claims.filter(keyed(key)), date_from, date_to, "dateadm")
    if has_error:
        rep = rep.filter(is_error())
    pay = date_range(stm.filter(keyed(key)), date_from, date_to, "date_admit")
    has = set(claims.columns) & set(stm.columns)
    extra = [c for c in ("rep_no", "hn") if c in has and c != key]
    left = rep.select(
        key, F.lit(True).alias("in_rep"), zero("reimb_nhso").alias("rep_amount"), "dateadm", "error_code",
        *[F.col(c).alias(f"rep_{c}") for c in extra],
    )
    right = pay.select(
        key, F.lit(True).alias("in_stm"), zero("paid_after_deduction").alias("stm_amount"), "date_admit",
        *[F.col(c).alias(f"stm_{c}") for c in extra],
    )
    both = _full_match(left, right, key)
    diff = zero("rep_amount") - zero("stm_amount")
    return both.select(
        key,
        *[F.coalesce(F.col(f"rep_{c}"), F.col(f"stm_{c}")).alias(c + "_" if c == "rep_no" else c) for c in extra],
        F.coalesce("dateadm", "date_admit").alias("service_date"),
        "error_code", zero("rep_amount").alias("rep_amount"), zero("stm_amount").alias("stm_amount"), diff.alias("diff"),
        _status(diff, F.col("in_rep").isNotNull(), F.col("in_stm").isNotNull(), tol).alias("status"),
    ).withColumnsRenamed({"rep_no_": "rep_no"})


def reconcile_batches(
    claims: DataFrame,
    stm: DataFrame,
    key: str = "rep_no",
    tol: float = 0.01,
    date_from: str | None = None,
    date_to: str | None = None,
    has_error: bool = False,
) -> DataFrame:
    """The same per batch: both feeds stacked and summed in one aggregate, no join."""
    rep = date_range(claims.filter(F.col(key).isNotNull()), date_from, date_to, "dateadm")
    if has_error:
        rep = rep.filter(is_error())
    pay = date_range(stm.filter(F.col(key).isNotNull()), date_from, date_to, "date_admit")
    nothing = F.lit(None).cast("decimal(15,2)")
    stacked = rep.select(
        key, F.lit(1).alias("r"), F.lit(0).alias("s"), F.col("reimb_nhso").cast("decimal(15,2)").alias("rep"), nothing.alias("stm")
    ).unionByName(
        pay.select(key, F.lit(0).alias("r"), F.lit(1).alias("s"), nothing.alias("rep"), F.col("paid_after_deduction").alias("stm"))
    )
    both = stacked.groupBy(key).agg(
        F.sum("r").alias("rep_count"), F.sum("s").alias("stm_count"),
        F.coalesce(F.sum("rep"), F.lit(0)).alias("rep_amount"), F.coalesce(F.sum("stm"), F.lit(0)).alias("stm_amount"),
    )
    diff = F.col("rep_amount") - F.col("stm_amount")
    return both.withColumn("diff", diff).withColumn(
        "status", _status(diff, F.col("rep_count") > 0, F.col("stm_count") > 0, tol)
    )


def keep_matches(df: DataFrame, key: str, term: str | None = None, status: str | None = None, min_diff: float = 0) -> DataFrame:
    """Filters on the joined rows: text on the key, status, size of the difference."""
    if term:
        df = df.filter(F.contains(F.lower(F.col(key)), F.lit(term.lower())))
    if status:
        df = df.filter(F.col("status") == status)
    if min_diff:
        df = df.filter(F.abs("diff") >= F.lit(min_diff).cast("decimal(12,2)"))
    return df


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "rep_only", "stm_only", "diff_amount")],
    )


def batch_records(claims: DataFrame, stm: DataFrame, tol: float = 1) -> DataFrame:
    """Claim batches with the statement sum of the same batch; batches only in statements are left out."""
    both = reconcile_batches(claims, stm, tol=tol).filter(F.col("rep_count") > 0)
    return both.select(
        "rep_no", F.col("rep_count").alias("count"), "rep_amount",
        F.when(F.col("stm_count") > 0, F.col("stm_amount")).alias("stm_amount"), "status",
    )


def claim_records(claims: DataFrame, stm: DataFrame, tol: float = 1) -> DataFrame:
    """Claims with one statement amount each (the smallest if a claim was paid in parts)."""
    first = one_per_key(stm.filter(keyed("tran_id")), "tran_id", F.min(zero("paid_after_deduction")).alias("stm_amount"))
    rows = claims.join(first.withColumn("found", F.lit(True)), "tran_id", "left")
    rep = zero("reimb_nhso")
    status = F.when(F.col("found").isNull(), "rep_only").when(F.abs(rep - zero("stm_amount")) < tol, "matched").otherwise("diff_amount")
    return rows.select("tran_id", "rep_no", "hn", rep.alias("rep_amount"), "stm_amount", status.alias("status"))


def exists_counts(claims: DataFrame, stm: DataFrame, tol: float = 1) -> DataFrame:
    """How many claims have a statement within ``tol`` and how many have one beyond it.

    The lowest and highest amount of a claim's statements settle most claims.  Where they differ, the
    amounts are reduced to the lowest and highest per step of ``tol``: in the claim's own step any
    amount is near, in the step below only the highest can be, in the step above only the lowest.
    So a claim meets at most three rows, however many statements it has.
    """
    step = F.lit(tol).cast("decimal(10,4)")
    rep = claims.groupBy("tran_id", zero("reimb_nhso").alias("rep")).agg(F.count("*").alias("n"))
    pay = stm.filter(F.col("tran_id").isNotNull()).withColumn("pay", zero("paid_after_deduction"))
    ends = one_per_key(pay, "tran_id", F.min("pay").alias("first"), F.max("pay").alias("last"))
    c = F.col
    each = rep.join(ends, "tran_id", "left")
    far = (c("rep") - c("first") >= step) | (c("last") - c("rep") >= step)

    def counts(df: DataFrame, near: Column) -> DataFrame:
        def of(cond: Column) -> Column:
            return F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))

        return df.agg(of(F.lit(True)).alias("total"), of(near).alias("matched"), of(far).alias("diff_amount"))

    alone = c("first").isNull() | (c("first") == c("last"))
    settled = counts(each.filter(alone), F.abs(c("rep") - c("first")) < step)

    home = F.floor(c("rep") / step).cast("bigint")
    stepped = pay.withColumn("step", F.floor(c("pay") / step).cast("bigint"))
    span = one_per_key(stepped, ["tran_id", "step"], F.min("pay").alias("lo"), F.max("pay").alias("hi"))
    tries = each.filter(~alone).withColumn("step", F.explode(F.sequence(home - 1, home + 1))).join(span, ["tran_id", "step"], "left")
    close = F.when(c("step") < home, c("rep") - c("hi") < step).when(c("step") > home, c("lo") - c("rep") < step).otherwise(c("lo").isNotNull())
    open_ = tries.groupBy("tran_id", "rep", "n", "first", "last").agg(F.bool_or(F.coalesce(close, F.lit(False))).alias("near"))
    both = settled.unionByName(counts(open_, c("near")))
    out = both.agg(*[F.sum(k).alias(k) for k in ("total", "matched", "diff_amount")])
    return out.withColumn("rep_only", c("total") - c("matched") - c("diff_amount"))


def statement_view(stm: DataFrame, claims: DataFrame, files: DataFrame, tol: float = 1) -> DataFrame:
    """Statement rows (normal and appeal) with their claim, their file and a status."""
    rep = claims.select(
        "tran_id", F.lit(True).alias("in_rep"), F.col("rep_no").alias("rep_repno"), F.col("claim_net").alias("rep_claim_net"),
        F.col("paid").alias("rep_paid"), F.col("reimb_nhso").alias("rep_reimb_nhso"),
    )
    held = files.select("file_id", "document_no", "scheme", "file_type", "statement_month", "statement_year")
    rows = left_match(stm.filter(F.col("data_type").isin("normal", "appeal")).drop("rep_no"), rep, "tran_id").join(held, "file_id", "left")
    diff = zero("total_compensation") - zero("rep_paid")
    status = (
        F.when(F.col("in_rep").isNull(), "missing_rep")
        .when(F.col("total_compensation").isNull(), "missing_stm")
        .when(F.abs(diff) < tol, "matched")
        .otherwise("amount_diff")
    )
    return rows.select(
        "tran_id", "hn", "an", "date_admit", F.col("amount_claimed").alias("stm_claimed"),
        F.col("total_compensation").alias("stm_compensation"), "rep_repno", "rep_claim_net", "rep_paid", "rep_reimb_nhso",
        "document_no", "scheme", "file_type", "statement_month", "statement_year",
        status.alias("reconcile_status"), diff.alias("amount_difference"),
    )


def statement_batches(view: DataFrame) -> DataFrame:
    status = F.col("reconcile_status")
    return view.groupBy(F.col("rep_repno").alias("rep_no")).agg(
        F.count("*").alias("count"), F.sum("stm_compensation").alias("stm_amount"), F.sum("rep_reimb_nhso").alias("rep_amount"),
        F.when(F.bool_and(status == "matched"), "matched")
        .when(F.bool_or(status == "amount_diff"), "diff_amount")
        .otherwise("stm_only")
        .alias("status"),
    )


def statement_counts(view: DataFrame) -> DataFrame:
    """Totals by status; rows whose claim is missing count as ``stm_only``."""
    status = F.col("reconcile_status")
    return view.agg(
        F.count("*").alias("total"), F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "amount_diff").alias("diff_amount"), F.count_if(status == "missing_rep").alias("stm_only"),
    )


def persist_match(stm: DataFrame, latest_claims: DataFrame, tol: float = 1, file_id: int | None = None) -> DataFrame:
    """Statement rows with their match written on them.  ``latest_claims`` has one row per claim."""
    rows = stm if file_id is None else stm.filter(F.col("file_id") == file_id)
    rep = one_per_key(latest_claims.filter(keyed("tran_id")), "tran_id", F.first("paid").alias("_paid")).withColumn("_in", F.lit(True))
    diff = zero("total_compensation") - zero("_paid")
    return (
        rows.join(rep, "tran_id", "left")
        .withColumns(
            {
                "rep_matched": F.col("_in").isNotNull(),
                "reconcile_status": F.when(F.col("_in").isNull(), "missing_rep").when(F.abs(diff) < tol, "matched").otherwise("amount_diff"),
                "reconcile_diff": diff,
            }
        )
        .drop("_in", "_paid")
    )


def match_totals(matched: DataFrame) -> DataFrame:
    return matched.groupBy("reconcile_status").agg(F.count("*").alias("count"), F.sum(F.abs("reconcile_diff")).alias("total_diff"))


def apply_matches(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Write visit numbers from outside onto claims; ``matches`` is (tran_id, his_vn), one per claim."""
    found = one_per_key(matches.filter(keyed("tran_id")), "tran_id", F.max("his_vn").alias("_vn"))
    rows = claims.join(found, "tran_id", "left")
    hit = F.col("_vn").isNotNull()
    return rows.withColumns(
        {
            "his_vn": F.when(hit, F.col("_vn")).otherwise(F.col("his_vn")),
            "his_matched": F.when(hit, F.lit(True)).otherwise(F.col("his_matched")),
        }
    ).drop("_vn")


def failed_matches(claims: DataFrame, matches: DataFrame) -> DataFrame:
    return matches.join(one_per_key(claims.filter(keyed("tran_id")), "tran_id"), "tran_id", "left_anti")


def enrich(df: DataFrame, dim: DataFrame, left: str, right: str) -> DataFrame:
    """Left lookup in a dimension.  AQE broadcasts the dimension when its measured size allows."""
    return df.join(dim, F.col(left) == F.col(right), "left")


def by_either_code(df: DataFrame, dim: DataFrame, code: str, dim_key: str, how: str = "left") -> DataFrame:
    """Join where the dimension key equals the code or the code without leading zeros.

    The candidates are exploded on the distinct codes only, so the join is on equality and the fact
    rows are joined once by their own code.
    """
    codes = df.select(F.col(code).alias("_code")).distinct()
    tries = codes.withColumn("_try", F.explode(F.array_distinct(F.array(F.col("_code"), strip0("_code")))))
    found = tries.join(dim, F.col("_try") == F.col(dim_key)).drop("_try").distinct()
    return df.join(found, F.col(code) == F.col("_code"), how).drop("_code")


def prefix_join(df: DataFrame, dim: DataFrame, col: str, code: str) -> DataFrame:
    """Rows whose ``col`` starts with the dimension's code.

    Each row is tried at every code length the dimension has (a handful), as an equality join.
    """
    lengths = dim.agg(F.collect_set(F.length(code)).alias("_lens")).select("_lens").scalar()
    tries = df.withColumn("_lens", lengths).withColumn("_len", F.explode("_lens")).filter(F.length(col) >= F.col("_len"))
    tries = tries.withColumn("_key", F.col(col).substr(F.lit(1), F.col("_len")))
    return tries.join(dim, F.col("_key") == F.col(code)).drop("_lens", "_len", "_key")


def waterfall_match(claims: DataFrame, visits: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Claims to visits in three passes: hn + date, then admission number, then pid -> hn + date.

    Each right side has one row per key, so the passes never multiply claims; the first pass that
    finds a visit wins and is recorded.  Claims without a key, which would all hash to one task, get
    one that is spread over the tasks and that no right side has.
    """

    def spread(key: str) -> Column:
        return F.when(keyed(key), F.col(key)).otherwise(F.concat(F.lit("\0"), F.xxhash64("tran_id", "hn", "pid").cast("string")))

    by_day = one_per_key(visits.filter(keyed("hn")), ["hn", "visit_date"], F.min("vn").alias("vn"))
    by_an = one_per_key(admissions.filter(keyed("an")), "an", F.min("vn").alias("vn_an"))
    hn_of = one_per_key(patients.filter(keyed("pid")), "pid", F.min("hn").alias("hn_pid"))
    day = F.col("dateadm").cast("date")
    one = by_day.select(F.col("hn").alias("_h1"), F.col("visit_date").alias("_d1"), F.col("vn").alias("vn_day"))
    three = by_day.select(F.col("hn").alias("_h3"), F.col("visit_date").alias("_d3"), F.col("vn").alias("vn_pid"))
    rows = (
        claims.join(one, (spread("hn") == F.col("_h1")) & (day == F.col("_d1")), "left")
        .join(by_an.withColumnRenamed("an", "_an"), spread("an") == F.col("_an"), "left")
        .join(hn_of.withColumnRenamed("pid", "_pid"), spread("pid") == F.col("_pid"), "left")
        .join(three, (spread("hn_pid") == F.col("_h3")) & (day == F.col("_d3")), "left")
    )
    how = F.when(F.col("vn_day").isNotNull(), "hn_date").when(F.col("vn_an").isNotNull(), "an").when(F.col("vn_pid").isNotNull(), "pid_date")
    return rows.withColumns({"vn": F.coalesce("vn_day", "vn_an", "vn_pid"), "match_pass": how}).drop(
        "_h1", "_d1", "vn_day", "_an", "vn_an", "_pid", "hn_pid", "_h3", "_d3", "vn_pid"
    )


def flag_amounts(claims: DataFrame, billing: DataFrame, tol: int = 100) -> DataFrame:
    """Difference against billing (one row per claim); larger than ``tol`` needs review."""
    rows = claims.join(billing.select("tran_id", "billed"), "tran_id", "left")
    diff = F.col("claim_drg") - F.col("billed")
    status = F.when(F.col("billed").isNull(), "unbilled").when(F.abs(diff) > tol, "review").otherwise("ok")
    return rows.withColumns({"amount_diff": diff, "amount_status": status})


def orphans(files: DataFrame, ledger: DataFrame, key: str = "filename") -> DataFrame:
    """Files without a ledger row and ledger rows without a file."""
    a, b = files.select(key), ledger.select(key)
    return (
        a.join(b, key, "left_anti").withColumn("problem", F.lit("not_in_ledger"))
        .unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("file_missing")))
    )


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column some frames lack is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, keep_copies: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_copies else a.subtract(b)


def present_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")
