"""Files, downloads, jobs, transfers and directories: what was loaded and whether it is enough."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import human_size, mean, total
from ..functions.text import claim_file_parts, posting_key, prefix
from ..operators.pages import Cursor, keyset_page
from ..operators.windows import latest
from .reports import topk


def transfer_summary(smt: DataFrame) -> DataFrame:
    """Totals overall, by fund, by fund group and by month.

    Rows are summed once per (fund, group, month); the four levels are rolled up from those sums.
    """
    month = prefix(posting_key("posting_date"), 6).alias("month_be")
    sums = ("total_amount", "wait_amount", "debt_amount")
    cells = smt.groupBy("fund_name", "fund_group_desc", month).agg(F.count("*").alias("records"), *[total(c).alias(c) for c in sums])
    keys = [F.col("fund_name"), F.col("fund_group_desc"), F.col("month_be")]
    out = cells.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys).agg(
        F.grouping_id().alias("gid"), F.sum("records").alias("records"), *[total(c).alias(c) for c in sums]
    )
    out = out.withColumn("records", F.coalesce("records", F.lit(0)))
    # A bit is 1 where the column is rolled up: 011 fund, 101 group, 110 month, 111 all.
    level = F.when(F.col("gid") == 3, "fund").when(F.col("gid") == 5, "group").when(F.col("gid") == 6, "month").otherwise("total")
    return out.select(level.alias("level"), F.coalesce(*keys).alias("key"), "records", "total_amount", "wait_amount", "debt_amount")


def top_groups(smt: DataFrame, k: int = 10) -> DataFrame:
    out = smt.groupBy("fund_group_desc").agg(F.count("*").alias("records"), total("total_amount").alias("total_amount"))
    return topk(out, "total_amount", k, "fund_group_desc")


def imports_status(ledger: DataFrame, stm_files: DataFrame) -> DataFrame:
    """Files, imported, failed and the last import per feed and type."""

    def one(feed: str, df: DataFrame) -> DataFrame:
        s = F.col("status")
        return df.groupBy(F.lit(feed).alias("feed"), "file_type").agg(
            F.count("*").alias("files"), F.count_if(s == "completed").alias("imported"), F.count_if(s == "failed").alias("failed"),
            F.sum("total_records").alias("records"),
        )

    return one("rep", ledger).unionByName(one("stm", stm_files))


def file_type_stats(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files by the type in their name, with import state and size."""
    done = ledger.select("filename", F.col("status"))
    rows = files.withColumns({"type": claim_file_parts("filename")["file_type"]}).filter(F.col("type").isNotNull())
    ok = F.coalesce(F.col("status") == "completed", F.lit(False))
    out = rows.join(done, "filename", "left").groupBy("type").agg(
        F.count("*").alias("count"), F.count_if(ok).alias("imported"), F.count_if(~ok).alias("pending"), F.sum("size").alias("size")
    )
    return out.withColumn("size_formatted", human_size("size"))


def file_status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each file with whether it is imported, by its own flag or by the ledger."""
    state = ledger.select("filename", F.col("status").alias("import_status"))
    rows = files.join(state, "filename", "left")
    done = F.coalesce(F.col("imported"), F.lit(False)) | F.coalesce(F.col("import_status") == "completed", F.lit(False))
    return rows.withColumn("is_imported", done)


def download_stats(downloads: DataFrame) -> DataFrame:
    s = F.col("download_status")
    return downloads.groupBy("download_type").agg(
        F.count("*").alias("total"), F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "pending").alias("pending"), F.count_if("imported").alias("imported"), F.sum("file_size").alias("bytes"),
        F.max("downloaded_at").alias("last_download"),
    )


def downloads_by_month(downloads: DataFrame) -> DataFrame:
    return downloads.groupBy("download_type", "fiscal_year", "service_month").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def downloads_by_scheme(downloads: DataFrame) -> DataFrame:
    return downloads.groupBy("download_type", "scheme").agg(F.count("*").alias("files"), F.count_if("imported").alias("imported"))


def failed_downloads(downloads: DataFrame) -> DataFrame:
    rows = downloads.filter(F.col("download_status") == "failed")
    return rows.select("download_type", "filename", "error_message", "retry_count", "downloaded_at")


def freshness(downloads: DataFrame, as_of: dt.date) -> DataFrame:
    """Latest year and month per type and scheme, and whether that is the current month.

    The latest pair is a maximum of a struct, so one aggregate answers everything.
    """
    at = F.struct(F.col("fiscal_year").alias("y"), F.col("service_month").alias("m"))
    out = downloads.filter("file_exists").groupBy("download_type", "scheme").agg(
        F.count("*").alias("file_count"), F.max("downloaded_at").alias("last_download"), F.max(at).alias("at")
    )
    now = (F.col("at.y") == as_of.year + 543) & (F.col("at.m") == as_of.month)
    return out.select(
        "download_type", "scheme", "file_count", "last_download", F.col("at.y").alias("latest_year"), F.col("at.m").alias("latest_month"), now.alias("is_current")
    )


def with_duration(jobs: DataFrame) -> DataFrame:
    secs = F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return jobs.withColumn("duration_seconds", secs)


def job_stats(jobs: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    since = F.lit(as_of - dt.timedelta(days=days))
    rows = with_duration(jobs).filter(F.col("started_at") >= since)
    return rows.groupBy("job_type", "status").agg(F.count("*").alias("jobs"), F.round(mean("duration_seconds"), 2).alias("avg_duration"))


def office_stats(offices: DataFrame, provinces: int = 10) -> DataFrame:
    """Facilities by status, level and region, and the largest provinces."""
    keys = [F.col(c) for c in ("status", "hospital_level", "health_region", "province")]
    cells = offices.groupBy(*keys).agg(F.count("*").alias("n"))
    n = cells.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("gid"), F.sum("n").alias("count"))
    # A bit is 1 where the column is rolled up, first column highest.
    which = F.when(F.col("gid") == 7, "status").when(F.col("gid") == 11, "level").when(F.col("gid") == 13, "region").otherwise("province")
    flat = n.select(which.alias("facet"), F.coalesce(*keys).alias("value"), "count")
    return flat.filter("facet <> 'province'").unionByName(topk(flat.filter("facet = 'province'"), "count", provinces, "value"))


def seed_status(tables: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """Row counts against the minimum each table needs."""
    out = None
    for name, (df, need) in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.lit(need).cast("bigint").alias("minimum"))
        out = one if out is None else out.unionByName(one)
    state = F.when(F.col("rows") == 0, "empty").when(F.col("rows") < F.col("minimum"), "partial").otherwise("ok")
    return out.withColumn("state", state)


def completed_files(ledger: DataFrame, k: int) -> DataFrame:
    rows = ledger.filter(F.col("status") == "completed")
    return rows.orderBy(F.desc("file_date"), F.desc("file_id")).limit(k)


def transfer_runs(smt: DataFrame, k: int) -> DataFrame:
    """Transfers by run date, newest first: the nearest thing a transfer has to a file."""
    out = smt.groupBy("run_date").agg(F.count("*").alias("records"), total("total_amount").alias("total_amount"))
    return out.orderBy(F.desc("run_date")).limit(k)


def file_items(rows: DataFrame, file_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    return rows.filter(F.col("file_id") == file_id).orderBy("tran_id").offset(offset).limit(limit)


def file_items_after(rows: DataFrame, file_id: int, limit: int = 100, cursor: Cursor | None = None) -> DataFrame:
    """The items of a file after a cursor, whatever has been shown before."""
    return keyset_page(rows.filter(F.col("file_id") == file_id), [("tran_id", False)], limit, cursor)


def transfers_after(smt: DataFrame, k: int = 50, cursor: Cursor | None = None) -> DataFrame:
    """Transfers by posting date, newest first, after a cursor."""
    keyed = smt.withColumn("posting_key", posting_key("posting_date"))
    return keyset_page(keyed, [("posting_key", True), ("ref_doc_no", False), ("vendor_no", False), ("total_amount", False)], k, cursor)


def sorted_transfers(smt: DataFrame, k: int = 50, offset: int = 0) -> DataFrame:
    """Transfers by posting date whatever its text form, newest first."""
    keyed = smt.withColumn("posting_key", posting_key("posting_date"))
    return keyed.orderBy(F.desc("posting_key"), "ref_doc_no", "vendor_no", "total_amount").offset(offset).limit(k)


def latest_download(downloads: DataFrame) -> DataFrame:
    return latest(downloads, ["download_type"], [F.desc("downloaded_at"), F.desc("filename")])
