"""Files, downloads, jobs, transfers and directories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import joins
from ..plans import bookkeeping, reports
from .base import d, hu, n, query, s, txt

_SUMS = f"{s('total_amount')} AS total_amount, {s('wait_amount')} AS wait_amount, {s('debt_amount')} AS debt_amount"


@query("ag24_dashboard_status", f"""SELECT f.*, p.*, m.* FROM (SELECT {n("status = 'completed'")} AS completed, {n("status = 'failed'")} AS failed, {n("status NOT IN ('completed', 'failed')")} AS pending FROM ledger) f,
  (SELECT count(*) AS transfers, {s('total_amount')} AS transfer_amount, {txt('max(run_date)')} AS last_sync FROM transfers_core) p,
  (SELECT {n('r.tran_id IS NOT NULL')} AS stm_matched, {n('r.tran_id IS NULL')} AS stm_unmatched FROM stm_core x LEFT JOIN claims_core r USING (tran_id)) m""")
def _(t):
    return reports.dashboard_status(t.ledger, t.transfers_core, joins.persist_match(t.stm_core, t.claims_core.select("tran_id", "paid")))


@query("ag39_transfer_summary", f"""SELECT 'total' AS level, NULL AS key, count(*) AS records, {_SUMS} FROM transfers UNION ALL SELECT 'fund', fund_name, count(*), {_SUMS} FROM transfers GROUP BY 2
  UNION ALL SELECT 'group', fund_group_desc, count(*), {_SUMS} FROM transfers GROUP BY 2 UNION ALL SELECT 'month', substr(posting_date, 1, 6), count(*), {_SUMS} FROM transfers GROUP BY 2""")
def _(t):
    return bookkeeping.transfer_summary(t.transfers)


@query("ag39_top_groups", f"SELECT fund_group_desc, count(*) AS records, {s('total_amount')} AS total_amount FROM transfers GROUP BY 1 ORDER BY sum(total_amount) DESC, 1 LIMIT 10")
def _(t):
    return bookkeeping.top_groups(t.transfers)


def _imports(feed: str, table: str) -> str:
    return f"""SELECT '{feed}' AS feed, file_type, count(*) AS files, {n("status = 'completed'")} AS imported, {n("status = 'failed'")} AS failed, CAST(sum(total_records) AS BIGINT) AS records FROM {table} GROUP BY 2"""


@query("ag42_imports_status", _imports("rep", "ledger") + " UNION ALL " + _imports("stm", "stm_files"))
def _(t):
    return bookkeeping.imports_status(t.ledger, t.stm_files)


@query("ag43_file_type_stats", f"""SELECT *, CASE WHEN size < 1e3 THEN size || ' Bytes' WHEN size < 1e6 THEN printf('%.1f kB', round(size / 1e3 + 1e-9, 1)) WHEN size < 1e9 THEN printf('%.1f MB', round(size / 1e6 + 1e-9, 1))
  ELSE printf('%.1f GB', round(size / 1e9 + 1e-9, 1)) END AS size_formatted FROM (SELECT regexp_extract(filename, '^eclaim_(\\d+)_([A-Z_]+)_(\\d{{8}})_(\\d+)\\.xls', 2) AS type, count(*) AS count,
  {n("status = 'completed'")} AS imported, {n("status <> 'completed'")} AS pending, CAST(sum(total_records * 333) AS BIGINT) AS size FROM ledger GROUP BY 1)""")
def _(t):
    files = t.ledger.select("filename", (F.col("total_records") * 333).alias("size"))
    return bookkeeping.file_type_stats(files, t.ledger)


def _st(w: str) -> str:
    return n(f"download_status = '{w}'")


@query("ag44_download_stats", f"""SELECT download_type, count(*) AS total, {_st('success')} AS success, {_st('failed')} AS failed, {_st('pending')} AS pending, {n('imported')} AS imported,
  CAST(sum(file_size) AS BIGINT) AS bytes, {txt('max(downloaded_at)')} AS last_download FROM downloads GROUP BY 1""")
def _(t):
    return bookkeeping.download_stats(t.downloads)


@query("ag44_downloads_by_month", "SELECT download_type, fiscal_year, service_month, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM downloads GROUP BY 1, 2, 3")
def _(t):
    return bookkeeping.downloads_by_month(t.downloads)


@query("ag44_downloads_by_scheme", f"SELECT download_type, scheme, count(*) AS files, {n('imported')} AS imported FROM downloads GROUP BY 1, 2")
def _(t):
    return bookkeeping.downloads_by_scheme(t.downloads)


@query("ag44_failed_downloads", f"SELECT download_type, filename, error_message, retry_count, {txt('downloaded_at')} AS downloaded_at FROM downloads WHERE download_status = 'failed'")
def _(t):
    return bookkeeping.failed_downloads(t.downloads)


@query("ag44_latest_download", f"SELECT download_type, filename, {txt('downloaded_at')} AS downloaded_at FROM (SELECT *, row_number() OVER (PARTITION BY download_type ORDER BY downloaded_at DESC, filename DESC) AS rn FROM downloads) WHERE rn = 1")
def _(t):
    return bookkeeping.latest_download(t.downloads).select("download_type", "filename", "downloaded_at")


@query("win02_freshness", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY download_type, scheme ORDER BY fiscal_year DESC, service_month DESC) AS rn FROM downloads WHERE file_exists)
  SELECT download_type, scheme, count(*) AS file_count, {txt('max(downloaded_at)')} AS last_download, max(CASE WHEN rn = 1 THEN fiscal_year END) AS latest_year, max(CASE WHEN rn = 1 THEN service_month END) AS latest_month,
  max(CASE WHEN rn = 1 THEN fiscal_year END) = 2544 AND max(CASE WHEN rn = 1 THEN service_month END) = 7 AS is_current FROM x GROUP BY 1, 2""")
def _(t):
    return bookkeeping.freshness(t.downloads, dt.date(2001, 7, 15))


@query("ag45_job_stats", f"""SELECT job_type, status, count(*) AS jobs, {hu('CAST(sum(s) AS DOUBLE) / nullif(count(s), 0)')} AS avg_duration FROM (SELECT *, CAST(floor(epoch(completed_at)) - floor(epoch(started_at)) AS BIGINT) AS s
  FROM jobs WHERE started_at >= TIMESTAMP '2024-01-20') GROUP BY 1, 2""")
def _(t):
    return bookkeeping.job_stats(t.jobs, 10, dt.datetime(2024, 1, 30))


@query("ag46_office_stats", """SELECT 'status' AS facet, status AS value, count(*) AS count FROM offices GROUP BY 2 UNION ALL SELECT 'level', hospital_level, count(*) FROM offices GROUP BY 2
  UNION ALL SELECT 'region', health_region, count(*) FROM offices GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'province', province, count(*) FROM offices GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def _(t):
    return bookkeeping.office_stats(t.offices)


@query("ag48_seed_status", """SELECT *, CASE WHEN rows = 0 THEN 'empty' WHEN rows < minimum THEN 'partial' ELSE 'ok' END AS state FROM (SELECT 'offices' AS table_name, count(*) AS rows, 9000 AS minimum FROM offices
  UNION ALL SELECT 'drugs', count(*), 1 FROM drugs UNION ALL SELECT 'diagnoses', count(*), 40000 FROM diagnoses UNION ALL SELECT 'errors', count(*), 1 FROM error_dim WHERE code = 'none')""")
def _(t):
    return bookkeeping.seed_status({"offices": (t.offices, 9000), "drugs": (t.drugs, 1), "diagnoses": (t.diagnoses, 40000), "errors": (t.error_dim.filter("code = 'none'"), 1)}).withColumn("minimum", F.col("minimum").cast("int"))


@query("ag55_completed_files", f"SELECT file_id, filename, {txt('file_date')} AS file_date, total_records FROM ledger WHERE status = 'completed' ORDER BY ledger.file_date DESC, file_id DESC LIMIT 100")
def _(t):
    return bookkeeping.completed_files(t.ledger, k=100).select("file_id", "filename", "file_date", "total_records")


@query("ag55_transfer_runs", f"SELECT {txt('run_date')} AS run_date, count(*) AS records, {s('total_amount')} AS total_amount FROM transfers_core GROUP BY transfers_core.run_date ORDER BY transfers_core.run_date DESC LIMIT 100")
def _(t):
    return bookkeeping.transfer_runs(t.transfers_core, k=100)


@query("ag55_file_items", f"SELECT tran_id, hn, {d('claim_drg')} AS claim_drg FROM claims_core WHERE file_id = 12 ORDER BY tran_id LIMIT 25 OFFSET 50")
def _(t):
    return bookkeeping.file_items(t.claims_core, 12, 25, 50).select("tran_id", "hn", "claim_drg")
