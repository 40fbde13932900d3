"""Keyed upserts, deltas and ledger updates without a table format.

Every function returns the new table as a plan; the caller writes it to a fresh path (or uses
``MERGE INTO`` where a table format is at hand).  A batch is reduced to one row per key first, so
applying the same batch twice changes nothing.  A null part of a key equals a null part, both where a
batch is reduced and where it meets the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import one_per_key
from .windows import latest


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Replace rows whose key is in the batch, add the others; the last row of a key wins."""
    newest = latest(batch, keys, order)
    seen = one_per_key(newest, keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    kept = target.join(seen, _same(target, keys, [f"_k{i}" for i in range(len(keys))]), "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def _same(target: DataFrame, keys: Sequence[str], others: Sequence[str]) -> Column:
    """Keys equal part by part; null equals null."""
    return reduce(and_, [target[k].eqNullSafe(F.col(o)) for k, o in zip(keys, others, strict=True)])


def upsert_columns(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Update only ``update`` on known keys; unknown keys are inserted whole.

    Both sides hold one row per key (the table's own constraint, and ``latest`` for the batch), so a
    full outer join has no hot key to fear and needs one shuffle of each side.
    """
    newest = latest(batch, keys, order)
    cols = target.columns
    b = newest.select(F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in newest.columns])
    t = target.withColumn("_t", F.lit(True))
    joined = t.join(b, _same(t, keys, [f"_b_{k}" for k in keys]), "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.when(F.col("_t").isNull(), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c)
        if c not in newest.columns:
            return F.col(c)
        given = F.col(f"_b_{c}")
        if c in update:
            return F.when(F.col("_b").isNotNull(), given).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_t").isNull(), given).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in cols])


def apply_delta(target: DataFrame, delta: DataFrame, key: str, update: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Update known keys, insert new ones, leave absent keys alone."""
    return upsert_columns(target, delta, [key], update, order)


def delta_counts(target: DataFrame, delta: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """What a delta or a dimension load would do: imported, updated, skipped."""
    known = target.select(F.col(key).alias("_k")).distinct().withColumn("_t", F.lit(True))
    rows = delta.join(known, F.col(key) == F.col("_k"), "left")
    bad = F.col(name).isNull() if name else F.lit(False)
    outcome = F.when(bad, "skipped").when(F.col("_t").isNotNull(), "updated").otherwise("imported")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("count"))


def load_dim(target: DataFrame, df: DataFrame, key: str, name: str, mode: str, order: Sequence[Column]) -> DataFrame:
    """Load a dimension: rows without a name are skipped, rows without a key are always added."""
    good = df.filter(F.col(name).isNotNull())
    if mode == "replace":
        return good
    keyed, free = good.filter(F.col(key).isNotNull()), good.filter(F.col(key).isNull())
    return upsert(target, keyed, [key], order).unionByName(free, allowMissingColumns=True)


def replace_file(table: DataFrame, rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Append detail rows, dropping what the same files brought before: loading twice is safe."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    return df.filter(~F.coalesce(pred, F.lit(False)))


def delete_counts(df: DataFrame, pred: Column) -> DataFrame:
    gone = F.count_if(F.coalesce(pred, F.lit(False)))
    return df.agg(gone.alias("deleted"), (F.count("*") - gone).alias("kept"))


def close_import(ledger: DataFrame, counts: DataFrame) -> DataFrame:
    """Set status and record counts from the job's own counts (file_id, total, imported)."""
    c = counts.select("file_id", F.col("total").alias("_total"), F.col("imported").alias("_imported"))
    failed = F.col("_total") - F.col("_imported")
    ran = F.col("_total").isNotNull()
    status = F.when(~ran, F.col("status")).when(F.col("_imported") == 0, "failed").when(failed > 0, "partial").otherwise("completed")
    return (
        ledger.join(c, "file_id", "left")
        .withColumns(
            {
                "status": status,
                "total_records": F.when(ran, F.col("_total")).otherwise(F.col("total_records")),
                "imported_records": F.when(ran, F.col("_imported")).otherwise(F.col("imported_records")),
                "failed_records": F.when(ran, failed).otherwise(F.col("failed_records")),
            }
        )
        .drop("_total", "_imported")
    )


def pending(files: DataFrame, ledger: DataFrame, key: str = "filename") -> DataFrame:
    done = ledger.filter(F.col("status") == "completed").select(key)
    return files.join(done, key, "left_anti")


def reload_details(ledger: DataFrame, raw: DataFrame, kind: str = "IP") -> DataFrame:
    """Detail rows of completed files of one kind, to overwrite the detail table with."""
    files = ledger.filter((F.col("status") == "completed") & (F.col("file_type") == kind)).select("file_id")
    return raw.join(files, "file_id", "left_semi")


def reset_failed(ledger: DataFrame, kind: str | None = None, col: str = "download_type") -> DataFrame:
    """Failed rows go back to pending with the error cleared."""
    hit = F.col("download_status") == "failed"
    if kind:
        hit = hit & (F.col(col) == kind)
    return ledger.withColumns(
        {
            "error_message": F.when(hit, F.lit(None)).otherwise(F.col("error_message")),
            "retry_count": F.when(hit, F.lit(0)).otherwise(F.col("retry_count")),
            "download_status": F.when(hit, "pending").otherwise(F.col("download_status")),
        }
    )


def delete_failed(ledger: DataFrame, kind: str | None = None, col: str = "download_type") -> DataFrame:
    hit = F.col("download_status") == "failed"
    return delete_where(ledger, hit & (F.col(col) == kind) if kind else hit)


def drop_missing_files(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("file_exists"))


def migrate_history(history: DataFrame, ledger: DataFrame, on_conflict: str = "skip", names: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a JSON history (``downloads`` array) into the ledger by file name."""
    rows = history.select(F.explode("downloads").alias("d")).select("d.*")
    rows = rows.withColumnsRenamed(dict(names or {"name": "filename", "type": "download_type", "size": "file_size"}))
    rows = rows.filter(F.col("filename").isNotNull()).withColumns(
        {
            "download_type": F.coalesce(F.col("download_type"), F.lit("rep")),
            "file_size": F.coalesce(F.col("file_size").cast("bigint"), F.lit(0)),
        }
    )
    rows = latest(rows, ["filename"], [F.desc("file_size"), F.asc("download_type")])
    cols = [c for c in ledger.columns if c in rows.columns]
    if on_conflict == "skip":
        new = rows.join(ledger.select("filename"), "filename", "left_anti")
        return ledger.unionByName(new.select(*cols), allowMissingColumns=True)
    return upsert_columns(ledger, rows.select(*cols), ["filename"], [c for c in cols if c != "filename"], [F.desc("file_size")])


def mark_notices(notices: DataFrame, ids: DataFrame, column: str = "is_read") -> DataFrame:
    """Set a flag on the given ids."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return notices.join(hit, "id", "left").withColumn(column, F.col(column) | F.col("_hit").isNotNull()).drop("_hit")
