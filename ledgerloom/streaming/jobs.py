"""Incremental ingest and event detection.

Each detector is a plain function of an event frame, so the same code runs on a stream (with a
watermark) and on a table (its batch twin).  State lives in the checkpoint under the shared folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import latest
from ..session import fresh_path
from ..sources.keyed import KeyedTable


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob).load(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now into Parquet files and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def collect_stream(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to its present end under the shared folder and read back what it emitted."""
    out = fresh_path(spark, label)
    run_available(stream, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _batches(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batch folders a table has."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("batch="))


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column]) -> StreamingQuery:
    """Append each micro-batch, one row per key, as its own ``batch=N`` folder.

    ``foreachBatch`` may repeat a batch after a failure; the repeat overwrites the same folder, so the
    table never holds a batch twice.  A new checkpoint begins at 0 again; its folders follow those that are
    there, the place being written once beside the checkpoint.  :func:`current` gives the upserted view.
    """
    spark = stream.sparkSession
    note = f"{checkpoint}-first"
    try:
        base = spark.read.text(note).first()[0]
    except AnalysisException:
        base = str(max(_batches(spark, table), default=-1) + 1)
        spark.createDataFrame([(base,)], "value string").coalesce(1).write.text(note)

    def keep(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{table}/batch={int(base) + batch_id}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, table: str, keys: Sequence[str], order: Sequence[Column] = (), schema=None) -> DataFrame:
    """The row of each key that is first in ``order`` over all batches; among equals the one that came last.

    Give the ``order`` of :func:`ingest_stream`: a row that arrives late is then not taken for a newer one.
    Without an order what came last wins.
    """
    reader = spark.read.schema(schema.add("batch", "bigint")) if schema is not None else spark.read
    return latest(reader.parquet(table), keys, [*order, F.desc("batch")]).drop("batch")


def compact(spark: SparkSession, table: str, keys: Sequence[str], order: Sequence[Column] = (), target: str | None = None) -> str:
    """Write the current rows as the single batch of a fresh table; returns its path.

    The batch keeps the number of the newest it stands for, so a stream goes on in the new table with the
    checkpoint it has: its next batches get higher numbers.
    """
    target = target or fresh_path(spark, "compacted")
    newest = max(_batches(spark, table), default=0)
    current(spark, table, keys, order).write.mode("errorifexists").parquet(f"{target}/batch={newest}")
    return target


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, order: Sequence[Column], source: str = "stream") -> StreamingQuery:
    """Upsert each micro-batch into a keyed table; of a key's rows the first in ``order`` stays, however late it comes.

    Only the buckets that a batch touches are written, and a batch that is repeated after a failure is known by its
    number.  A new checkpoint begins at 0 again, so its numbers follow the table's own.
    """
    note = f"{checkpoint}-first"
    try:
        base = int(stream.sparkSession.read.text(note).first()[0])
    except AnalysisException:
        base = table.last_batch(source) + 1
        stream.sparkSession.createDataFrame([(str(base),)], "value string").coalesce(1).write.text(note)

    def keep(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, order, late=True, source=source, number=base + batch_id)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def without_repeats(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drop exact repeats that arrive within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def log_rates(events: DataFrame, window: str = "1 hour", delay: str = "1 hour", level: str = "status", source: str = "action", ts: str = "ts") -> DataFrame:
    """Events per tumbling window, level and source."""
    out = _late(events, ts, delay).groupBy(F.window(ts, window).alias("w"), level, source).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), level, source, "events")


def bruteforce(events: DataFrame, window: str = "15 minutes", slide: str = "1 minute", threshold: int = 3, delay: str = "15 minutes") -> DataFrame:
    """Users with repeated failed logins in a sliding window."""
    failed = _late(events.filter(F.col("action") == "LOGIN_FAILED"), "ts", delay)
    out = failed.groupBy(F.window("ts", window, slide).alias("w"), "user_id").agg(F.count("*").alias("failures"))
    return out.filter(F.col("failures") >= threshold).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "failures")


def breaches(events: DataFrame, capacity: int, window: str = "1 minute", delay: str = "5 minutes", key: Sequence[str] = ("user_id", "action")) -> DataFrame:
    """Windows in which a user and endpoint went over capacity."""
    out = _late(events, "ts", delay).groupBy(F.window("ts", window).alias("w"), *key).agg(F.count("*").alias("requests"))
    return out.filter(F.col("requests") > capacity).select(F.col("w.start").alias("window_start"), *key, "requests")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "30 minutes") -> DataFrame:
    """Activity sessions per user, split where the user was idle for the gap."""
    out = _late(events, "ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def archive_split(events: DataFrame, days: int, as_of: dt.datetime, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows older than ``days`` for the archive, and the rest."""
    cut = F.lit(as_of - dt.timedelta(days=days))
    return events.filter(F.col(ts) < cut), events.filter(F.col(ts) >= cut)
