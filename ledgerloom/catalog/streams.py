"""Streams over the event table; each emits what its batch twin finds in closed windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import joins, windows
from ..session import fresh_path
from ..sources.keyed import KeyedTable
from ..sources.tables import VIEWS
from ..streaming import jobs
from ..streaming.trailing import TrailingCounts
from .base import n, query, txt


def _events(t):
    return jobs.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def _audit(t):
    """The audit feed as a stream: the same view text over a streaming events frame."""
    return t.spark.sql(VIEWS["audit"], events=_events(t).withColumn("ts", F.col("ts").cast("timestamp")))


def _audit_batch(t):
    return t.audit.withColumn("ts", F.col("ts").cast("timestamp"))


_HOUR = f"""SELECT {txt("date_trunc('hour', ts)")} AS window_start, {txt("date_trunc('hour', ts) + INTERVAL 1 HOUR")} AS window_end, status, action, count(*) AS events FROM audit"""
_MARK = "(SELECT max(ts) FROM audit) - INTERVAL 1 HOUR"


@query("str01_ingest", f"SELECT event_id, {txt('ts')} AS ts, user_id, event_type, value, props FROM events")
def _(t):
    out = fresh_path(t.spark, "ingest")
    table = KeyedTable.create(t.spark, f"{out}/table", t.events.schema, ["event_id"], 8)
    for _ in range(2):
        jobs.upsert_stream(_events(t), table, f"{out}/checkpoint", [F.desc("ts")])
    return table.read()


@query("str01_append", f"SELECT event_id, {txt('ts')} AS ts, user_id, event_type, value, props FROM events")
def _(t):
    out = fresh_path(t.spark, "ingest")
    jobs.ingest_stream(_events(t), f"{out}/table", f"{out}/checkpoint", ["event_id"], [F.desc("ts")])
    jobs.ingest_stream(_events(t), f"{out}/table", f"{out}/checkpoint", ["event_id"], [F.desc("ts")])
    return jobs.current(t.spark, f"{out}/table", ["event_id"])


_PER_HOUR = f"{_HOUR} GROUP BY date_trunc('hour', ts), status, action"


@query("str02_log_rates", f"{_PER_HOUR} HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK}")
def _(t):
    return jobs.collect_stream(t.spark, jobs.log_rates(_audit(t)), "log-rates")


@query("str02_log_rates_batch", _PER_HOUR)
def _(t):
    return jobs.log_rates(_audit_batch(t))


_SLIDE = f"""SELECT {txt('w')} AS window_start, {txt('w + INTERVAL 24 HOUR')} AS window_end, user_id, count(*) AS failures
  FROM (SELECT user_id, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM audit WHERE action = 'LOGIN_FAILED') GROUP BY w, user_id HAVING count(*) >= 3"""


@query("str03_trailing_exact", f"""SELECT id, user_id, {txt('ts')} AS ts, count(*) OVER (PARTITION BY user_id ORDER BY audit.ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n_recent
  FROM audit WHERE action = 'LOGIN_FAILED'""")
def _(t):
    """The feed comes in four files, every seventh event a file late."""
    failed = t.audit.filter("action = 'LOGIN_FAILED'").select("id", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = failed.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    span = ((last or 0) - (first or 0)) // 4 + 1
    part = F.floor((F.unix_seconds("ts") - (first or 0)) / span) + F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    out = fresh_path(t.spark, "trailing")
    counts = TrailingCounts(t.spark, f"{out}/counts", failed.schema, "user_id", "ts", 86400, 2 * span)
    for k in range(5):
        failed.where(part == k).coalesce(1).write.mode("append").parquet(f"{out}/feed")
        counts.run(jobs.file_stream(t.spark, f"{out}/feed", failed.schema), f"{out}/checkpoint")
    counts.close()
    return counts.read()


@query("str03_bruteforce", f"{_SLIDE} AND w + INTERVAL 24 HOUR <= (SELECT max(ts) FROM audit WHERE action = 'LOGIN_FAILED') - INTERVAL 1 HOUR")
def _(t):
    return jobs.collect_stream(t.spark, jobs.bruteforce(_audit(t), "24 hours", "1 hour", 3, "1 hour"), "bruteforce")


@query("str03_bruteforce_batch", _SLIDE)
def _(t):
    return jobs.bruteforce(_audit_batch(t), "24 hours", "1 hour", 3)


_BREACH = f"SELECT {txt("date_trunc('hour', ts)")} AS window_start, user_id, action, count(*) AS requests FROM audit GROUP BY date_trunc('hour', ts), user_id, action HAVING count(*) > 1"


@query("str04_breaches", f"{_BREACH} AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM audit) - INTERVAL 5 MINUTE")
def _(t):
    return jobs.collect_stream(t.spark, jobs.breaches(_audit(t), 1, "1 hour"), "breaches")


@query("str04_breaches_batch", _BREACH)
def _(t):
    return jobs.breaches(_audit_batch(t), 1, "1 hour")


_SESS = f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM audit),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
  x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b, count(*) AS events FROM g GROUP BY user_id, k)
  SELECT user_id, {txt('a')} AS session_start, {txt('b')} AS session_end, events FROM x"""


@query("str05_sessions", f"{_SESS} WHERE x.b <= (SELECT max(ts) FROM audit) - INTERVAL 30 MINUTE")
def _(t):
    return jobs.collect_stream(t.spark, jobs.sessions(_audit(t), "2 hours"), "sessions")


@query("str05_sessions_batch", _SESS)
def _(t):
    return windows.gap_sessions(t.audit, "user_id", "ts", 7200)


@query("str06_latest_stream", f"SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    out = fresh_path(t.spark, "latest")
    stream = _events(t).select("user_id", "event_id", "ts")
    jobs.ingest_stream(stream, f"{out}/table", f"{out}/checkpoint", ["user_id"], [F.desc("event_id")])
    return jobs.current(t.spark, f"{out}/table", ["user_id"], [F.desc("event_id")]).select("user_id", "event_id")


@query("str06_without_repeats", f"SELECT event_id, user_id, event_type FROM events")
def _(t):
    events = _events(t).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts")
    twice = joins.stack([events, events])
    return jobs.collect_stream(t.spark, jobs.without_repeats(twice, ["event_id"], "ts", "1 hour"), "distinct").drop("ts")


@query("str07_archive", f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'archive' ELSE 'live' END AS part, count(*) AS events, {n("status = 'failed'")} AS failed FROM audit GROUP BY 1""")
def _(t):
    old, live = jobs.archive_split(t.audit, 10, dt.datetime(2024, 1, 31))
    out = fresh_path(t.spark, "archive")
    old.write.parquet(f"{out}/archive")
    live.write.parquet(f"{out}/live")
    parts = [t.spark.read.parquet(f"{out}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed")) for p in ("archive", "live")]
    return joins.stack(parts)
