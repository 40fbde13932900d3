"""Exact trailing counts on a stream: for each event, how many of its key lie in ``(ts - seconds, ts]``.

An event's count is final when the watermark has passed it.  So a micro-batch works on the events that are not final
yet, those of the last ``seconds`` before the watermark and the new ones, counts them as the batch operator does
(:func:`..operators.windows.trailing_count`, in which no task owns a key), gives out what has become final and carries
the rest.  What it gives, what it carries and the watermark are published by one record, so a micro-batch that is
repeated changes nothing and one that is lost leaves the state before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.windows import trailing_count
from ..sources.manifests import Manifests


class TrailingCounts:
    """A stream's state and results in a folder of the shared file system.

    Events later than ``delay`` seconds behind the newest one are left out and counted; events without key or time have
    the count 0.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: str, ts: str, seconds: int, delay: int, out: str = "n_recent"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.by, self.ts, self.seconds, self.delay, self.out = by, ts, seconds, delay, out
        self.manifests = Manifests(spark, f"{self.path}/state")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Work off what is there now and stop."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def _micros(self) -> Column:
        return F.unix_micros(F.col(self.ts).cast("timestamp"))

    def _carried(self, state: dict) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("_done", BooleanType())])
        if state.get("carry") is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/carry/batch={state['carry']}")

    def add(self, batch: DataFrame, number: int) -> None:
        """Work off one micro-batch."""
        at, state = self.manifests.latest()
        if number <= state.get("batch", -1):
            return
        self._step(at, state, batch.select(*self.schema.names), number, None)

    def close(self) -> None:
        """Give out what is still open: the feed has ended."""
        at, state = self.manifests.latest()
        if at >= 0:
            self._step(at, state, self.spark.createDataFrame([], self.schema), state["batch"], F.lit(True))

    def _step(self, at: int, state: dict, batch: DataFrame, number: int, final: Column | None) -> None:
        name = at + 1
        mark = state.get("mark")
        late = F.lit(False) if mark is None else F.coalesce(self._micros() <= mark, F.lit(False))
        fresh = batch.withColumn("_done", F.when(late, F.lit(None).cast("boolean")).otherwise(F.lit(False)))
        # The batch is read once; everything below works on what was staged.
        self._carried(state).unionByName(fresh).write.mode("overwrite").parquet(f"{self.path}/staged/batch={name}")
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("_done", BooleanType())])).parquet(f"{self.path}/staged/batch={name}")
        newest, n_late = rows.agg(F.max(F.when(F.col("_done").isNotNull(), self._micros())), F.count_if(F.col("_done").isNull())).first()
        rows = rows.where("_done IS NOT NULL")
        if newest is not None:
            mark = max(newest - self.delay * 1_000_000, mark if mark is not None else newest - self.delay * 1_000_000)
        settled = F.lit(True) if final is not None else F.coalesce(self._micros() <= (mark if mark is not None else 0), F.lit(True))
        counted = trailing_count(rows, self.by, self.ts, self.seconds, self.out)
        counted.where(~F.col("_done") & settled).drop("_done").write.mode("overwrite").parquet(f"{self.path}/counts/batch={name}")
        needed = self._micros() > (mark if mark is not None else 0) - self.seconds * 1_000_000
        rows.where(needed).withColumn("_done", F.col("_done") | settled).write.mode("overwrite").parquet(f"{self.path}/carry/batch={name}")
        record = {"batch": number, "carry": name, "mark": mark, "late": state.get("late", 0) + n_late}
        self.manifests.publish(name, record)
        self.manifests.drop(f"{self.path}/staged/batch={name}")
        if state.get("carry") is not None:
            self.manifests.drop(f"{self.path}/carry/batch={state['carry']}")

    def late(self) -> int:
        """How many events came too late to count."""
        return self.manifests.latest()[1].get("late", 0)

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All events whose count is final, each once."""
        last = self.manifests.latest()[0]
        schema = StructType([*self.schema.fields, StructField(self.out, LongType())])
        if last < 0:
            return self.spark.createDataFrame([], schema).select(*(columns or schema.names))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/counts/batch={n}" for n in range(last + 1)]).select(*(columns or schema.names))
