"""Tables with one row per key, in which a merge writes only the buckets its batch touches.

Rows are dealt into buckets by a hash of their key.  A bucket's rows lie in one folder of the write that made them
last, ``data/write=W/bucket=B``; the current record (:mod:`.manifests`) names the write of each bucket and the
last batch of each source.  A merge finds the buckets of its batch, reads those alone, writes them anew into a
folder of its own and publishes.  So readers never see half a merge, a merge that was lost leaves the old state, and a
batch that is repeated after it was published changes nothing.

Equal key parts include null ones: a null part equals a null part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.merge import upsert, upsert_columns
from ..operators.windows import latest
from .manifests import Manifests


class KeyedTable:
    """A table in a folder of the shared file system; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, f"{self.path}/commits")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64) -> KeyedTable:
        """An empty table.  ``buckets`` says into how many parts it is dealt for good: about a gigabyte each at its full size."""
        table = cls(spark, path)
        table.manifests.publish(0, {"keys": list(keys), "buckets": buckets, "schema": schema.json(), "at": {}, "batches": {}})
        return table

    def _state(self) -> tuple[int, dict[str, Any]]:
        number, state = self.manifests.latest()
        if number < 0:
            raise ValueError(f"no table at {self.path}")
        return number, state

    def _folder(self, write: str, bucket: int) -> str:
        return f"{self.path}/data/write={write}/bucket={bucket}"

    def _rows(self, state: dict[str, Any], buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        schema = StructType.fromJson(json.loads(state["schema"]))
        wanted = state["at"] if buckets is None else {str(b): state["at"][str(b)] for b in buckets if str(b) in state["at"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._folder(w, int(b)) for b, w in sorted(wanted.items())])

    def read(self) -> DataFrame:
        return self._rows(self._state()[1])

    def lookup(self, *keys: Sequence) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        _, state = self._state()
        schema = StructType.fromJson(json.loads(state["schema"]))
        asked = self.spark.createDataFrame([tuple(k) for k in keys], StructType([schema[k] for k in state["keys"]]))
        buckets = [r[0] for r in asked.select(self._bucket(state)).distinct().collect()]
        rows = self._rows(state, buckets)
        named = asked.toDF(*[f"_{k}" for k in state["keys"]])
        on = [rows[k].eqNullSafe(named[f"_{k}"]) for k in state["keys"]]
        return rows.join(F.broadcast(named), on, "left_semi")  # as many rows as the caller named

    def last_batch(self, source: str = "") -> int:
        """The number of the last batch of a source; -1 before the first."""
        return self._state()[1]["batches"].get(source, -1)

    @staticmethod
    def _bucket(state: dict[str, Any]) -> Column:
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int").alias("bucket")

    def merge(self, batch: DataFrame, order: Sequence[Column], update: Sequence[str] | None = None, late: bool = False, source: str = "", number: int | None = None) -> int:
        """Merge a batch, one row per key: its first in ``order``; returns how many buckets were written.

        A row of the batch replaces the table's row of its key; with ``update`` only in those columns, and with
        ``late`` only if it comes first in ``order`` too.  A batch whose ``number`` is not above the last
        one of its ``source`` is there already.
        """
        commit, state = self._state()
        if number is not None and number <= state["batches"].get(source, -1):
            return 0
        schema, keys = StructType.fromJson(json.loads(state["schema"])), state["keys"]
        # A batch may come from files or a stream that cannot be read twice alike; what is merged is what was staged.
        write = f"{commit + 1}-{uuid.uuid4().hex[:8]}"
        staged = f"{self.path}/staged/{write}"
        newest = latest(batch, keys, order)
        newest.select("*", self._bucket(state)).write.parquet(staged)
        newest = self.spark.read.schema(StructType([*newest.schema, StructField("bucket", IntegerType())])).parquet(staged)
        touched = sorted(r.bucket for r in newest.select("bucket").distinct().collect())  # as many as buckets at most
        newest = newest.drop("bucket")
        if touched:
            there = self._rows(state, touched)
            if update is not None:
                merged = upsert_columns(there, newest, keys, update, order)
            elif late:
                merged = latest(there.unionByName(newest, allowMissingColumns=True), keys, order)
            else:
                merged = upsert(there, newest, keys, order)
            merged = merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], self._bucket(state))
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/write={write}")
        state["at"] |= {str(b): write for b in touched}
        if number is not None:
            state["batches"][source] = number
        self.manifests.publish(commit + 1, state)
        self.manifests.drop(staged)
        return len(touched)

    def vacuum(self) -> int:
        """Remove folders that the current state does not name; returns how many.  Run it when nobody reads or merges."""
        kept = {(w, int(b)) for b, w in self._state()[1]["at"].items()}
        gone = 0
        for folder in self.manifests.children(f"{self.path}/data"):
            write = folder.partition("=")[2]
            buckets = [int(b.partition("=")[2]) for b in self.manifests.children(f"{self.path}/data/{folder}") if b.startswith("bucket=")]
            old = [b for b in buckets if (write, b) not in kept]
            for b in old:
                self.manifests.drop(self._folder(write, b))
            if len(old) == len(buckets):
                self.manifests.drop(f"{self.path}/data/{folder}")
            gone += len(old)
        return gone
