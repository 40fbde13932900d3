"""Numbered records of what a folder's current state is.

A state is published by one small file that appears under its number by a rename, after all the data it names is
written.  Readers look at the highest number; what no record names was left by a job that did not end, and
nobody reads it.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def numbers(self) -> list[int]:
        fs, place = self._fs(self.folder)
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def latest(self) -> tuple[int, dict[str, Any]]:
        """The highest number and its record; -1 and nothing before the first."""
        numbers = self.numbers()
        if not numbers:
            return -1, {}
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{numbers[-1]:08d}.json").collect())
        return numbers[-1], json.loads(text)

    def publish(self, number: int, record: dict[str, Any]) -> None:
        """Make ``record`` the current state, unless another writer has taken the number."""
        fs, final = self._fs(f"{self.folder}/{number:08d}.json")
        _, draft = self._fs(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"state {number} of {self.folder} was published by another writer")

    def drop(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)

    def children(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []
