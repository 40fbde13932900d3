"""Import of workbooks as one job: raw rows to typed tables, a ledger, and one record that publishes them.

A run deals the raw rows into tables in one scan, reads their cells, judges every file by itself and writes the rows
of the files that can be read, each table into a folder of the run.  Only then the run is published
(:mod:`..sources.manifests`): a job that ends between two tables leaves what was there.  A file that is imported again
replaces its own rows; if it fails then, its earlier rows stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell
from ..operators import sheets
from ..operators.joins import one_per_key
from ..operators.sheets import Section
from ..operators.windows import latest
from ..session import COMPILED, held
from ..sources.manifests import Manifests

LEDGER = "ledger"


class Warehouse:
    """Tables filled by import runs, in a folder of the shared file system.

    ``main`` are the tables that decide whether a file could be read; a file holds one row for each key in them.
    """

    def __init__(self, spark: SparkSession, path: str, sections: Sequence[Section], main: Sequence[str] = ("claims",)):
        self.spark, self.path, self.main = spark, path.rstrip("/"), tuple(main)
        self.sections = {s.table: s for s in sections}
        self.manifests = Manifests(spark, f"{self.path}/runs")

    def _published(self, name: str) -> DataFrame | None:
        runs = self.manifests.latest()[1].get("runs", [])
        if not runs:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/run={r}" for r in runs])

    def history(self) -> DataFrame | None:
        """What every run made of every file it was offered."""
        return self._published(LEDGER)

    def ledger(self) -> DataFrame:
        """The last outcome of each file."""
        return latest(self._published(LEDGER), ["file"], [F.desc("run")])

    def table(self, name: str) -> DataFrame:
        """The rows of each file's last run that could read it."""
        rows = self._published(name)
        good = one_per_key(self._published(LEDGER).where("status <> 'failed'"), "file", F.max("run").alias("_run")).withColumnRenamed("file", "_file")
        return rows.join(good, (F.col("file") == F.col("_file")) & (F.col("run") == F.col("_run")), "left_semi").drop("run")

    def load(self, raw: DataFrame, offered: DataFrame | None = None) -> DataFrame:
        """Import ``raw(file, sheet, row, c0..)``; returns the run's ledger.

        ``offered(file)`` are the files the run was given: those that gave no row at all are failures too.
        """
        with held(self.spark, COMPILED):
            return self._load(raw, offered)

    def _load(self, raw: DataFrame, offered: DataFrame | None) -> DataFrame:
        number, state = self.manifests.latest()
        runs = state.get("runs", [])
        run = (max(runs) if runs else -1) + 1
        # A folder that a lost run left is written over.
        staged = f"{self.path}/staged/run={run}"
        self.manifests.drop(staged)
        sheets.deal(raw, list(self.sections.values()), staged)
        typed = {name: sheets.section(self.spark, staged, s, raw.schema) for name, s in self.sections.items()}
        outcome = self._judged(staged, raw, offered)
        outcome.write.mode("overwrite").parquet(f"{self.path}/{LEDGER}/run={run}")
        outcome = self.spark.read.parquet(f"{self.path}/{LEDGER}/run={run}")
        good = one_per_key(outcome.where("status <> 'failed'"), "file")
        for name, rows in typed.items():
            if self.sections[name].key:
                rows = rows.where(F.col(self.sections[name].key).isNotNull())
            if name in self.main:
                rows = latest(rows, ["file", self.sections[name].key], [F.desc("row_number")])
            rows.join(good, "file", "left_semi").write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")
        self.manifests.publish(number + 1, {"runs": [*runs, run]})
        self.manifests.drop(staged)
        return outcome

    def _judged(self, staged: str, raw: DataFrame, offered: DataFrame | None) -> DataFrame:
        """(file, status, total, imported, failed, a count of rows for each table) of all files.

        A row of a main table is imported if all its numbers and times that are there can be read.  A file fails
        if it has no such row.
        """
        rows = self.spark.read.schema(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema] + ["data_type string", "`table` string"])).parquet(staged)
        mine, read = F.lit(False), F.lit(True)
        for section in (self.sections[name] for name in self.main):
            here = F.col("table") == section.table
            key = next(f for f in section.fields if f.name == section.key)
            value = key.read(F.col(f"c{key.source}"))
            mine = mine | (here & value.isNotNull() & (F.upper(value) != "TRAN_ID"))
            for f in section.fields:
                if f.kind in ("number", "timestamp", "day") and f"c{f.source}" in raw.columns:
                    cell = F.col(f"c{f.source}")
                    read = read & (~here | clean_cell(cell).isNull() | f.read(cell).isNotNull())
        # The cells of main tables alone are read; of the others, rows are counted.
        others, is_main = [name for name in self.sections if name not in self.main], F.col("table").isin(*self.main)
        judged = rows.where(is_main).groupBy("file").agg(F.count_if(mine).alias("total"), F.count_if(mine & read).alias("imported"))
        counted = rows.where(~is_main).groupBy("file").agg(*[F.count_if(F.col("table") == name).alias(f"{name}_rows") for name in others]) if others else rows.select("file").limit(0)
        found = judged.unionByName(counted, allowMissingColumns=True)
        found = found.groupBy("file").agg(*[F.sum(c).alias(c) for c in found.columns if c != "file"])
        files = one_per_key(raw.select("file") if offered is None else raw.select("file").unionByName(offered.select("file")), "file")
        every = files.join(found.withColumnRenamed("file", "_file"), F.col("file") == F.col("_file"), "left").drop("_file")
        every = every.select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in every.columns if c != "file"])
        status: Column = F.when(F.col("imported") == 0, "failed").when(F.col("total") > F.col("imported"), "partial").otherwise("completed")
        return every.withColumns({"failed": F.col("total") - F.col("imported"), "status": status})
