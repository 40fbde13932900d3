"""Search for a part of a text by its trigrams.

The rows are stored in buckets by their key, and for every run of three letters of a searched column there is a
posting with the row's key and bucket, stored in parts by a hash of the run.  A term is cut into its runs; only their
parts are read, the keys that all runs share are candidates, only the candidates' buckets are read, and every hit is
verified by the same comparison as a scan's.  Terms of less than three letters scan the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import search
from ..operators.joins import one_per_key


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text, lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.length(low) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


#: Rows whose postings a task sorts.  A row has some twenty of them.
TASK_ROWS = 100_000


def _dealt(rows: DataFrame, by: str, buckets: int, slices: int, of: Sequence[str]) -> DataFrame:
    """Each of the buckets of ``by`` in about as many tasks as there are slices."""
    return rows.withColumn("_slice", F.pmod(F.xxhash64(*of), F.lit(slices))).hint("rebalance", buckets * slices, by, "_slice").drop("_slice")


class TrigramIndex:
    """Rows and postings in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.columns, self.buckets = spark, path.rstrip("/"), key, list(columns), buckets

    def _part(self, of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame) -> TrigramIndex:
        """Store ``rows`` and their postings.

        Buckets and parts are cut into as many slices as their number of rows asks for, so that a task sorts the same few
        rows however large the table is.  A busy run becomes several files of its part.
        """
        slices = -(-rows.count() // (self.buckets * TASK_ROWS)) or 1
        stored = rows.withColumn("bucket", self._part(F.col(self.key)))
        _dealt(stored, "bucket", self.buckets, slices, rows.columns).sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/rows")
        every = F.array_distinct(F.flatten(F.array(*[grams(F.col(c).cast("string")) for c in self.columns])))
        posts = stored.select(F.explode(every).alias("gram"), F.col(self.key).alias("key"), F.col("bucket").alias("at"))
        posts = posts.withColumn("part", self._part(F.col("gram")))
        _dealt(posts, "part", self.buckets, slices, ["key"]).sortWithinPartitions("part", "gram", "key").write.partitionBy("part").parquet(f"{self.path}/grams")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("bucket")

    def candidates(self, term: str) -> DataFrame:
        """(key, at) of the rows that have every run of the term; reads the parts of those runs alone."""
        asked = self.spark.range(1).select(F.explode(grams(F.lit(term))).alias("gram")).select("gram", self._part(F.col("gram")).alias("part")).collect()  # a term's runs
        wanted = sorted({r.gram for r in asked})
        posts = self.spark.read.parquet(f"{self.path}/grams").where(F.col("part").isin(*{r.part for r in asked}) & F.col("gram").isin(*wanted))
        return posts.groupBy("key", "at").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("key", "at")

    def search(self, term: str) -> DataFrame:
        """The rows in which a searched column holds the term, whatever its case."""
        if len(term.lower()) < 3:
            return search(self.rows(), term, self.columns)
        found = self.candidates(term)
        buckets = [r.at for r in found.select("at").distinct().collect()]  # as many as there are at most
        rows = self.spark.read.parquet(f"{self.path}/rows")
        rows = rows.where(F.col("bucket").isin(*buckets)).drop("bucket") if buckets else rows.limit(0).drop("bucket")
        near = rows.join(one_per_key(found.select(F.col("key").alias("_key")), "_key"), F.col(self.key) == F.col("_key"), "left_semi")
        return search(near, term, self.columns)
