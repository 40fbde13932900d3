"""Files as sources and sinks: listings, CSV, JSON, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def discover(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Name, size and time of matching files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path", F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as text columns; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def export_csv(df: DataFrame, path: str, cols: Sequence[str], order: Sequence[str], limit: int | None = None, bom: bool = False) -> None:
    """The rows in order as CSV part files, or the first ``limit`` of them; the mark lets spreadsheets detect
    the encoding."""
    out = df.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    out = out.select(*cols)
    if bom:
        out = out.withColumnRenamed(cols[0], BOM + cols[0])
    out.write.mode("errorifexists").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Transfer records from documents of the form ``{"datas": [...]}``.

    One document per line, so that a file can be split; give the record schema to skip inference.
    """
    reader = spark.read
    if schema:
        reader = reader.schema(f"datas array<struct<{schema}>>")
    return reader.json(path).select(F.explode("datas").alias("d")).select("d.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_fact(df: DataFrame, path: str, date_col: str = "dateadm", key: str | None = None) -> None:
    """A fact as Parquet folders per month.

    Rows are rebalanced by month first: a busy month becomes several files of a good size and quiet
    months share a task, instead of every task writing a sliver of every month.  With ``key`` the rows of a file
    are sorted by it and a Bloom filter says which files can hold a value, for :func:`point_lookup`.
    """
    month = F.coalesce(F.date_format(date_col, "yyyy-MM"), F.lit("none"))
    rows = df.withColumn("month", month).hint("rebalance", "month")
    if key:
        rows = rows.sortWithinPartitions("month", key)
    writer = rows.write.mode("errorifexists").partitionBy("month")
    if key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def point_lookup(spark: SparkSession, path: str, key: str, *values: str) -> DataFrame:
    """The rows of some key values.  Row groups are skipped by their range and by the Bloom filter of the key."""
    rows = spark.read.parquet(path)
    return rows.where(F.col(key) == F.lit(values[0])) if len(values) == 1 else rows.where(F.col(key).isin(*values))


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Only the folders from ``first`` to ``last`` (``yyyy-MM``) are listed and read."""
    return spark.read.parquet(path).filter(F.col("month").between(first, last))


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """A table hashed and sorted by its join key: feeds bucketed alike join without a shuffle.

    The key is hashed before the write so that each bucket is one file.
    """
    df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
