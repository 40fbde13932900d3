"""Give executors the code of this package, for sessions that were started without it on their path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import send_code

#: Bytes of rows that a Python worker is handed at once.  A batch of ten thousand long texts would be gigabytes.
BATCH_BYTES = 8 << 20


def session_of(df: DataFrame) -> SparkSession:
    """The session of ``df``; its executors can import this package from now on.

    Batches are small from now on too, unless the session has a limit of its own.
    """
    spark = df.sparkSession
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == f"{64 << 20}b":
        spark.conf.set(limit, BATCH_BYTES)
    send_code(spark)
    return spark
