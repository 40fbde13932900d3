"""Session settings and the shared working folder.

The library never needs these settings to be correct; they are what a job would normally pass
to ``spark-submit``.  ``adaptive`` keys matter most at scale: joins on claim ids rely on AQE to
split a hot key and to turn a join into a broadcast only after the side has been measured.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Methods beyond this size are never compiled by the JVM; wide ingest layouts exceed it when fused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# What a job that writes rows of many cells sets while it runs, whatever its session says.
COMPILED = {k: SETTINGS[k] for k in ("spark.sql.codegen.hugeMethodLimit",)}


@contextmanager
def held(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold inside the block; the session's own come back after it."""
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def build_session(master: str | None = None, app: str = "ledgerloom", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, only a session in one process
    gets a temporary folder, which goes when the process ends; tests, bench and tools name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, fresh, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


_sent: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Give executors the code of this package, once per application, for sessions without it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-code-"), "ledgerloom_code.zip")
        with zipfile.ZipFile(target, "w") as out:
            for at, _, names in os.walk(os.path.join(top, "ledgerloom")):
                for name in names:
                    if name.endswith(".py"):
                        out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), top))
        spark.sparkContext.addPyFile(target)
        _sent.add(app)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
