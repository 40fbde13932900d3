"""Binary files in the folder that the cluster shares.

Tasks write whole files under a name of their own and rename them when they are complete, so a task
that is repeated after its executor was lost can never leave half a file under a name that is read.
Only the names that reach a committed manifest count; what a lost attempt wrote is never looked at.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from ..session import fresh_path


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, as a URI that executors can open."""
    path = fresh_path(spark, label)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Writer:
    """A file that appears under its final name only when it is closed without an error."""

    def __init__(self, folder: str, name: str):
        self.system, place = _split(folder)
        self.system.create_dir(place, recursive=True)
        tag = uuid.uuid4().hex[:12]
        stem, dot, ending = name.partition(".")
        final = f"{stem}-{tag}{dot}{ending}"
        self.uri = f"{folder.rstrip('/')}/{final}"
        self._final, self._open = f"{place}/{final}", f"{place}/.{final}.open"
        self.stream = self.system.open_output_stream(self._open)

    def write(self, data) -> None:
        self.stream.write(data)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.stream.close()
        if kind is None:
            self.system.move(self._open, self._final)
        else:
            self.system.delete_file(self._open)


def reader(uri: str):
    """The file as a stream that can seek."""
    system, place = _split(uri)
    return system.open_input_file(place)


def drop(spark: SparkSession, uri: str) -> None:
    """Remove a folder of this package's own that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(uri)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
