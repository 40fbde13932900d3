"""Workbooks to tables: every sheet, and every section of a sheet, to the table it belongs to, in one scan.

Input is one row per sheet row: ``file``, ``sheet``, ``row`` and text cells ``c0..cN``.  A :class:`Section` says which
sheets and which rows of them make a table and how its cells are read.  :func:`deal` finds the table of each row and the
marker it stands under, and writes all tables side by side in one pass, partitioned by table; :func:`section` reads
one of them back with its types.  A row belongs to one table at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import COMPILED, fresh_path, held
from .ingest import Field, project_positional, section_marker


@dataclass(frozen=True)
class Section:
    """The rows of some sheets that make one table.

    A file's name holds one of ``files`` (any name, if there are none) and none of ``not_files``.  ``sheets`` are whole names; else a name has all of ``holds``, none of ``without`` and, with ``by_type``, the letters
    of the file's type.  Rows count from ``first``; with ``only_first`` that row alone.  ``cell`` is the one that
    decides whether a row is data: it matches ``pattern``, and holds none of ``no_words``.  ``kind`` is the data type
    of the whole sheet; without it the marker above a row says it.
    """

    table: str
    fields: tuple[Field, ...]
    files: tuple[str, ...] = ()
    not_files: tuple[str, ...] = ()
    sheets: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    by_type: bool = False
    first: int = 0
    only_first: bool = False
    cell: str = "c0"
    pattern: str | None = None
    no_words: tuple[str, ...] = ()
    key: str | None = None
    kind: str | None = None

    def _sheet(self, file_type: Column) -> Column:
        if self.sheets:
            return F.col("sheet").isin(*self.sheets)
        ok = F.lit(True)
        for word in self.holds:
            ok = ok & F.contains("sheet", F.lit(word))
        for word in self.without:
            ok = ok & ~F.contains("sheet", F.lit(word))
        return ok & F.contains(F.col("sheet"), file_type) if self.by_type else ok

    def rows(self, file_type: Column) -> Column:
        """Whether a row of the input belongs to this table."""
        cell = F.coalesce(F.col(self.cell), F.lit(""))
        ok = F.lit(not self.files)
        for word in self.files:
            ok = ok | F.contains("file", F.lit(word))
        for word in self.not_files:
            ok = ok & ~F.contains("file", F.lit(word))
        ok = ok & self._sheet(file_type) & (F.col("row") == self.first if self.only_first else F.col("row") >= self.first)
        if self.pattern:
            ok = ok & cell.rlike(self.pattern)
        for word in self.no_words:
            ok = ok & ~F.contains(F.lower(cell), F.lit(word))
        return ok


def file_type(file: str = "file") -> Column:
    """Letters of inpatient or outpatient files."""
    return F.when(F.contains(F.upper(F.col(file)), F.lit("_IP")), "IP").otherwise("OP")


def markers(marked: DataFrame, keys: Sequence[str] = ("file", "sheet")) -> DataFrame:
    """One small row for each sheet that has markers: its keys and ``_marks``, the markers by row."""
    each = marked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("row", section_marker(F.col("c0")).alias("kind")).alias("m")).where("m.kind IS NOT NULL")
    return each.groupBy(*[f"_{k}" for k in keys], F.hash(*[f"_{k}" for k in keys]).alias("_")).agg(F.sort_array(F.collect_list("m")).alias("_marks")).drop("_")


def below(rows: DataFrame, of_sheet: DataFrame, default: str = "normal", keys: Sequence[str] = ("file", "sheet")) -> DataFrame:
    """Add ``data_type``: the last of its sheet's :func:`markers` above each row."""
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    above = F.try_element_at(F.filter("_marks", lambda m: m["row"] < F.col("row")), F.lit(-1))
    return rows.join(of_sheet, on, "left").withColumn("data_type", F.coalesce(above["kind"], F.lit(default))).drop("_marks", *[f"_{k}" for k in keys])


def under_markers(rows: DataFrame, marked: DataFrame, default: str = "normal", keys: Sequence[str] = ("file", "sheet")) -> DataFrame:
    """Add ``data_type``: the last marker above each row in its sheet.

    A sheet has a handful of markers, so they are one small row a sheet, and rows are not sorted for it.
    """
    return below(rows, markers(marked, keys), default, keys)


#: A task may write a few tables side by side, each with a row group in memory.
GROUP_BYTES, WRITERS = 16 << 20, 32


def deal(raw: DataFrame, sections: Sequence[Section], path: str) -> None:
    """Write the rows of all sections in one pass, a folder for each table.

    The markers are written first, so that their size is known before the join: as long as they are few they go to
    the rows.  A task writes its tables side by side.  So rows are neither shuffled nor sorted.
    """
    kind = file_type()
    table, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in reversed(sections):
        mine = s.rows(kind)
        table, given = F.when(mine, s.table).otherwise(table), F.when(mine, s.kind).otherwise(given)
    if len({s.table for s in sections}) != len(sections):
        raise ValueError("every section needs a table of its own")
    spark, marks = raw.sparkSession, fresh_path(raw.sparkSession, "markers")
    of_sheet = markers(raw)
    rows = raw.withColumns({"table": table, "_given": given}).where("table IS NOT NULL")
    with held(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(WRITERS), **COMPILED}):
        of_sheet.write.parquet(marks)
        rows = below(rows, spark.read.schema(of_sheet.schema).parquet(marks)).withColumn("data_type", F.coalesce("_given", "data_type")).drop("_given")
        rows.write.option("parquet.block.size", GROUP_BYTES).partitionBy("table").parquet(path)


def section(spark: SparkSession, path: str, s: Section, raw_schema) -> DataFrame:
    """One table of :func:`deal`, its cells read; ``row_number`` counts from the first row of data where it is skipped to."""
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in raw_schema] + ["data_type string", "`table` string"]
    rows = spark.read.schema(", ".join(schema)).parquet(path).where(F.col("table") == s.table)
    out = project_positional(rows.withColumn("row_number", F.col("row") - (0 if s.kind else s.first)), s.fields, ("file", "data_type", "row_number"))
    if s.key:
        out = out.where(F.upper(s.key) != "TRAN_ID")  # nor is it null
    return out


def patient_types(rows: DataFrame) -> DataFrame:
    """The words for inpatients and outpatients as codes."""
    return rows.withColumn("patient_type", F.when(F.col("patient_type") == "ผู้ป่วยใน", "inpatient").otherwise("outpatient"))

