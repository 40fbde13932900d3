"""Registry of queries and helpers to state the same answer in SQL."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import BASE, VIEWS, Tables, inputs_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The year and day the dated queries ask for; the tables run from 1995 to 2001.
FY = 2542
FY_FROM, FY_TO = "DATE '1998-10-01'", "DATE '1999-09-30'"
AS_OF = dt.date(2001, 7, 15)
AS_OF_SQL = "DATE '2001-07-15'"


def present(df: DataFrame) -> DataFrame:
    """Plain output types: decimals as double, dates and times as text, arrays as joined text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string").alias(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",").alias(f.name)
        out.append(c)
    return df.select(*out)


def _needed(text: str) -> list[str]:
    """The domain tables a statement uses, inputs first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in inputs_of(name):
            if inner not in BASE:
                visit(inner)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            visit(name)
    return order


def with_tables(sql: str) -> str:
    """The statement with the domain tables it uses declared in front of it."""
    ctes = []
    for name in _needed(sql):
        text = VIEWS[name]
        for inner in inputs_of(name):
            text = text.replace("{" + inner + "}", inner)
        ctes.append(f"{name} AS ({re.sub(r'STRING', 'VARCHAR', text)})")
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes + [body[5:]]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, folder: str) -> Tables:
    """One set of views per session and folder, so that a view is analysed once and not per query."""
    return Tables(spark, folder)


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables`; its frame is returned in plain types."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: present(fn(_tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return add


# --- pieces of SQL --------------------------------------------------------------------------

ERR = "(error_code IS NOT NULL AND error_code <> '')"
OK = "(error_code IS NULL OR error_code = '')"
ERR_DASH = "(error_code IS NOT NULL AND error_code NOT IN ('', '-'))"
ERR_VIEW = "(error_code IS NOT NULL AND error_code <> '-')"
YM = "strftime(dateadm, '%Y-%m')"
IS_IP = "(an IS NOT NULL AND an <> '')"
GAP = "(coalesce(claim_drg, 0) - coalesce(paid, 0))"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def s(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS DOUBLE)"


def n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def sw(cond: str, x: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN {x} END), 0) AS DOUBLE)"


def hu(x: str, dp: int = 2) -> str:
    """Round halves away from zero as the decimal text of the number reads."""
    return f"round(({x}) + CASE WHEN ({x}) < 0 THEN -1e-9 ELSE 1e-9 END, {dp})"


def rt(a: str, b: str, dp: int = 2, scale: int = 100) -> str:
    return f"CASE WHEN {d(b)} > 0 THEN {hu(f'{d(a)} / {d(b)} * {scale}', dp)} ELSE 0.0 END"


def rtn(a: str, b: str, dp: int = 2) -> str:
    return hu(f"{d(a)} / nullif({d(b)}, 0) * 100", dp)


def av(x: str) -> str:
    return f"(CAST(sum({x}) AS DOUBLE) / nullif(CAST(count({x}) AS DOUBLE), 0))"


def txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"
