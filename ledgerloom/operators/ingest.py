"""Raw spreadsheet rows to typed rows.

Input is one row per sheet row: ``file``, ``sheet``, ``row`` and text cells ``c0..cN``.  Layouts are
data (:class:`Field` lists), so every step is a select, a filter or one aggregate per file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import num, num0, whole0
from ..functions.text import blank_to_null, clean_cell, claim_file_parts, drug_name_parts, prefix, statement_file_parts, to_ts
from .windows import fill_down

# Words that mark a header row.
HEADER_WORDS = ["HN", "PID", "TRAN_ID", "AN", "REP No.", "REP"]
# Header row used when none is found, and the one of referral files.
DEFAULT_HEADER, REFERRAL_HEADER = 5, 7
# Texts that open a section of a statement.
SECTION_MARKERS = {"ข้อมูลปกติ": "normal", "ข้อมูลอุทธรณ์": "appeal", "ผู้พิการ D1": "disabled_d1"}
# Text of a total row.
TOTAL_WORD = "รวม"


@dataclass(frozen=True)
class Field:
    """One output column: where it comes from and how its cell is read.

    ``width`` cuts text.  A column of kind ``id`` is a key and is never cut: two keys must not become one.
    """

    name: str
    source: int | str
    kind: str = "text"  # text, plain, id, number, number0, rate0, whole0, int0, timestamp, day
    width: int | None = None

    def read(self, cell: Column) -> Column:
        if self.kind == "number":
            return num(clean_cell(cell))
        if self.kind == "number0":
            return num0(clean_cell(cell))
        if self.kind == "rate0":
            return F.coalesce(num(clean_cell(cell), "decimal(15,4)"), F.lit(0).cast("decimal(15,4)"))
        if self.kind == "whole0":
            return whole0(cell)
        if self.kind == "int0":  # as above, but a number with commas is unreadable
            # The cast raises inside on every cell it cannot read.
            bare = F.when(~F.contains(cell, F.lit(",")), F.trim(cell))
            return F.coalesce(bare.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
        if self.kind == "day":  # a date with a time of day is unreadable
            return F.when(F.trim(cell).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), to_ts(cell)).cast("date")
        if self.kind == "plain":
            text = F.trim(cell)
            text = F.when(~F.lower(text).isin("", "-", "nan"), text)
            return F.left(text, F.lit(self.width)) if self.width else text
        if self.kind == "timestamp":
            return to_ts(clean_cell(cell))
        if self.kind == "id":
            return clean_cell(cell, is_id=True)
        return clean_cell(cell, self.width)


def over_width(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Flag rows with a key longer than its column, for the import's report: ``too_long`` names the keys."""
    wide = [F.when(F.length(f.name) > f.width, F.lit(f.name)) for f in fields if f.kind == "id" and f.width]
    return rows.withColumn("too_long", F.concat_ws(",", *wide) if wide else F.lit(""))


def cells(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c[:1] == "c" and c[1:].isdigit()]


def parse_filename(df: DataFrame, col: str = "filename", kind: str = "claim") -> DataFrame:
    return df.withColumns(claim_file_parts(col) if kind == "claim" else statement_file_parts(col))


def detect_header(raw: DataFrame, words: Sequence[str] = tuple(HEADER_WORDS), max_rows: int = 10, min_hits: int = 2) -> DataFrame:
    """Header row per file: the first of the leading rows with enough header words."""
    text = F.concat_ws(" ", *cells(raw))
    hits = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    found = F.min(F.when((F.col("row") < max_rows) & (hits >= min_hits), F.col("row")))
    referral = claim_file_parts("file")["file_type"] == "ORF"
    at = F.when(F.first(referral), REFERRAL_HEADER).otherwise(F.coalesce(found, F.lit(DEFAULT_HEADER)))
    return raw.groupBy("file").agg(at.cast("int").alias("header_row"))


def project_positional(raw: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ("file", "row")) -> DataFrame:
    """Columns by cell index; an index the sheet does not have gives null."""
    have = set(raw.columns)
    out = []
    for f in fields:
        name = f"c{f.source}"
        out.append(f.read(F.col(name) if name in have else F.lit(None).cast("string")).alias(f.name))
    return raw.select(*keep, *out)


def project_named(raw: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ("file", "row")) -> DataFrame:
    """Columns by header name, for frames whose columns already carry the sheet's header."""
    have = set(raw.columns)
    out = [f.read(F.col(f"`{f.source}`")).alias(f.name) for f in fields if f.source in have]
    return raw.select(*keep, *out)


def drop_junk(df: DataFrame, key: str, first: str | None = None, header: str = "TRAN_ID", total_word: str = TOTAL_WORD) -> DataFrame:
    """Rows with a real key: not null, not the repeated header, not a total row."""
    k = F.col(key)
    ok = k.isNotNull() & (F.trim(k) != "") & (F.upper(F.trim(k)) != header) & ~F.contains(k, F.lit(total_word))
    if first:
        ok = ok & F.col(first).isNotNull() & (F.trim(F.col(first)) != "")
    return df.filter(ok)


def section_marker(cell: Column) -> Column:
    out = F.lit(None).cast("string")
    for text, name in reversed(list(SECTION_MARKERS.items())):
        out = F.when(F.contains(cell, F.lit(text)), name).otherwise(out)
    return out


def tag_sections(raw: DataFrame, cell: str = "c0") -> DataFrame:
    """Section of each row: the last marker above it in the same file, ``normal`` before any."""
    marker = section_marker(F.col(cell))
    tagged = fill_down(raw, "file", "row", marker, "data_type", default="normal")
    return tagged.filter(section_marker(F.col(cell)).isNull())


def report_header(raw: DataFrame) -> DataFrame:
    """Report date, hospital, province and document number from the fixed rows of a statement."""
    c0 = F.col("c0")

    def at(row: int, pattern: str, group: int) -> Column:
        return F.max(F.when(F.col("row") == row, blank_to_null(F.trim(F.regexp_extract(c0, pattern, group)))))

    day = at(1, r"(\d{2}/\d{2}/\d{4})\s+เวลา\s+(\d{2}:\d{2})", 1)
    clock = at(1, r"(\d{2}/\d{2}/\d{4})\s+เวลา\s+(\d{2}:\d{2})", 2)
    return (
        raw.filter(F.col("row") <= 6)
        .groupBy("file")
        .agg(
            F.concat_ws(" ", day, clock).alias("_at"),
            at(3, r"โรงพยาบาล\s+(\d+)\s+(.*)", 1).alias("hospital_code"),
            at(3, r"โรงพยาบาล\s+(\d+)\s+(.*)", 2).alias("hospital_name"),
            at(4, r"จังหวัด\s+(\d+)\s+(.*)", 1).alias("province_code"),
            at(4, r"จังหวัด\s+(\d+)\s+(.*)", 2).alias("province_name"),
            at(6, r"เลขที่เอกสาร\s+(.+)", 1).alias("document_no"),
        )
        .withColumn("report_date", F.try_to_timestamp("_at", F.lit("dd/MM/yyyy HH:mm")))
        .drop("_at")
    )


def receivable_net(df: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.withColumn("net_receivable", (z("total_paid") - z("salary_deduction") - z("adjrw_paid_deduction")).cast("decimal(15,2)"))


# Transfer record fields and the columns they fill (first non-blank wins).
TRANSFER_NAMES = {
    "run_date": ["runDt"],
    "posting_date": ["postingDate"],
    "ref_doc_no": ["refDocNo"],
    "vendor_no": ["vndrNo"],
    "fund_name": ["fundName"],
    "fund_group": ["fundGroup"],
    "fund_group_desc": ["fundGroupDescr"],
    "fund_desc": ["fundDescr"],
    "efund_desc": ["efundDesc"],
    "mou_grp_code": ["mouGrpCode"],
    "amount": ["amount"],
    "wait_amount": ["wait"],
    "debt_amount": ["debt"],
    "bond_amount": ["bond"],
    "total_amount": ["total"],
    "bank_name": ["bankNm"],
    "payment_status": ["pmntStts"],
    "batch_no": ["batchNo"],
    "moph_id": ["mophId"],
    "moph_desc": ["mophDesc"],
    "budget_source": ["budgetSource"],
}
_AMOUNTS = ("amount", "wait_amount", "debt_amount", "bond_amount", "total_amount")


def normalise_transfers(df: DataFrame, names: Mapping[str, Sequence[str]] = TRANSFER_NAMES) -> DataFrame:
    """API records to transfer columns: renamed, blanks to null, amounts unreadable to 0."""
    out = []
    for name, sources in names.items():
        given = [blank_to_null(F.trim(F.col(s).cast("string"))) for s in (*sources, name) if s in df.columns]
        if not given:
            continue
        value = F.coalesce(*given) if len(given) > 1 else given[0]
        out.append((num0(value) if name in _AMOUNTS else value).alias(name))
    return df.select(*out)


def parse_drug_names(df: DataFrame, col: str = "fsn") -> DataFrame:
    return df.withColumns(drug_name_parts(col))


def parse_procedures(lines: DataFrame, col: str = "value") -> DataFrame:
    """``CODE DESCRIPTION`` lines; three and four digit codes get their dot."""
    text = F.trim(F.col(col))
    pattern = r"^(\d{2,4}\.?\d*)\s+(.+)$"
    code = F.regexp_extract(text, pattern, 1)
    dotted = F.when(~F.contains(code, F.lit(".")) & F.length(code).isin(3, 4), F.concat(F.left(code, F.lit(2)), F.lit("."), F.substring(code, 3, 10))).otherwise(code)
    return lines.filter(text.rlike(pattern)).select(
        dotted.alias("code"), prefix(F.regexp_extract(text, pattern, 2), 500).alias("description")
    )


def diagnoses(df: DataFrame, code: str = "code", kind: str = "kind", text: str = "description") -> DataFrame:
    """Diagnosis rows without headings and blank codes; a description is cut, a code is a key and is not."""
    ok = F.col(code).isNotNull() & (F.trim(F.col(code)) != "") & (F.col(kind) != "HEADING")
    return df.filter(ok).select(F.trim(F.col(code)).alias("code"), prefix(text, 500).alias("description"))


def import_outcomes(raw: DataFrame, key: str = "c1", amount: str = "c7") -> DataFrame:
    """All files in one job: rows, readable rows and the status of each file."""
    real = drop_junk(raw, key)
    bad = clean_cell(F.col(amount)).isNotNull() & num(clean_cell(F.col(amount))).isNull()
    out = real.groupBy("file").agg(F.count("*").alias("total"), F.count_if(~bad).alias("imported"))
    failed = F.col("total") - F.col("imported")
    status = F.when(F.col("imported") == 0, "failed").when(failed > 0, "partial").otherwise("completed")
    return out.withColumns({"failed": failed, "status": status})
