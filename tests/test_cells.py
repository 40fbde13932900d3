"""Hand-made cells and rows that the tables cannot show."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators import ingest


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_cells(spark):
    clean = lambda **kw: (lambda c: text.clean_cell(c, **kw))
    for junk in ("", "-", "N/A", "n/a", " ", "\n \n", "nan", None):
        assert one(spark, junk, clean()) is None
    assert one(spark, " 123.0 ", clean(is_id=True)) == "123"
    assert one(spark, "123.0", clean()) == "123.0"
    assert one(spark, "a\nb", clean()) == "a"
    assert one(spark, "\n  \n b \r\n c", clean()) == "b"
    assert one(spark, "x" * 40, clean(width=15)) == "x" * 15


def test_numbers(spark):
    assert one(spark, "1,234.50", money.num) == D("1234.50")
    for junk in ("-", "abc", None, ""):
        assert one(spark, junk, money.num) is None
        assert one(spark, junk, money.num0) == 0
    assert one(spark, "12.9", money.whole0) == 12


def test_dates(spark):
    assert one(spark, "22/01/2025 10:20:30", text.to_ts) == dt.datetime(2025, 1, 22, 10, 20, 30)
    assert one(spark, "22/01/2025", text.to_ts) == dt.datetime(2025, 1, 22)
    for junk in ("31/02/2025", "-", "", None):
        assert one(spark, junk, text.to_ts) is None
    assert one(spark, "22/1/2568", text.slash_date) == dt.date(2025, 1, 22)
    assert one(spark, "22/01/2025", text.slash_date) == dt.date(2025, 1, 22)
    assert one(spark, "22-01-2025", text.slash_date) is None
    assert one(spark, 20251201, text.compact_date, "int") == dt.date(2025, 12, 1)


def test_codes(spark):
    assert one(spark, '="32045"', text.unwrap_formula) == "32045"
    assert one(spark, "32045", text.unwrap_formula) == "32045"
    assert [one(spark, v, text.digits_key) for v in ("0000000000", "0000010670", "10670", "x")] == [0, 10670, 10670, None]
    assert [one(spark, v, text.strip0) for v in ("0000000000", "0000010670", "10670")] == ["", "10670", "10670"]
    assert one(spark, "123456", lambda c: text.pad(c, 5)) == "123456"
    assert one(spark, "22/01/2568", text.posting_key) == "25680122"
    assert text.like_escape("50%_\\") == "50\\%\\_\\\\"


def test_masking(spark):
    masked = one(spark, "Login failed with Password=secret123 and token: abc; postgresql://u:p@h/db", text.mask_text)
    assert "secret123" not in masked and "abc" not in masked and "u:p" not in masked
    row = spark.createDataFrame([({"User_Password": "x", "page": "1", "SESSION_ID": "z"},)], "m map<string,string>")
    assert row.select(text.redact_params("m")).first()[0] == {"User_Password": "***REDACTED***", "page": "1", "SESSION_ID": "***REDACTED***"}


def test_sizes(spark):
    assert [one(spark, n, money.human_size, "bigint") for n in (999, 1200, 3_400_000, 5_000_000_000)] == ["999 Bytes", "1.2 kB", "3.4 MB", "5.0 GB"]


def test_zero_denominators(spark):
    row = spark.createDataFrame([(D("5.00"), D("0.00"), None)], "a decimal(10,2), b decimal(10,2), c decimal(10,2)")
    got = row.select(money.ratio(F.col("a"), F.col("b")), money.ratio(F.col("a"), F.col("c")), money.ratio_or_null(F.col("a"), F.col("b")), money.change(F.col("a"), F.col("b"))).first()
    assert list(got) == [0.0, 0.0, None, 0.0]


def test_error_spellings(spark):
    rows = spark.createDataFrame([(None,), ("",), ("-",), ("0",), ("998",)], "error_code string")
    count = lambda **kw: rows.filter(money.is_error(**kw)).count()
    assert count() == 3
    assert count(exclude=("-",)) == 2
    assert count(exclude=("-", "0")) == 1
    assert count(blank_counts=True, exclude=("-",)) == 3
    assert rows.filter(~money.is_error()).count() == 2


def test_drug_names(spark):
    df = spark.createDataFrame([("VIVACOR (10MG) (IPR PHARMACEUTICALS) (rosuvastatin 10 mg) film-coated tablet, 1 tablet (TPU)",), ("",)], "fsn string")
    got = ingest.parse_drug_names(df).first().asDict()
    assert got["generic_name"] == "rosuvastatin" and got["strength"] == "10 mg" and got["trade_name"] == "VIVACOR"
    assert got["dosage_form"] == "film-coated tablet" and got["package_size"] == "1" and got["package_unit"] == "tablet"


def raw(spark, rows):
    return spark.createDataFrame(rows, "file string, row int, c0 string, c1 string, c2 string")


def test_header_detection(spark):
    rows = [("a", 6, "x", "HN", "PID"), ("a", 8, "TRAN_ID", "HN", "AN"), ("b", 2, "x", "y", "z"), ("eclaim_1_ORF_25680101_1.xls", 2, "HN", "PID", "AN"), ("c", 12, "HN", "PID", "AN")]
    got = {r.file: r.header_row for r in ingest.detect_header(raw(spark, rows)).collect()}
    assert got == {"a": 6, "b": 5, "eclaim_1_ORF_25680101_1.xls": 7, "c": 5}


def test_sections(spark):
    marks = ["x", "ข้อมูลปกติ", "1", "2", "ข้อมูลอุทธรณ์", "3", "ผู้พิการ D1", "4"]
    rows = [("f", i, m, None, None) for i, m in enumerate(marks)] + [("g", 0, "5", None, None)]
    got = {(r.file, r.c0): r.data_type for r in ingest.tag_sections(raw(spark, rows)).collect()}
    assert got == {("f", "x"): "normal", ("f", "1"): "normal", ("f", "2"): "normal", ("f", "3"): "appeal", ("f", "4"): "disabled_d1", ("g", "5"): "normal"}


def test_junk_rows(spark):
    rows = [("f", i, "1", k, None) for i, k in enumerate(["77", "tran_id ", None, "", "รวม 3"])]
    assert [r.c1 for r in ingest.drop_junk(raw(spark, rows), "c1", first="c0").collect()] == ["77"]


def test_named_layouts_fill_missing_columns(spark):
    df = spark.createDataFrame([("f", 1, "9.0")], "file string, row int, `REP No.` string")
    out = ingest.project_named(df, [ingest.Field("rep_no", "REP No.", "id"), ingest.Field("hn", "HN")])
    assert out.columns == ["file", "row", "rep_no"] and out.first().rep_no == "9"


def test_procedures(spark):
    lines = spark.createDataFrame([("0001 Therapeutic ultrasound",), ("012 Implant",), ("99.99 Other",), ("no code",), ("",)], "value string")
    assert [tuple(r) for r in ingest.parse_procedures(lines).collect()] == [("00.01", "Therapeutic ultrasound"), ("01.2", "Implant"), ("99.99", "Other")]
