"""Import runs over hand-made workbooks: one unreadable file, lost jobs, files that come again."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import Field
from ledgerloom.operators.sheets import Section, deal, section, under_markers
from ledgerloom.plans.importing import Warehouse
from ledgerloom.session import fresh_path, held
from ledgerloom.sources.layouts import CLAIM_SHEETS, STATEMENT_SHEETS
from ledgerloom.sources.manifests import Manifests

RAW = "file string, sheet string, row int, c0 string, c1 string, c2 string, c3 string"
MAIN = (Field("tran_id", 1, "id", 15), Field("amount", 2, "number"), Field("at", 3, "timestamp"))
SECTIONS = [
    Section("claims", MAIN, sheets=("data",), first=2, cell="c1", pattern=r"\S", key="tran_id"),
    Section("drug", (Field("tran_id", 1, "plain", 20), Field("amount", 2, "number0")), sheets=("Data Drug",), first=1, cell="c1", pattern=r"\S", key="tran_id"),
]


def book(name, rows, drugs=()):
    out = [(name, "data", 0, "title", None, None, None), (name, "data", 1, "NO", "TRAN_ID", "AMOUNT", "AT")]
    out += [(name, "data", 2 + i, str(i), t, a, d) for i, (t, a, d) in enumerate(rows)]
    return out + [(name, "Data Drug", 1 + i, "x", t, a, None) for i, (t, a) in enumerate(drugs)]


@pytest.fixture
def house(spark):
    return Warehouse(spark, fresh_path(spark, "house"), SECTIONS)


def status(house):
    return {r.file: (r.status, r.total, r.imported, r.failed, r.drug_rows) for r in house.ledger().collect()}


def claims(house):
    return sorted((r.file, r.tran_id, float(r.amount) if r.amount is not None else None) for r in house.table("claims").collect())


GOOD = book("a.xls", [("1", "1,000.50", "01/02/2024"), ("2.0", "-", None), ("1", "7", "01/02/2024 10:00:00"), ("TRAN_ID", "AMOUNT", None), (" ", "3", None)], [("1", "5"), ("1", "-"), ("-", "9")])
HALF = book("b.xls", [("5", "abc", "01/02/2024"), ("6", "2", "31/02/2024"), ("7", "3", "")])
BAD = book("c.xls", [("8", "x", None)])


def test_one_unreadable_file_leaves_the_others_loaded(spark, house):
    offered = spark.createDataFrame([("a.xls",), ("gone.xls",)], "file string")
    house.load(spark.createDataFrame(GOOD + HALF + BAD, RAW), offered)
    assert status(house) == {"a.xls": ("completed", 3, 3, 0, 3), "b.xls": ("partial", 3, 1, 2, 0), "c.xls": ("failed", 1, 0, 1, 0), "gone.xls": ("failed", 0, 0, 0, 0)}
    assert claims(house) == [("a.xls", "1", 7.0), ("a.xls", "2", None), ("b.xls", "5", None), ("b.xls", "6", 2.0), ("b.xls", "7", 3.0)]
    assert sorted((r.tran_id, float(r.amount), r.row_number) for r in house.table("drug").collect()) == [("1", 0.0, 1), ("1", 5.0, 0)]


def test_a_file_that_comes_again_replaces_its_rows(spark, house):
    house.load(spark.createDataFrame(GOOD + HALF, RAW))
    house.load(spark.createDataFrame(book("b.xls", [("9", "4", None)]) + book("a.xls", [("1", "unreadable", None)]), RAW))
    now = status(house)
    assert now["a.xls"][0] == "failed" and now["b.xls"] == ("completed", 1, 1, 0, 0)
    # a.xls failed this time, so its earlier rows stay.
    assert claims(house) == [("a.xls", "1", 7.0), ("a.xls", "2", None), ("b.xls", "9", 4.0)]
    assert house.history().count() == 4 and house.table("drug").count() == 2


def test_a_job_killed_between_tables_leaves_the_old_state(spark, house, monkeypatch):
    house.load(spark.createDataFrame(GOOD, RAW))
    before = claims(house), status(house), house.table("drug").count()
    import ledgerloom.plans.importing as importing

    real, calls = importing.sheets.section, []

    def killed(*args):
        calls.append(args)
        if len(calls) > 1:
            raise OSError("killed")
        return real(*args)

    for place, name, fail in ((importing.sheets, "section", killed), (Manifests, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))):
        with monkeypatch.context() as m:
            m.setattr(place, name, fail)
            with pytest.raises(OSError):
                house.load(spark.createDataFrame(HALF, RAW))
        assert (claims(house), status(house), house.table("drug").count()) == before
    house.load(spark.createDataFrame(HALF, RAW))
    assert len(claims(house)) == 5


def test_nothing_to_load(spark, house):
    assert house.history() is None
    house.load(spark.createDataFrame([], RAW))
    assert status(house) == {} and claims(house) == []


def test_sections_stand_under_their_last_marker(spark):
    rows = [("f", "s", 1, "x"), ("f", "s", 3, "ข้อมูลอุทธรณ์"), ("f", "s", 4, "x"), ("f", "s", 9, "ผู้พิการ D1"), ("f", "s", 10, "x"), ("f", "t", 20, "x"), ("g", "s", 5, "x"), ("g", None, 5, "x")]
    df = spark.createDataFrame(rows, "file string, sheet string, row int, c0 string")
    got = {(r.file, r.sheet, r.row): r.data_type for r in under_markers(df, df).collect()}
    assert got[("f", "s", 1)] == "normal" and got[("f", "s", 4)] == "appeal" and got[("f", "s", 10)] == "disabled_d1"
    assert got[("f", "t", 20)] == got[("g", "s", 5)] == got[("g", None, 5)] == "normal" and len(got) == len(rows)


def test_statement_sections(spark):
    """Sheets by words in their names and the file's type; totals and headings left out."""
    cells = [f"c{k}" for k in range(42)]
    schema = "file string, sheet string, row int, " + ", ".join(f"{c} string" for c in cells)

    def row(sheet, at, *values, file="STM_1_IPUCS256801_1.xls"):
        return (file, sheet, at, *values, *[None] * (42 - len(values)))

    rows = [
        row("รายงานพึงรับ IP", 8, "1) ข้อมูลอุทธรณ์"), row("รายงานพึงรับ IP", 9, "ผู้ป่วยใน", "12.0", "1,234", "0.1234", "1,000.00"), row("รายงานพึงรับ IP", 10, "รวม", "1"),
        row("รายงานพึงรับ ผู้พิการ", 9, "ผู้ป่วยใน", "1"),
        row("รายงานสรุป IP", 14, "6801_IP_1"), row("รายงานสรุป IP", 15, "6801_IP_01", "1", "R1", "C", "3"), row("รายงานสรุป IP", 16, "รวม 6801_IP_01"), row("รายงานสรุป OP", 15, "6801_OP_01"),
        row("รายละเอียด ข้อมูลปกติ IP", 14, "680101", "1", "77.0"), row("รายละเอียด ข้อมูลปกติ IP", 15, "12 รวม", "1", "78"), row("รายละเอียด ข้อมูลปกติ IP", 16, "680101", "1", None),
        row("รายละเอียด อุทธรณ์ IP", 13, "680101", "1", "79"), row("รายละเอียด ผู้พิการ D1", 14, "680101", "2", "80"),
    ]
    raw = spark.createDataFrame(rows, schema)
    path = fresh_path(spark, "statement")
    deal(raw, STATEMENT_SHEETS, path)
    read = {s.table: section(spark, path, s, raw.schema).collect() for s in STATEMENT_SHEETS}
    [r] = read["receivable"]
    assert (r.data_type, r.rep_count, r.patient_count, float(r.total_adjrw), float(r.total_paid), float(r.salary_deduction)) == ("appeal", 12, 1234, 0.1234, 1000.0, 0.0)
    assert [(r.period, r.rep_no, r.total_passed) for r in read["rep_summary"]] == [("6801_IP_01", "R1", 3)]
    assert [(r.tran_id, r.data_type, r.row_number) for r in read["claims_normal"]] == [("77", "normal", 14)]
    assert read["claims_appeal"] == [] and [r.tran_id for r in read["claims_disabled"]] == ["80"]
    with pytest.raises(ValueError):
        deal(raw, [STATEMENT_SHEETS[0]] * 2, path)
    assert spark.read.parquet(path).agg(F.countDistinct("table")).first()[0] == 4


def test_dealing_neither_shuffles_nor_sorts_rows(spark, monkeypatch):
    """Few markers go to the rows; a sheet of many rows is not one task's to sort."""
    rows = [("f.xls", "data", 2 + i, str(i), str(i), "1", None) for i in range(20)] + [("f.xls", "data", 5, "ข้อมูลอุทธรณ์", None, None, None)]
    written = []
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (written.append(self._df), real(self, *a, **k))[1])
    path = fresh_path(spark, "dealt")
    raw = spark.createDataFrame(rows, RAW)
    deal(raw, SECTIONS, path)
    plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    kinds = {r.row: r.data_type for r in spark.read.parquet(path).collect()}
    assert kinds == {2 + i: "appeal" if 2 + i > 5 else "normal" for i in range(20)}


def test_rows_of_many_cells_are_written_by_compiled_methods(spark, house, monkeypatch):
    """Whatever the session says of large methods; its own setting comes back."""
    from pyspark.sql.readwriter import DataFrameWriter

    setting, seen = "spark.sql.codegen.hugeMethodLimit", []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(setting)), real(self, *a, **k))[1])
    with held(spark, {setting: "65535"}):
        house.load(spark.createDataFrame(GOOD, RAW))
        deal(spark.createDataFrame(GOOD, RAW), SECTIONS, fresh_path(spark, "dealt"))
        assert set(seen) == {"8000"} and spark.conf.get(setting) == "65535"


def test_only_cells_of_main_tables_are_judged(spark, house, monkeypatch):
    plans = []
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df) if "/ledger/" in path else None, real(self, path, *a, **k))[1])
    house.load(spark.createDataFrame(GOOD + HALF + BAD, RAW))
    scans = [line for line in plans[0]._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "c1#" in line]
    assert scans and all("PartitionFilters: [table" in line or "(table" in line.split("PartitionFilters")[1] for line in scans)
    assert status(house)["a.xls"] == ("completed", 3, 3, 0, 3)


def test_reading_of_detail_sheets_is_small_enough_to_be_compiled(spark, capsys):
    """The JVM never compiles a method of more than 8000 bytes."""
    schema = "file string, sheet string, row int, " + ", ".join(f"c{k} string" for k in range(22))
    with held(spark, {"spark.sql.codegen.hugeMethodLimit": "65535"}):
        for s in CLAIM_SHEETS:
            if s.table in ("instrument", "deny", "zero_paid"):
                path = fresh_path(spark, "sheet")
                spark.createDataFrame([], schema + ", data_type string, `table` string").write.parquet(path)
                section(spark, path, s, spark.createDataFrame([], schema).schema).explain("codegen")
                [size] = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
                assert int(size) < 8000, s.table


def test_whole_and_plain_cells(spark):
    cells = {"12.9": 12, " 7 ": 7, "1,000": 0, ",": 0, "abc": 0, "": 0, "-": 0, None: 0, "1e3": 1000, "-2": -2, "NaN": 0}
    df = spark.createDataFrame([(k, v) for k, v in cells.items()], "c string, n bigint")
    assert df.where(Field("x", 0, "int0").read(F.col("c")) != F.col("n")).collect() == []
    texts = {" a ": "a", "-": None, " - ": None, "NaN": None, "nan": None, "": None, "  ": None, None: None, "--": "--", "nano": "nan"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "c string, t string")
    assert df.where(~Field("x", 0, "plain", 3).read(F.col("c")).eqNullSafe(F.col("t"))).collect() == []
