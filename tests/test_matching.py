"""Reconciliation, merges and ledgers on hand-made rows."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.operators import filters, joins, merge
from ledgerloom.plans import alerts, monthly, outliers, peers, reports

DAY = dt.date(2025, 1, 2)
CLAIM = "tran_id string, rep_no string, hn string, reimb_nhso decimal(12,2), dateadm date, error_code string"
STM = "tran_id string, rep_no string, hn string, paid_after_deduction decimal(15,2), date_admit date"


def claims(spark, rows):
    return spark.createDataFrame([(k, "R", "h", D(a), DAY, None) for k, a in rows], CLAIM)


def stm(spark, rows):
    return spark.createDataFrame([(k, "R", "h", D(a), DAY) for k, a in rows], STM)


def test_tolerance_and_missing_sides(spark):
    left = claims(spark, [("a", "10.00"), ("b", "10.00"), ("c", "10.00"), ("d", "1.00"), (None, "5.00")])
    right = stm(spark, [("a", "10.00"), ("b", "10.01"), ("c", "10.99"), ("e", "1.00"), (None, "5.00")])
    got = {r.tran_id: r.status for r in joins.reconcile(left, right).collect()}
    assert got == {"a": "matched", "b": "diff_amount", "c": "diff_amount", "d": "rep_only", "e": "stm_only"}
    near = {r.tran_id: r.status for r in joins.reconcile(left, right, tol=1).collect()}
    assert near["b"] == near["c"] == "matched"


def test_copies_are_kept(spark):
    left, right = claims(spark, [("a", "1.00"), ("a", "1.00"), ("x", "1.00")]), stm(spark, [("a", "1.00"), ("a", "2.00"), ("y", "1.00"), ("y", "1.00")])
    rows = joins.reconcile(left, right)
    plain = left.join(right, "tran_id", "full_outer")
    assert rows.count() == plain.count() == 7


def test_match_counts_add_up(spark, tables):
    rows = joins.reconcile(tables.claims, tables.stm)
    c = joins.match_counts(rows).first()
    assert c.total == c.matched + c.rep_only + c.stm_only + c.diff_amount == rows.count()


def test_exists_counts_with_copies(spark):
    left = claims(spark, [("a", "1.00")] * 5 + [("b", "9.00")])
    right = stm(spark, [("a", "1.00"), ("a", "50.00")] * 3)
    row = joins.exists_counts(left, right).first()
    assert (row.total, row.matched, row.diff_amount) == (6, 5, 5)


def test_exists_counts_against_all_pairs(spark):
    import random

    rnd = random.Random(5)
    amount = lambda: f"{rnd.randrange(-300, 900) / 100:.2f}"
    left = [(rnd.choice("aaab"), amount()) for _ in range(300)] + [("z", "1.00")]
    right = [(rnd.choice("aaabc"), amount()) for _ in range(25)]
    row = joins.exists_counts(claims(spark, left), stm(spark, right)).first()
    near = sum(any(k == q and abs(D(a) - D(b)) < 1 for q, b in right) for k, a in left)
    far = sum(any(k == q and abs(D(a) - D(b)) >= 1 for q, b in right) for k, a in left)
    assert (row.total, row.matched, row.diff_amount) == (301, near, far)


def test_either_code(spark):
    smt = spark.createDataFrame([("0000000000", 1), ("0000010670", 2), ("10670", 3), ("99", 4)], "vendor_no string, n int")
    dim = spark.createDataFrame([("10670", "A"), ("0000010670", "B")], "hcode5 string, name string")
    got = sorted((r.vendor_no, r.name) for r in joins.by_either_code(smt, dim, "vendor_no", "hcode5").select("vendor_no", "name").collect() if r.name)
    assert got == [("0000010670", "A"), ("0000010670", "B"), ("10670", "A")]
    assert joins.by_either_code(smt, dim, "vendor_no", "hcode5").count() == 5


def test_prefix_join(spark):
    df = spark.createDataFrame([("E1165",), ("E1",), ("Z",)], "dx string")
    dim = spark.createDataFrame([("E11",), ("E",), ("E1165",)], "code string")
    assert sorted((r.dx, r.code) for r in joins.prefix_join(df, dim, "dx", "code").collect()) == [("E1", "E"), ("E1165", "E"), ("E1165", "E11"), ("E1165", "E1165")]


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, f int, v string")
    batch = spark.createDataFrame([("b", 1, "new"), ("b", 1, "newest"), ("c", 1, "new")], "k string, f int, v string")
    once = merge.upsert(target, batch, ["k", "f"], [F.desc("v")])
    twice = merge.upsert(once, batch, ["k", "f"], [F.desc("v")])
    want = [("a", 1, "old"), ("b", 1, "newest"), ("c", 1, "new")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_partial_update_and_delta(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    delta = spark.createDataFrame([("b", 5, "z"), ("c", 6, "w")], "k string, n int, v string")
    out = merge.apply_delta(target, delta, "k", ["n"], [F.desc("n")])
    assert sorted(map(tuple, out.collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, "w")]
    counts = {r.outcome: r["count"] for r in merge.delta_counts(target, delta, "k").collect()}
    assert counts == {"updated": 1, "imported": 1}


def test_update_to_null_is_an_update(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    batch = spark.createDataFrame([("a", None)], "k string, n int")
    assert merge.upsert_columns(target, batch, ["k"], ["n"], [F.desc("n")]).first().n is None


def test_replace_file_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "file_id int, v string")
    rows = spark.createDataFrame([(2, "c"), (2, "d")], "file_id int, v string")
    once = merge.replace_file(table, rows)
    assert sorted(map(tuple, merge.replace_file(once, rows).collect())) == [(1, "a"), (2, "c"), (2, "d")]


def test_waterfall_keeps_every_claim_once(spark):
    c = spark.createDataFrame([("1", "h1", "AN1", "p1", DAY), ("2", "hx", "AN2", "p1", DAY), ("3", "hx", "", "p1", DAY), ("4", None, None, None, DAY)], "tran_id string, hn string, an string, pid string, dateadm date")
    visits = spark.createDataFrame([("h1", DAY, "v1"), ("h1", DAY, "v2")], "hn string, visit_date date, vn string")
    adm = spark.createDataFrame([("AN1", "a1"), ("AN2", "a2")], "an string, vn string")
    pat = spark.createDataFrame([("p1", "h1"), ("p1", "h1")], "pid string, hn string")
    got = {r.tran_id: (r.vn, r.match_pass) for r in joins.waterfall_match(c, visits, adm, pat).collect()}
    assert got == {"1": ("v1", "hn_date"), "2": ("a2", "an"), "3": ("v1", "pid_date"), "4": (None, None)}


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("A%B2",)], "k string")
    assert filters.search(df, "a%b", ["k"]).count() == 2


def test_secure(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "hcode string")
    assert [filters.secure(df, role, "1").count() for role in ("analyst", "admin", None)] == [1, 3, 3]


def test_two_funds_share_a_group(spark):
    c = spark.createDataFrame([("IP01", DAY, D("10.00")), ("IP02", DAY, D("20.00"))], "main_fund string, dateadm date, reimb_nhso decimal(12,2)")
    smt = spark.createDataFrame([("กองทุนผู้ป่วยใน", "25680102", D("25.00")), ("other", "25680102", D("5.00"))], "fund_group_desc string, posting_date string, total_amount decimal(15,2)")
    got = {(r.rep_fund_code, r.smt_fund_name): (r.payment_amount, r.matched) for r in monthly.fund_reconciliation(c, smt).collect()}
    assert got == {("IP01", "กองทุนผู้ป่วยใน"): (D("25.00"), True), ("IP02", "กองทุนผู้ป่วยใน"): (D("25.00"), True), ("-", "other"): (D("5.00"), False)}


def test_forecast_needs_six_months(spark):
    def history(n):
        rows = [(dt.date(2025, 1 + m, 3), D("100.00"), D("90.00"), D("80.00")) for m in range(n)]
        return spark.createDataFrame(rows, "dateadm date, claim_drg decimal(12,2), reimb_nhso decimal(12,2), paid decimal(12,2)")

    assert outliers.forecast(history(5), dt.date(2025, 8, 1)).count() == 0
    out = outliers.forecast(history(7), dt.date(2025, 8, 1)).collect()
    assert [r.month for r in out] == ["2025-08", "2025-09", "2025-10", "2025-11", "2025-12", "2026-01"]
    assert {r.projected_reimb for r in out} == {90.0}
    assert [r.confidence for r in out] == [88, 81, 74, 67, 60, 53]


def test_no_alerts_without_claims(spark):
    empty = spark.createDataFrame([], "tran_id string, dateadm date, error_code string, claim_drg decimal(12,2), paid decimal(12,2), reimb_nhso decimal(12,2)")
    assert alerts.alerts(empty, DAY).count() == 0


def test_per_bed_without_beds(spark, tables):
    row = reports.per_bed(tables.claims_core, tables.offices.filter("actual_beds = 0").limit(1)).first()
    assert row.beds == 0 and row.reimb_per_bed_month == 0.0


def test_shares_sum_to_hundred(spark, tables):
    rows = reports.denial_by_code(tables.claims_core).collect()
    assert abs(sum(r.percentage for r in rows) - 100) < 0.05


def test_fund_categories(spark):
    names = ["กองทุนผู้ป่วยใน", "IP_CF", "ผู้ป่วยนอก x", "central reimburse", "ควบคุม และ ป้องกัน", "x", None]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r[0] for r in df.select(peers.fund_category(F.col("f"))).collect()] == ["IPD", "IPD", "OPD", "CR", "PP", "OTHER", "OTHER"]
