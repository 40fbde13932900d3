"""Column layouts of claim files: which cell or header holds which column, and how it is read."""

from __future__ import annotations

from ..operators.ingest import Field
from ..operators.sheets import Section

# Columns of outpatient and inpatient claim sheets by cell, from cell 0 on.
OPIP = """
rep_no seq tran_id hn an pid name ptype dateadm datedsc reimb_nhso reimb_agency claim_from error_code
main_fund sub_fund service_type chk_refer chk_right chk_use_right chk main_inscl sub_inscl
href hcode hmain prov1 rg1 hmain2 prov2 rg2 hmain3 da projcode pa drg rw ca_type
claim_drg claim_xdrg claim_net claim_central_reimb paid pay_point ps_chk ps_percent ccuf adjrw_nhso adjrw2 reimb_amt act_amt salary_rate salary_amt reimb_diff_salary
iphc ophc ae_opae ae_ipnb ae_ipuc ae_ip3sss ae_ip7sss ae_carae ae_caref ae_caref_puc opinst inst
ipaec ipaer ipinrgc ipinrgr ipinspsn ipprcc ipprcc_puc ipbkk_inst ip_ontop
cataract_amt cataract_oth cataract_hosp dmis_catinst dmisrc_amt dmisrc_workload rcuhosc_amt rcuhosc_workload rcuhosr_amt rcuhosr_workload
dmis_llop dmis_llrgc dmis_llrgr dmis_lp dmis_stroke_drug dmis_dmidml dmis_pp dmis_dmishd dmis_dmicnt dmis_paliative dmis_dm drug
opbkk_hc opbkk_dent opbkk_drug opbkk_fs opbkk_others opbkk_hsub opbkk_nhso
deny_hc deny_ae deny_inst deny_ip deny_dmis baserate_old baserate_add baserate_total
fs va remark audit_results payment_type seq_no invoice_no invoice_lt
""".split()

# Columns of referral sheets by cell, from cell 0 on; cells 102 to 105 hold nothing that is kept.
ORF = """
rep_no no tran_id hn pid name service_date refer_no htype1 prov1 hcode htype2 prov2 hmain2 href dx proc dmis hmain3 dar ca_type
claim_amt central_reimb_case central_reimb_amt paid act_amt opref_list opref_bef_adj opref_aft_adj total respon_cup respon_nhso reimb_total pay_by ps
cr_ophc_hc01 cr_ophc_hc02 cr_ophc_hc03 cr_ophc_hc04 cr_ophc_hc05 cr_ophc_hc06 cr_ophc_hc07 cr_ophc_hc08 cr_ae04 cr_carae_ae08 cr_opinst_hc09
cr_dmisrc_amt cr_dmisrc_workload cr_rcuhosc_amt cr_rcuhosc_workload cr_rcuhosr_amt cr_rcuhosr_workload
cr_llop cr_lp cr_stroke_drug cr_dmidml cr_pp cr_dmishd cr_paliative cr_drug cr_ontop cr_total cr_by
""".split() + [f"oprefer_md{n:02}_{kind}" for n in range(1, 20) for kind in ("claim", "free")] + ["error_code"]
ORF_LAST = "va remark audit_results payment_type seq_no invoice_no invoice_lt".split()
ORF_LAST_AT = 106

# Headers of universal-coverage claim sheets.
UCS = {
    "REP No.": "rep_no", "ลำดับที่": "seq", "TRAN_ID": "tran_id", "HN": "hn", "AN": "an", "PID": "pid", "ชื่อ-สกุล": "name", "ประเภทผู้ป่วย": "ptype", "วันเข้ารักษา": "dateadm", "วันจำหน่าย": "datedsc", "ชดเชยสุทธิ": "reimb_nhso",
    "ชดเชยจาก": "claim_from", "Error Code": "error_code", "กองทุนหลัก": "main_fund", "กองทุนย่อย": "sub_fund", "ประเภทบริการ": "service_type", "การรับส่งต่อ": "chk_refer", "การมีสิทธิ": "chk_right", "การใช้สิทธิ": "chk_use_right", "CHK": "chk",
    "สิทธิหลัก": "main_inscl", "สิทธิย่อย": "sub_inscl", "HREF": "href", "HCODE": "hcode", "HMAIN": "hmain", "PROV1": "prov1", "RG1": "rg1", "HMAIN2": "hmain2", "PROV2": "prov2", "RG2": "rg2", "DMIS/ HMAIN3": "hmain3", "DA": "da",
    "PROJ": "projcode", "PA": "pa", "DRG": "drg", "RW": "rw", "CA_TYPE": "ca_type", "เรียกเก็บ\n(1)": "claim_drg", "เรียกเก็บ\ncentral reimburse\n(2)": "claim_central_reimb", "ชำระเอง\n(3)": "paid", "อัตราจ่าย/Point\n(4)": "pay_point",
    "ล่าช้า (PS)\n(5)": "ps_percent", "CCUF \n(6)": "ccuf", "AdjRW_NHSO\n(7)": "adjrw_nhso", "AdjRW2\n(8 = 6x7)": "adjrw2", "จ่ายชดเชย\n(9 = 4x5x8)": "reimb_amt", "ค่าพรบ.\n(10)": "act_amt", "เงินเดือน": "salary_rate",
    "ยอดชดเชยหลังหักเงินเดือน\n(12 = 9-10-11)": "reimb_diff_salary",
}

# Headers of local-government claim sheets.
LGO = {
    "REP": "rep_no", "ลำดับที่": "seq", "TRAN_ID": "tran_id", "HN": "hn", "AN": "an", "PID": "pid", "ชื่อ - สกุล": "name", "ประเภทผู้ป่วย": "ptype", "วันเข้ารักษา": "dateadm", "วันจำหน่าย": "datedsc",
    "ชดเชยสุทธิ": "reimb_nhso", "Error Code": "error_code", "กองทุน": "main_fund", "ประเภทบริการ": "service_type", "การรับส่งต่อ": "chk_refer", "การมีสิทธิ": "chk_right", "การใช้สิทธิ": "chk_use_right",
    "สิทธิหลัก": "main_inscl", "สิทธิรอง": "sub_inscl", "HREF": "href", "HCODE": "hcode", "PROV1": "prov1", "รหัสหน่วยงาน": "org_code", "ชื่อหน่วยงาน": "org_name", "PROJ": "projcode", "PA": "pa", "DRG": "drg", "RW": "rw",
    "เรียกเก็บ": "claim_drg", "เบิกได้": "claim_able", "เบิกไม่ได้": "claim_unable", "ชำระเอง": "paid", "อัตราจ่าย": "pay_point", "ล่าช้า (PS)": "ps_percent", "ล่าช้า (PS) เปอร์เซ็นต์": "ps_percent2", "CCUF": "ccuf", "AdjRW": "adjrw_nhso",
    "พรบ.": "act_amt", "กรณี": "case_type", "Deny": "deny_count", "ORS": "ors", "VA": "va", "AUDIT RESULTS": "audit_result", "SEQ NO": "seq_no", "INVOICE NO": "invoice_no", "INVOICE LT": "invoice_lt",
}

# Headers of social-security claim sheets.
SSS = {
    "REP No.": "rep_no", "ลำดับที่": "seq", "TRAN_ID": "tran_id", "HN": "hn", "AN": "an", "PID": "pid", "ชื่อ-สกุล": "name", "ประเภทผู้ป่วย": "ptype", "วันเข้ารักษา": "dateadm", "วันจำหน่าย": "datedsc",
    "กรณีที่เบิก": "claim_case", "ประเภทบริการ": "service_type", "การรับส่งต่อ": "chk_refer", "การมีสิทธิ": "chk_right", "การใช้สิทธิ": "chk_use_right", "CHK": "chk", "สิทธิหลัก": "main_inscl", "สิทธิย่อย": "sub_inscl",
    "HREF": "href", "HCODE": "hcode", "HMAIN": "hmain", "PROV1": "prov1", "HMAIN2": "hmain2", "PROV2": "prov2", "PROJ": "projcode", "HTYPE": "htype", "AESTATUS": "ae_status", "IPTYPE": "iptype", "HSEND": "hsend", "DRG": "drg",
    "RW(1)": "rw", "AdjRW\n(2)": "adjrw_nhso", "ชำระเอง": "paid", "อัตราจ่ายที่กำหนด\n(3)": "pay_point", "ระยะเวลาส่งข้อมูล (PS)": "ps_percent",
    "ขอเบิกค่าบริการ": "claim_request", "IP": "ip_amt", "OP": "op_amt", "AE": "ae_amt", "HC": "hc_amt", "INT": "int_amt", "ON TOP": "on_top_amt", "PP": "pp_amt", "รวมเงินค่าบริการทั้งหมด": "total_service_amt",
    "Error Code": "error_code", "Deny": "deny_count", "VA": "va", "REMARK": "remark", "AUDIT RESULTS": "audit_result", "SEQ NO": "seq_no", "INVOICE NO": "invoice_no", "INVOICE LT": "invoice_lt",
}

# Columns that are keys, times and text, the text with its width; every other column is a number.
IDS = {"rep_no": 15, "tran_id": 15, "hn": 15, "an": 15, "pid": 20, "seq_no": 20}
TIMES = {"dateadm", "datedsc", "service_date"}
TEXT = {
    "name": 100, "ptype": 5, "claim_from": 50, "error_code": 100, "main_fund": 100, "sub_fund": 100, "service_type": 2, "chk_refer": 1, "chk_right": 1, "chk_use_right": 1, "chk": 1, "main_inscl": 5, "sub_inscl": 5,
    "href": 10, "hcode": 10, "hmain": 10, "prov1": 10, "rg1": 10, "hmain2": 10, "prov2": 10, "rg2": 10, "hmain3": 10, "da": 10, "projcode": 100, "pa": 10, "drg": 10, "ca_type": 10, "ps_chk": 10, "va": 100, "remark": 100,
    "audit_results": 100, "audit_result": 100, "payment_type": 100, "invoice_no": 100, "invoice_lt": 100, "refer_no": 20, "htype1": 10, "htype2": 10, "dx": 20, "proc": 50, "dmis": 100, "dar": 10, "pay_by": 50, "cr_by": 50,
    "opref_list": 100, "org_code": 20, "org_name": 100, "case_type": 20, "ors": 20, "claim_case": 20, "htype": 10, "ae_status": 10, "iptype": 10, "hsend": 10, "fs": 100,
}


def field(name: str, source: int | str) -> Field:
    if name in IDS:
        return Field(name, source, "id", IDS[name])
    if name in TIMES:
        return Field(name, source, "timestamp")
    return Field(name, source, "text", TEXT[name]) if name in TEXT else Field(name, source, "number")


POSITIONAL = {
    "OPIP": [field(name, at) for at, name in enumerate(OPIP)],
    "ORF": [field(name, at) for at, name in [*enumerate(ORF), *enumerate(ORF_LAST, ORF_LAST_AT)]],
}
NAMED = {
    "UCS": [field(name, header) for header, name in UCS.items()],
    "LGO": [field(name, header) for header, name in LGO.items()],
    "SSS": [field(name, header) for header, name in SSS.items()],
}


def _fields(text: str, kind: str, first: int = 0) -> tuple[Field, ...]:
    """``name:width`` is text, a bare name of the given kind, ``name=kind`` of another, ``.`` a cell that is not kept."""
    out = []
    for at, word in enumerate(text.split(), first):
        name, _, other = word.partition("=")
        name, _, width = name.partition(":")
        if name != ".":
            out.append(Field(name, at, "plain", int(width)) if width else Field(name, at, other or kind))
    return tuple(out)


# Columns of the detail sheets of claim workbooks by cell, text with its width.
SUMMARY = _fields(
    "rep_period:20 hcode:10 rep_no:20 total_cases=int0 passed_cases=int0 failed_cases=int0 hc_claim hc_reimb ae_claim ae_reimb inst_claim inst_reimb "
    "ip_claim ip_reimb dmis_claim dmis_reimb pp_claim pp_reimb drug_claim drug_reimb reimb_agency reimb_total", "number0")
DRUG = _fields(
    "tran_id:20 hn:15 an:20 dateadm=day pid:13 patient_name:100 drug_seq=int0 drug_code:20 tmt_code:10 generic_name:200 trade_name:100 drug_type:10 "
    "drug_category:50 dosage_form:50 quantity unit_price claim_amount ceiling_price reimb_amount reimb_agency error_code:50", "number0", 1)
INSTRUMENT = _fields(
    "tran_id:20 hn:15 an:20 dateadm=day pid:13 patient_name:100 inst_seq=int0 inst_code:10 inst_name:200 claim_qty=int0 claim_amount reimb_qty=int0 "
    "reimb_amount deny_flag:10 error_code:50", "number0", 1)
DENY = _fields(
    "tran_id:20 hcode:10 hn:15 an:20 dateadm=day pid:13 patient_name:100 fund_code:20 claim_code:20 expense_category=int0 claim_amount deny_code:20", "number0", 1)
ZERO_PAID = _fields(
    "tran_id:20 hcode:10 hn:15 an:20 dateadm=day pid:13 patient_name:100 fund_code:20 claim_code:20 tmt_code:10 expense_category=int0 claim_qty=int0 "
    "paid_qty=int0 paid_amount reason:200", "number0", 1)

# Columns of the sections of statement workbooks by cell.
RECEIVABLE = _fields("patient_type=plain rep_count=whole0 patient_count=whole0 total_adjrw=rate0 total_paid salary_deduction adjrw_paid_deduction", "number0")
REP_SUMMARY = _fields(
    "period=plain hcode=plain rep_no=plain claim_type=plain total_passed=whole0 amount_claimed prb_amount receivable_op receivable_ip_calc receivable_ip_paid "
    "hc_amount hc_drug ae_amount ae_drug inst_amount dmis_calc dmis_paid dmis_drug palliative_care dmishd_amount pp_amount fs_amount opbkk_amount "
    "total_receivable covid_amount data_source=plain", "number0")
STATEMENT_CLAIM = _fields(
    "rep_no=plain seq=whole0 tran_id=id hn=id an=id pid=id patient_name=plain date_admit=timestamp date_discharge=timestamp main_inscl=plain proj_code=plain "
    "amount_claimed fund_ip_prb adjrw=rate0 late_penalty=whole0 . ccuf=rate0 adjrw2=rate0 payment_rate salary_deduction paid_after_deduction receivable_op "
    "receivable_ip_calc receivable_ip_paid hc_amount hc_drug ae_amount ae_drug inst_amount dmis_calc dmis_paid dmis_drug palliative_care dmishd_amount "
    "pp_amount fs_amount opbkk_amount total_compensation va_amount covid_amount data_source=plain seq_no=plain", "number0")

# Names of the sheets, their first rows of data and what such a row begins with.
CLAIM_SHEETS = [
    Section("summary", SUMMARY, sheets=("Summary",), first=5, only_first=True),
    Section("drug", DRUG, sheets=("Data Drug",), first=6, cell="c1", pattern=r"\S", key="tran_id"),
    Section("instrument", INSTRUMENT, sheets=("Data Instrument",), first=6, cell="c1", pattern=r"\S", key="tran_id"),
    Section("deny", DENY, sheets=("Data DENY",), first=1, cell="c1", pattern=r"\S", key="tran_id"),
    Section("zero_paid", ZERO_PAID, sheets=("Data sheet 0",), first=6, cell="c1", pattern=r"\S", key="tran_id"),
]
_CLAIM = {"fields": STATEMENT_CLAIM, "first": 14, "pattern": r"^\d+", "no_words": ("รวม", "nan"), "key": "tran_id"}
STATEMENT_SHEETS = [
    Section("receivable", RECEIVABLE, holds=("รายงานพึงรับ",), without=("ผู้พิการ",), pattern="^(ผู้ป่วยใน|ผู้ป่วยนอก)$"),
    Section("rep_summary", REP_SUMMARY, holds=("รายงานสรุป",), without=("ผู้พิการ",), by_type=True, first=15, pattern=r"^\d{4}_[IO]P_\d+"),
    Section("claims_normal", holds=("รายละเอียด", "ข้อมูลปกติ"), by_type=True, kind="normal", **_CLAIM),
    Section("claims_appeal", holds=("รายละเอียด", "อุทธรณ์"), by_type=True, kind="appeal", **_CLAIM),
    Section("claims_disabled", holds=("รายละเอียด", "ผู้พิการ D1"), kind="disabled_d1", **_CLAIM),
]
