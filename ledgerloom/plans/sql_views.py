"""The standing views under their names in SQL, with row access by session variables.

:func:`sign_in` sets the role and hospital of a session as SQL variables and registers the views.  The fact tables
they read are themselves views whose filter reads the variables: an admin sees all rows, and so does a session
without a role; any other role sees the rows of its own hospital.  Sign in again to change the role.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest
from ..sources.tables import Tables
from . import calendar, reports, views

ROLE, HOSPITAL = "ledgerloom_role", "ledgerloom_hospital"
#: Tables whose rows belong to a hospital.
SECURED = ("claims_core", "claims")
PREFIX = "ledgerloom_"


class SecuredTables(Tables):
    """The domain tables as a session may see them; tables that are no facts of a hospital are open."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.open = Tables(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SECURED:
            return self._once(name, lambda: self._secured(name))
        return getattr(self.open, name)

    def _secured(self, name: str) -> DataFrame:
        getattr(self.open, name).createOrReplaceTempView(f"{PREFIX}all_{name}")
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY VIEW {PREFIX}{name} AS SELECT * FROM {PREFIX}all_{name} "
            f"WHERE session.{ROLE} IS NULL OR session.{ROLE} = 'admin' OR hcode = session.{HOSPITAL}"
        )
        return self.spark.table(f"{PREFIX}{name}")


def _views(t: Tables, as_of: dt.date) -> dict[str, Callable[[], DataFrame]]:
    now = dt.datetime.combine(as_of, dt.time())
    days = lambda: calendar.date_dimension_for(t.claims_core, "dateadm")
    return {
        "v_daily_claim_summary": lambda: views.daily_claim_summary(t.claims_core),
        "v_unmatched_claims": lambda: views.unmatched_claims(t.claims_core, t.ledger),
        "v_import_status": lambda: views.import_status(t.ledger),
        "v_drug_analytics": lambda: views.drug_analytics(t.details),
        "v_deny_analytics": lambda: views.deny_analytics(t.details_core.filter("deny_code IS NOT NULL")),
        "v_instrument_analytics": lambda: views.instrument_analytics(t.details.filter("row_number <= 3")),
        "v_monthly_summary": lambda: views.monthly_summary(t.file_totals),
        "v_monthly_revenue_by_fund": lambda: views.monthly_revenue_by_fund(t.claims, days()),
        "v_daily_revenue": lambda: views.daily_revenue(t.claims_core),
        "v_error_analysis": lambda: views.error_analysis(t.claims_core, t.error_dim),
        "v_fund_performance": lambda: views.fund_performance(t.claims_core, t.fund_dim),
        "v_hc_analysis": lambda: views.hc_analysis(t.claims_core, days()),
        "v_ae_analysis": lambda: views.ae_analysis(t.claims_core, days()),
        "v_dmis_analysis": lambda: views.dmis_analysis(t.claims_core, days()),
        "v_denial_breakdown": lambda: views.denial_breakdown(t.claims_core, days()),
        "v_file_import_summary": lambda: views.file_import_summary(t.ledger, t.claims_core),
        "v_hospital_comparison": lambda: views.hospital_comparison(t.claims_core, days(), t.offices),
        "v_drg_distribution": lambda: views.drg_distribution(t.claims_core, t.drg_dim),
        "v_payment_type_analysis": lambda: views.payment_type_analysis(t.claims_core, days()),
        "v_stm_rep_reconciliation": lambda: views.stm_rep_reconciliation(t.stm, t.claims, t.stm_files),
        "v_stm_statistics": lambda: views.stm_statistics(t.stm_files, ingest.receivable_net(t.receivables)),
        "audit_log_stats": lambda: views.audit_log_stats(t.audit, now),
        "user_activity_summary": lambda: views.user_activity_summary(t.audit),
        "data_access_log": lambda: views.data_access_log(t.audit),
        "security_events": lambda: views.security_events(t.audit),
        "active_users_summary": lambda: views.active_users_summary(t.users, t.sessions),
        "user_login_history": lambda: views.user_login_history(t.users, t.audit, now),
        "v_claims_summary_secure": lambda: views.claims_summary_secure(t.claims_core, None, None),
        "v_high_cost_months": lambda: views.high_cost_months(t.claims_core),
        "v_recent_claims": lambda: reports.recent_claims(t.claims_core, t.ledger),
        "v_monthly_by_patient_type": lambda: views.monthly_by_patient_type(t.claims_core),
    }


def sign_in(spark: SparkSession, folder: str, as_of: dt.date, role: str | None = None, hospital: str | None = None) -> list[str]:
    """Register all views of a session with its role and hospital; returns their names."""
    for name, value in ((ROLE, role), (HOSPITAL, hospital)):
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} STRING DEFAULT CAST(NULL AS STRING)")
        if value is not None:
            spark.sql(f"SET VARIABLE {name} = :value", args={"value": value})
    made = _views(SecuredTables(spark, folder), as_of)
    for name, build in made.items():
        build().createOrReplaceTempView(name)
    return sorted(made)


