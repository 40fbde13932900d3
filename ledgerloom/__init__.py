"""Reimbursement-claims analytics as plain Spark DataFrame jobs."""
