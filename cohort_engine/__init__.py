"""Cohort building, record linkage, period panels and event studies on Spark."""
