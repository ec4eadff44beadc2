"""Audit of extracted documents on Spark: matching, grading, reconciling and costing."""
