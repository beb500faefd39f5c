"""Whole plans: medallion layers, reports, reconciliation."""
