"""Retail margin diagnosis on Spark: landing, gates, reports and findings as DataFrames."""
