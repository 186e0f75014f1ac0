"""Composite plans: reports, findings, chart feeds and the pipeline."""
