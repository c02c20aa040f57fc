"""Incremental versions of resampling and file audits."""
