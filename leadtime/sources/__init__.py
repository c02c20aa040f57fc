"""Readers and writers of measurement files and tables."""
