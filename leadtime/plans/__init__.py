"""Registered queries over the driver tables, with their SQL."""

from __future__ import annotations

from . import data, files, forecast, series

MODULES = (series, data, forecast, files)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
