"""Queries over the driver's tables and the same results in SQL."""

from __future__ import annotations

from . import audits, built, decisions, exchange, measures, relational

MODULES = [relational, decisions, audits, exchange, measures, built]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
