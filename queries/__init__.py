"""Checkable queries: each pairs a Spark job over the generic tables with the same question in SQL."""

from __future__ import annotations

from queries import arrange, catalogue, plans, scalars, sound, streams, timelines, visual

MODULES = (scalars, visual, sound, arrange, timelines, catalogue, streams, plans)


def queries() -> dict:
    return {name: job for module in MODULES for name, job in module.JOBS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
