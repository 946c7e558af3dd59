"""Every query by name."""

from __future__ import annotations

from importlib import import_module

from tallyward.catalog.bindings import QUERIES, SQL

for _part in ("history", "profiling", "enriching", "modelling", "learning", "online", "storage"):
    import_module(f"tallyward.catalog.{_part}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
