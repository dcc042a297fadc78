"""All queries by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

from notemill.plans.base import QUERIES, SQL

MODULES = ["text_plans", "token_plans", "quality_plans", "retrieval_plans", "table_plans", "note_plans", "model_plans", "library_plans", "filing_plans"]
for _name in MODULES:
    import_module(f"notemill.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
