"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. ``queries()`` and
``oracle_sql()`` list what ``__spark_entry__`` registers.
"""

from notemill.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
