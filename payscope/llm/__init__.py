"""Operators for preparing language-model training data, one module each, and their queries.

Nothing else in the library imports this subpackage; ``queries()`` and ``oracle_sql()`` give
what ``__spark_entry__.py`` adds to the catalogue.
"""

from payscope.llm.catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
