"""Queries over the given tables, one per operator, with SQL that must agree.

``QUERIES`` maps a name to a callable (spark, folder of Parquet tables) -> DataFrame;
``ORACLES`` maps a name to SQL over the same tables.
"""

from . import aggregates, changes, filters, functions, joins, reads, sorts, syncs, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
