"""Registered queries of the engine's own operators and their DuckDB SQL."""

from __future__ import annotations

from .plans import records  # noqa: F401 - registers its queries
from .plans.registered import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
