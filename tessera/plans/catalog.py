"""Every query of the library by its survey id, with the SQL that gives the same rows."""

from __future__ import annotations

from . import aggregates, code, filters, joins, judging, ranking, scans, sets  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
