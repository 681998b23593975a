"""Names of all queries, and the SQL that gives the same rows."""

from __future__ import annotations

from . import geo, learning, pooling, report, sources

_PARTS = (pooling, sources, geo, learning, report)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
