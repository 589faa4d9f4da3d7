"""Registry of the queries: name -> callable, and name -> the same in DuckDB SQL."""

from __future__ import annotations

from .plans import extra, graph, mining, relational, series, text

_MODULES = (relational, text, mining, graph, series, extra)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
