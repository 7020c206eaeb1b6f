"""Queries of the library's operators by name, and DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_cells, queries_grid, queries_jobs, queries_prep, queries_stats

_ALL = (queries_stats, queries_grid, queries_prep, queries_jobs, queries_cells)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
