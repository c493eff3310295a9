"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from tilescape.queries import analysis, catalog, geometry, scopes, values

QUERIES = analysis.QUERIES | catalog.QUERIES | geometry.QUERIES | scopes.QUERIES | values.QUERIES
ORACLE_SQL = analysis.ORACLE_SQL | catalog.ORACLE_SQL | geometry.ORACLE_SQL | scopes.ORACLE_SQL | values.ORACLE_SQL
