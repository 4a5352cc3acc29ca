"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from tidemark.plans import charts, cycles, learning, marks, rasters, shapes

QUERIES: dict = {**cycles.QUERIES, **charts.QUERIES, **rasters.QUERIES, **marks.QUERIES, **shapes.QUERIES, **learning.QUERIES}
ORACLE_SQL: dict = {**cycles.ORACLE_SQL, **charts.ORACLE_SQL, **rasters.ORACLE_SQL, **marks.ORACLE_SQL, **shapes.ORACLE_SQL}
