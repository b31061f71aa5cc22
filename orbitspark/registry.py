"""All registered queries and their DuckDB twins, by name."""

from __future__ import annotations

from orbitspark.plans import camera_queries, cloud_queries, frame_queries, intake_queries, result_queries, run_queries

MODULES = (frame_queries, intake_queries, cloud_queries, camera_queries, run_queries, result_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.found.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.QUERIES.sql.items()}
