"""All queries of the core library and their DuckDB SQL, by name."""

from __future__ import annotations

from tessera.plans import calibration_queries, catalogue_queries, collaborative_queries, etl_queries, fusion_queries, learned_queries, shift_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}

for _module in (collaborative_queries, fusion_queries, learned_queries, shift_queries, text_queries, catalogue_queries, etl_queries, calibration_queries, learned_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= {k: v for k, v in _module.SQL.items() if v}
