"""Queries of the llm subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from shirabe.llm import clean_queries, mapping_queries, neardup_queries, pii_queries, residue_queries, span_queries, token_queries

_MODULES = [clean_queries, mapping_queries, neardup_queries, pii_queries, residue_queries, token_queries, span_queries]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
