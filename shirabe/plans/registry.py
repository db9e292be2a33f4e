"""All registered queries of the core, and the SQL of those that SQL can express."""

from __future__ import annotations

from shirabe.plans import core_queries, io_queries, loop_queries, packed_queries

_MODULES = [packed_queries, core_queries, io_queries, loop_queries]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
