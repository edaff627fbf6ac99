"""Every query of the core with its SQL, by name."""

from __future__ import annotations

from veristrata.plans import audit_queries, compile_queries, corpus_queries, orphan_queries, segment_sql, text_queries, verdict_queries

_PARTS = [orphan_queries, text_queries, audit_queries, verdict_queries, corpus_queries, compile_queries]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in [*_PARTS, segment_sql] for name, sql in part.ORACLES.items()}
