"""All queries of the engine and their SQL."""

from __future__ import annotations

from cuewright.plans import retrieval_queries, source_queries, text_queries, timeline_queries

QUERIES = {**retrieval_queries.QUERIES, **text_queries.QUERIES, **timeline_queries.QUERIES, **source_queries.QUERIES}
ORACLE_SQL = {**retrieval_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **timeline_queries.ORACLE_SQL, **source_queries.ORACLE_SQL}
