"""All queries outside the llm subpackage, by name, with their SQL twins."""

from __future__ import annotations

from sitequarry.plans import drawing_queries, graph_queries, problems, project_queries, record_queries, retrieval_queries, stream_queries, text_queries

FLAGSHIP = "op_db_dashboard"
QUERIES = {**problems.QUERIES, **text_queries.QUERIES, **retrieval_queries.QUERIES, **graph_queries.QUERIES, **project_queries.QUERIES, **stream_queries.QUERIES, **record_queries.QUERIES, **drawing_queries.QUERIES}
SQL = {**problems.SQL, **text_queries.SQL, **retrieval_queries.SQL, **graph_queries.SQL, **project_queries.SQL, **stream_queries.SQL, **record_queries.SQL, **drawing_queries.SQL}
