"""All queries of the core library, and their SQL."""

from __future__ import annotations

from supportlens.plans import core_problems, model_queries, pipeline_queries, review_queries, text_queries

FLAGSHIP = "risk_levels"
QUERIES = {**core_problems.QUERIES, **text_queries.QUERIES, **model_queries.QUERIES, **review_queries.QUERIES, **pipeline_queries.QUERIES}
SQL = {**core_problems.SQL, **text_queries.SQL, **model_queries.SQL, **review_queries.SQL, **pipeline_queries.SQL}
