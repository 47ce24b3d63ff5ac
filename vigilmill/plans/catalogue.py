"""All queries of the core, by name."""

from __future__ import annotations

from . import forum_queries, study_queries, study_sql

QUERIES = {**forum_queries.QUERIES, **study_queries.QUERIES}
SQL = {**forum_queries.SQL, **study_sql.SQL}
FLAGSHIP = "term_frequency"
