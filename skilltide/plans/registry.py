"""All registered queries and their DuckDB twins."""

from . import data_queries, matching_queries, source_queries

QUERIES = matching_queries.QUERIES | data_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = matching_queries.ORACLE_SQL | data_queries.ORACLE_SQL | source_queries.ORACLE_SQL
