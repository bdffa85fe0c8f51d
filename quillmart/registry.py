"""All commerce queries and their oracle SQL."""

from quillmart import analysis, queries

QUERIES = queries.QUERIES | analysis.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | analysis.ORACLE_SQL
