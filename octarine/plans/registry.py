"""The registered queries of the point-cloud engine, and the SQL that each must equal."""

from octarine.plans import sequence_queries, space_queries, stream_queries, tree_queries

QUERIES = tree_queries.QUERIES | space_queries.QUERIES | sequence_queries.QUERIES | stream_queries.QUERIES
SQL = tree_queries.SQL | space_queries.SQL | sequence_queries.SQL | stream_queries.SQL
