"""All queries of the engine proper, by name, and their SQL."""

from corvane.plans import corpus_queries, routing_queries

QUERIES = routing_queries.QUERIES | corpus_queries.QUERIES
ORACLE = routing_queries.ORACLE | corpus_queries.ORACLE
