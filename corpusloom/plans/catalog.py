"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import attempt_queries, contract_queries, dataset_queries, embedding_queries, evaluation_queries, provider_queries, retrieval_queries, review_queries, text_queries

_ALL = text_queries.QUERIES | retrieval_queries.QUERIES | evaluation_queries.QUERIES | dataset_queries.QUERIES | review_queries.QUERIES | attempt_queries.QUERIES | embedding_queries.QUERIES | provider_queries.QUERIES | contract_queries.QUERIES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
FLAGSHIP = "hybrid_search"
