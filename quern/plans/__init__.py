"""Queries over the test tables. Importing this package fills the registry."""

from quern.plans import corpus_queries, graph_queries, index_queries, model_queries, notice_queries, record_queries, retrieval_queries, search_queries, tabular_queries, text_queries  # noqa: F401
