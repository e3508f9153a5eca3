"""All driver queries of this library outside the training-data package."""

from turnmill.plans import conversation_queries, corpus_queries, fidelity_queries, frame_queries

_MODULES = [conversation_queries, fidelity_queries, corpus_queries, frame_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
