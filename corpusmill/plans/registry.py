"""All registered queries and oracles outside the llm subpackage."""

from __future__ import annotations

from corpusmill.plans import catalog_queries, quality_queries, reconcile_queries, record_queries, stream_queries, usage_queries

_MODULES = (catalog_queries, quality_queries, reconcile_queries, record_queries, usage_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, (f, _) in m.PLANS.items()}
ORACLES = {name: sql for m in _MODULES for name, (_, sql) in m.PLANS.items() if sql}
