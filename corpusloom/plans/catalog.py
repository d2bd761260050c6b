"""Named queries over the driver tables and their SQL."""

from __future__ import annotations

from corpusloom.plans import extra_queries, search_queries, select_queries, text_queries

MODULES = (text_queries, select_queries, search_queries, extra_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
