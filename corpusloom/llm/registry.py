"""All queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import queries_corpora, queries_native, queries_python

MODULES = (queries_native, queries_python, queries_corpora)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
