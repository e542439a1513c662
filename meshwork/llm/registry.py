"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from meshwork.llm import queries_graph, queries_native, queries_sequences, queries_text

_MODULES = (queries_graph, queries_native, queries_text, queries_sequences)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
