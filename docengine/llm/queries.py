"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from docengine.llm import (
    chat_format,
    decontamination,
    license_scan,
    ngram_jaccard,
    quality,
    secret_scan,
    source_mix,
    spotsigs,
    token_counts,
    toxicity,
)

MODULES = [
    token_counts,
    decontamination,
    source_mix,
    secret_scan,
    ngram_jaccard,
    license_scan,
    toxicity,
    chat_format,
    spotsigs,
    quality,
]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
