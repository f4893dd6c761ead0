"""Queries of the ``llm`` subpackage and of the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, hard_negatives, line_dedup, personal_data, perspectives, pieces, prefix_trie, quality, secret_scan, sharding, simhash, substring, warc

MODULES = (pieces, line_dedup, substring, sharding, warc, perspectives, quality, simhash, decontaminate, secret_scan, prefix_trie, personal_data, hard_negatives)


def queries() -> dict:
    found = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
