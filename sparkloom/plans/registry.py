"""All queries of the library outside the llm subpackage, and their SQL."""

from __future__ import annotations

from sparkloom.plans import corpus_queries, corpus_text_queries, evaluation_queries, pipeline_queries, reader_queries, retrieval_queries, text_queries

MODULES = [retrieval_queries, text_queries, corpus_text_queries, evaluation_queries, pipeline_queries, corpus_queries, reader_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
