"""All queries of the core, and their SQL twins."""

from __future__ import annotations

from veilspan.plans import coverage_queries, span_queries, table_queries

_MODULES = [coverage_queries, span_queries, table_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark, sf_dir):
    return span_queries.QUERIES["redact_number"](spark, sf_dir)
