"""Queries over the test tables and their DuckDB equivalents, by name.

The tables hold no PDFs, DOIs, boxes or captions; queries of operators on such things make them from the
tables' columns, as their docstrings say, and the operators' own rules are tested on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


from quire.plans import compare_queries, dedup_queries, layout_queries, library_queries, record_queries, run_queries, search_queries, state_queries, text_queries, tree_queries  # noqa: E402, F401
