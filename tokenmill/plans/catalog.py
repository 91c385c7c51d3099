"""Query registry: one entry per inventory ID, each with its DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle (when the operator
is SQL-expressible) is a DuckDB query over the same parquet tables that must
return the same columns and values. Columns are aliased identically on both
sides; integers are BIGINT and floats are rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    # importing the modules registers their queries
    from tokenmill.plans import (q_conversation, q_corpus, q_eval, q_io, q_logs, q_more,  # noqa: F401
                                 q_packing, q_results, q_stream, q_tasks, q_tokenizer)
    return QUERIES, ORACLES
