"""Row filters and crops (FLT-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.ordering import prefix_sum, with_index


def crop_docs(df: DataFrame, cap: int = 10000, text: str = "text") -> DataFrame:
    """FLT-01: crop every document to ``cap`` code points."""
    return df.withColumn(text, F.substring(F.col(text), 1, cap))


def char_budget(df: DataFrame, max_chars: int, order: Sequence[str], text: str = "text",
                bucket: Column | None = None) -> DataFrame:
    """FLT-02: keep documents until the one that takes the total above ``max_chars``.

    The crossing document is kept (exclusive prefix sum <= max), as in the
    reference's iterator that yields before it checks the budget.
    """
    p = prefix_sum(df, F.char_length(F.col(text)), order, name="chars_before", exclusive=True, bucket=bucket)
    return p.where(F.col("chars_before") <= max_chars)


def min_length(df: DataFrame, n: int = 100, text: str = "text") -> DataFrame:
    """FLT-07: minimum document length in code points."""
    return df.where(F.char_length(F.col(text)) >= n)


def slice_task(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1,
               idx: str = "idx") -> DataFrame:
    """FLT-03: strided view ``[start:stop:step]`` over a dense index, re-indexed from 0.

    ``stop`` is clamped to the table size (the reference does not clamp).
    """
    cond = (F.col(idx) >= start) & (((F.col(idx) - start) % step) == 0)
    if stop is not None:
        cond = cond & (F.col(idx) < stop)
    return df.where(cond).withColumn(idx, ((F.col(idx) - start) / step).cast("bigint"))


def limit_per_task(df: DataFrame, k: int, task: str = "task", key: str = "item_id", seed: int = 1337) -> DataFrame:
    """FLT-04: at most ``k`` items per task after a fixed seeded shuffle."""
    from tokenmill.functions.hashing import hash_key
    from tokenmill.operators.ordering import topk
    return topk(df.withColumn("_h", hash_key(seed, key)), [task], [F.col("_h"), F.col(key)], k).drop("_h", "rank")


def limit_problems(df: DataFrame, k: int, idx: str = "idx") -> DataFrame:
    """FLT-05: first ``min(n, k)`` problems by index."""
    return df.where(F.col(idx) < k)


def complete_runs(df: DataFrame, metric: str) -> DataFrame:
    """FLT-06: drop incomplete runs (metric missing or not positive)."""
    return df.where(F.col(metric).isNotNull() & (F.col(metric) > 0))


def indexed(df: DataFrame, order: Sequence[str], idx: str = "idx") -> DataFrame:
    return with_index(df, order, name=idx)
