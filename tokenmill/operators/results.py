"""Comparisons of result tables: comparable tasks, head to head, spread, best rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable_tasks(a: DataFrame, b: DataFrame, task: str = "task", shots: str = "shots", value: str = "acc") -> DataFrame:
    """JN-08: rows of two result tables for the same task, both with shots or both without."""
    left = a.select(task, F.col(shots).alias("shots_a"), F.col(value).alias("acc_a"), (F.col(shots) == 0).alias("_zero"))
    right = b.select(task, F.col(shots).alias("shots_b"), F.col(value).alias("acc_b"), (F.col(shots) == 0).alias("_zero"))
    return left.join(right, [task, "_zero"]).drop("_zero")


def head_to_head(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """JN-09: difference b - a of a value under the same key, and in per cent of a."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return j.select(key, (F.col("_b") - F.col("_a")).alias("delta"), ((F.col("_b") - F.col("_a")) / F.col("_a") * 100).alias("improvement_pct"))


def mean_std(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AGG-14: count, mean, sample standard deviation and max - min of a value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                               (F.max(value) - F.min(value)).alias("spread"))


def argmin_row(df: DataFrame, by: Sequence[str], value: str, pick: str) -> DataFrame:
    """WIN-08: ``pick`` of the row with the least value in each group (ties: least pick), and that value."""
    return df.groupBy(*by).agg(F.min_by(pick, F.struct(value, pick)).alias(pick), F.min(value).alias("least"))


def largest_run(runs: DataFrame, depth: Column, run: str = "run", mtime: str = "mtime") -> DataFrame:
    """WIN-10: the run with the greatest depth, the latest of equals, then the least id."""
    best = runs.agg(F.max_by(F.struct(*runs.columns), F.struct(depth, F.col(mtime), -F.col(run))).alias("b"))
    return best.select("b.*")
