"""Corpus statistics (AGG-19/20, WIN-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.ordering import prefix_sum


def text_stats(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """AGG-19: files (rows), lines (newlines), characters (UTF-8 bytes), tokens ~ chars div 4."""
    nl = F.char_length(F.col(text)) - F.char_length(F.regexp_replace(F.col(text), "\n", ""))
    nb = F.octet_length(F.col(text))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum(nl).cast("bigint").alias("n_lines"),
                               F.sum(nb).cast("bigint").alias("n_chars"),
                               (F.sum(nb) / 4).cast("bigint").alias("n_tokens_approx"))


def shard_totals(corpus: DataFrame) -> DataFrame:
    """AGG-20: docs and chars per shard plus running totals (one row per shard)."""
    s = corpus.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    bucket = F.floor(F.col("shard_idx") / 4096)
    for c in ("n_docs", "n_chars"):
        s = prefix_sum(s, c, ["shard_idx"], name=c.replace("n_", "total_"), bucket=bucket)
    return s.select(F.col("shard_idx").cast("bigint").alias("shard_idx"), F.col("n_docs").cast("bigint").alias("n_docs"),
                    F.col("n_chars").cast("bigint").alias("n_chars"),
                    "total_docs", "total_chars")


def shard_eta(shards: DataFrame, ts: str = "ts", total_shards: int | None = None) -> DataFrame:
    """WIN-11: time spent on each shard and the remaining-time estimate (running mean).

    Shard numbers are dense, so the shard before is found by a join, and the mean of all times so far is the time
    since the first shard over the number of shards since.
    """
    before = shards.select((F.col("shard_idx") + 1).alias("shard_idx"), F.col(ts).cast("double").alias("_before"))
    first = shards.agg(F.min_by(F.col(ts).cast("double"), "shard_idx").alias("ts"), F.min("shard_idx").alias("i"))
    t0, i0 = first.select("ts").scalar(), first.select("i").scalar()
    out = shards.join(before, "shard_idx", "left").withColumn("elapsed", F.col(ts).cast("double") - F.col("_before")).drop("_before")
    mean = (F.col(ts).cast("double") - t0) / (F.col("shard_idx") - i0)
    out = out.withColumn("avg_elapsed", F.when(F.col("shard_idx") > i0, mean))
    if total_shards is not None:
        out = out.withColumn("eta", F.col("avg_elapsed") * (total_shards - F.col("shard_idx") - 1))
    return out
