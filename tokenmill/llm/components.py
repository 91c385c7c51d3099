"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import saved


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Each step is a grouped minimum (combined before the shuffle) and a join, so a node with very many neighbours is
    neither collected nor sorted in one task; the edge table never grows. Steps end when nothing changes. Loops,
    repeated edges and null ends do no harm; no edges give no rows.
    """
    hi, lo = F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")
    now = saved(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(hi, lo).distinct())
    mark = _mark(now)
    while mark[0]:
        near = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least"))
        large = now.join(near, "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (large.join(least, "hi")
                 .select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"),
                         F.col("hi").alias("own")))
        # (lo, least) for every other lower neighbour and (hi, least) for the node itself
        now = saved(small.select("hi", "lo").union(least.select("hi", F.col("least").alias("lo"))).distinct())
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
