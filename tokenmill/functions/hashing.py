"""Deterministic hash keys that Spark and DuckDB compute identically.

A seeded permutation is "order by hash_key(seed, id), id". The key is the
first 15 hex digits of md5(seed || ':' || id) read as a BIGINT (60 bits, so
it is non-negative and uniform, which also makes it a good range-bucket key).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash_key(seed, *cols: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def hash_sql(seed, *exprs: str) -> str:
    """DuckDB twin of :func:`hash_key` (used by oracles)."""
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"CAST(('0x' || substr(md5({inner}), 1, 15)) AS BIGINT)"


def hash_unit(seed, *cols: Column | str) -> Column:
    """Uniform double in [0, 1) derived from :func:`hash_key`."""
    return hash_key(seed, *cols) / F.lit(float(1 << HASH_BITS))
