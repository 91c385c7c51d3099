"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions.text import col



def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (TIMESTAMP_NTZ) value."""
    c = col(ts).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)


def epoch_seconds(ts: str | Column) -> Column:
    return F.floor(epoch_micros(ts) / 1000000).cast("bigint")
