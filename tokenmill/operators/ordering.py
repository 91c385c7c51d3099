"""Ordering kernel: seeded permutation, dense global index, global prefix sums.

The reference relies on list order everywhere. Spark has no implicit row
order, so every operator carries an explicit order key and these helpers turn
it into positions without an unpartitioned window (which would pull the whole
table into one task):

1. map every row to a range bucket that is monotone in the order key and
   roughly uniform (cut at quantiles; dense positions or hash keys are uniform by construction);
2. aggregate per bucket (count / sum) -> a table with one row per bucket;
3. exclusive prefix over that table, in two levels, gives each bucket's offset;
4. join the offsets back and finish with a window partitioned by bucket.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_key

# rows per bucket: each bucket is sorted by one task, so it must fit a task
ROWS_PER_BUCKET = 1 << 22
# offsets tables up to this many rows are broadcast; larger ones are shuffled
BROADCAST_ROWS = 1 << 20
# quantile limits asked for at once, and buckets in one stretch of the offset table
MAX_LIMITS, STRETCH = 4096, 1024


def checked_broadcast(df: DataFrame, n_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only when the caller can bound the row count."""
    return F.broadcast(df) if n_rows <= limit else df


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_bucket(df: DataFrame, order: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """``df`` with a bucket ``_bkt`` that is monotone in ``order``, and the bucket count.

    The limits are quantiles of the first key (one aggregate; at most ``MAX_LIMITS`` of them come back), so buckets
    have about the same number of rows however the key is distributed. A value that fills more than one bucket has a
    level of its own; the place of the second key between its least and its greatest value is added to that level, and the
    limits are then quantiles of the sum. That is one more aggregate, however many such values there are.
    """
    num = F.col(order[0]).cast("double")
    n = df.count()
    want = min(MAX_LIMITS, math.ceil(n / rows_per_bucket))
    if want <= 1:
        return df.withColumn("_bkt", F.lit(0).cast("bigint")), 1
    shares = [i / want for i in range(1, want)]
    quantiles = lambda d, c: [x for x in d.agg(F.percentile_approx(c, shares, 100 * want)).first()[0] or [] if math.isfinite(x)]
    limits = quantiles(df, num)
    hot = sorted(v for v, c in Counter(limits).items() if c > 1 and len(order) > 1)
    cuts = sorted({*limits, *(math.nextafter(v, math.inf) for v in hot)})
    b = _level(df.withColumn("_num", num), "_num", cuts, "_lvl")
    if hot:
        second = F.col(order[1]).cast("double")
        usual = F.when(~F.isnan(second) & (F.abs(second) < math.inf), second)
        lo, hi = df.agg(F.min(usual), F.max(usual)).first()
        if lo is not None and hi > lo:
            at = F.when(F.isnan(second), 1.0).otherwise(F.least(F.greatest((second - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))  # NaN comes last, null first
            own = F.col("_lvl").isin([bisect.bisect_right(cuts, v) for v in hot])
            b = b.withColumn("_place", F.col("_lvl") + F.when(own, 0.999 * F.coalesce(at, F.lit(0.0))).otherwise(0.0)).drop("_lvl")
            cuts = sorted({*quantiles(b, F.col("_place")), *(float(i) for i in range(len(cuts) + 1))})
            b = _level(b, "_place", cuts, "_lvl").drop("_place")
    return b.withColumnRenamed("_lvl", "_bkt").drop("_num"), len(cuts) + 3


def _level(df: DataFrame, key: str, cuts: list[float], name: str) -> DataFrame:
    """Number of the limits in ``cuts`` up to ``key``; -1 for null, one more than the last for NaN."""
    b = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=key, outputCol=name, handleInvalid="keep").transform(df) if cuts else df.withColumn(
        name, F.isnan(key).cast("double"))
    return b.withColumn(name, F.when(F.col(key).isNull(), -1).otherwise(F.col(name)).cast("bigint"))


def hash_bucket(key: str | Column, n_buckets: int) -> Column:
    """Bucket of a uniform 60-bit hash key: no sizing job needed (the key is uniform by construction)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.least(F.lit(n_buckets - 1), (k / float(1 << 60) * n_buckets).cast("bigint"))


def _bucketed(df: DataFrame, order: Sequence[str | Column], bucket: Column | None,
              n_buckets: int | None, rows_per_bucket: int) -> tuple[DataFrame, int]:
    if bucket is None:
        if not all(isinstance(c, str) for c in order[:2]):
            raise ValueError("pass `bucket` when an order key is an expression")
        return range_bucket(df, list(order), rows_per_bucket)
    return df.withColumn("_bkt", bucket), (n_buckets or BROADCAST_ROWS + 1)


def _offsets(per_bucket: DataFrame, value: str) -> DataFrame:
    """(_bkt, _off): exclusive prefix sum of ``value`` over the buckets, in two levels.

    Buckets are summed up in stretches of ``STRETCH`` numbers first; only the table of stretches, with a row for at
    most ``STRETCH`` buckets, is ordered as a whole.
    """
    s = per_bucket.withColumn("_st", F.floor(F.col("_bkt") / STRETCH))
    tops = s.groupBy("_st").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_st").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_st", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_st").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    return s.join(tops, "_st").select("_bkt", (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("_off"))


def with_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx",
               bucket: Column | None = None, n_buckets: int | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """WIN-01: dense 0-based global row index in ``order`` (keys must be unique)."""
    b, nb = _bucketed(df, order, bucket, n_buckets, rows_per_bucket)
    counts = b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, "_n")
    w = Window.partitionBy("_bkt").orderBy(*_cols(order))
    return (b.join(checked_broadcast(offsets, nb), "_bkt")
             .withColumn(name, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
             .drop("_bkt", "_off"))


def prefix_sum(df: DataFrame, value: str | Column, order: Sequence[str | Column], name: str = "cum",
               exclusive: bool = False, bucket: Column | None = None, n_buckets: int | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """WIN-02: global running sum of ``value`` in ``order`` (inclusive by default)."""
    v = F.col(value) if isinstance(value, str) else value
    b, nb = _bucketed(df.withColumn("_v", v.cast("bigint")), order, bucket, n_buckets, rows_per_bucket)
    sums = b.groupBy("_bkt").agg(F.sum("_v").alias("_s"))
    offsets = _offsets(sums, "_s")
    w = Window.partitionBy("_bkt").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = (b.join(checked_broadcast(offsets, nb), "_bkt")
             .withColumn(name, (F.col("_off") + F.sum("_v").over(w)).cast("bigint")))
    if exclusive:
        out = out.withColumn(name, F.col(name) - F.col("_v"))
    return out.drop("_bkt", "_off", "_v")


def permute(df: DataFrame, key: str, seed: int = 42, name: str = "perm_idx",
            n_buckets: int | None = None) -> DataFrame:
    """SRT-01: fixed permutation per seed -> dense position ``name``.

    With ``n_buckets`` the range buckets come straight from the uniform hash
    (no sizing job); otherwise one small aggregate sizes them from the count.
    """
    h = df.withColumn("_h", hash_key(seed, key))
    if n_buckets:
        return with_index(h, ["_h", key], name=name, bucket=hash_bucket("_h", n_buckets),
                          n_buckets=n_buckets).drop("_h")
    return with_index(h, ["_h", key], name=name).drop("_h")


def member_offsets(members: DataFrame, length: str, order: Sequence[str], name: str = "offset") -> DataFrame:
    """WIN-03: start offset of each member in the concatenation (exclusive prefix sum)."""
    return prefix_sum(members, length, order, name=name, exclusive=True)


def topk(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """SRT-04 / AGG-13: first ``k`` rows per group (row_number <= k)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= k)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return topk(df, by, order, 1).drop("rank")


def rank_by(df: DataFrame, col: str, desc: bool = True, name: str = "rank") -> DataFrame:
    """SRT-02: sort a *result* table (predictors, models, runs) by a metric.

    The rank is materialised so results compare as sets. Result tables hold one
    row per fitted model or run, so the single ordered window is bounded.
    """
    o = F.col(col).desc() if desc else F.col(col).asc()
    return df.withColumn(name, F.rank().over(Window.orderBy(o)).cast("bigint"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """AGG-15: sorted distinct values with their 0-based position.

    Numeric columns go through the bucketed index; the distinct step itself is
    a partial + final hash aggregate.
    """
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    return with_index(d, [col], name="pos")
