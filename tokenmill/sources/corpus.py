"""Corpus scans: shard listing, split, row-group stride, ranks, resume, epochs.

A corpus row carries its physical order explicitly:
``(shard_idx, rg_idx, row_in_rg, pos, doc_id, text)``. ``rg_idx`` restarts in
every shard, exactly like a parquet row group number.

Two ways to get there:
* :func:`scan_corpus` reads real parquet shards and takes ``shard_idx`` from
  the sorted file names and ``rg_idx`` from the files' footers;
* :func:`corpus_layout` lays an existing table with a dense position column
  out as virtual shards (used on the test tables, which are single files).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_GROUP_ROWS = 1024  # rows per parquet row group written by the resharder
CORPUS_COLS = ["shard_idx", "rg_idx", "row_in_rg", "pos"]


@lru_cache(maxsize=256)
def group_starts(path: str) -> np.ndarray:
    """First row of each row group of a parquet file, and its number of rows, from its footer (path or URI)."""
    fs, inner = FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    with fs.open_input_file(inner) as f:
        meta = pq.read_metadata(f)
    return np.cumsum([0, *(meta.row_group(k).num_rows for k in range(meta.num_row_groups))])


def group_of_row(file: Column, row_index: Column) -> Column:
    """(rg_idx, first_row) of the row group that a row lies in.

    Every task reads the footers of the files it scans; of a row only its file and place go to Python, so the text isn't moved.
    """
    @F.arrow_udf("struct<rg_idx: int, first_row: long>")
    def lookup(files: pa.Array, rows: pa.Array) -> pa.Array:
        names = files.dictionary_encode()
        at, place = names.indices.to_numpy(zero_copy_only=False), rows.to_numpy(zero_copy_only=False)
        group, first = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        for k, name in enumerate(names.dictionary.to_pylist()):
            mine = at == k
            starts = group_starts(name)
            group[mine] = np.searchsorted(starts[:-1], place[mine], side="right") - 1  # an empty group has no row
            first[mine] = starts[group[mine]]
        return pa.StructArray.from_arrays([pa.array(group), pa.array(first)], names=["rg_idx", "first_row"])

    return lookup(file, row_index)


def _shards(df: DataFrame, path: str) -> DataFrame:
    """One row per file, numbered in path order; only the metadata column is read for it."""
    files = df.select(path).distinct()
    return files.withColumn("shard_idx", (F.row_number().over(Window.orderBy(path)) - 1).cast("int"))


def scan_corpus(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """SRC-01: ``*.parquet`` shards sorted by path (``*.tmp`` never match), with the row groups that the files really have."""
    df = (spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
          .select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos")))
    out = df.join(_shards(df, "file_path"), "file_path").withColumn("_g", group_of_row(F.col("file_path"), F.col("pos")))
    return out.select("text", "shard_idx", "_g.rg_idx", (F.col("pos") - F.col("_g.first_row")).cast("int").alias("row_in_rg"), "pos",
                      (F.col("shard_idx").cast("bigint") * F.lit(1 << 40) + F.col("pos")).alias("doc_id"))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: (shard_idx, rg_idx, first_row, n_rows, file_path) of every row group, from the footers, which are read in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shard in zip(batch["file_path"].to_pylist(), batch["shard_idx"].to_pylist()):
                starts = group_starts(name)
                n = len(starts) - 1
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(starts[:-1]),
                                                  pa.array(np.diff(starts)), pa.array([name] * n, pa.string())], names=["shard_idx", "rg_idx", "first_row", "n_rows", "file_path"])

    files = _shards(spark.read.option("pathGlobFilter", "*.parquet").parquet(path).select(F.col("_metadata.file_path").alias("file_path")), "file_path")
    par = spark.sparkContext.defaultParallelism
    return files.repartition(par, "file_path").mapInArrow(run, "shard_idx int, rg_idx int, first_row long, n_rows long, file_path string")


def corpus_layout(df: DataFrame, pos: str = "doc_id", rows_per_group: int = 16,
                  groups_per_shard: int = 4) -> DataFrame:
    """Virtual shard layout of a table with a dense 0-based position column."""
    p = F.col(pos).cast("bigint")
    rows_per_shard = rows_per_group * groups_per_shard
    return (df.withColumn("pos", p)
              .withColumn("shard_idx", (p / rows_per_shard).cast("int"))
              .withColumn("rg_idx", ((p % rows_per_shard) / rows_per_group).cast("int"))
              .withColumn("row_in_rg", (p % rows_per_group).cast("int")))


def last_shard(df: DataFrame) -> Column:
    """Scalar subquery: the highest shard index (the validation shard)."""
    return df.agg(F.max("shard_idx")).scalar()


def split(df: DataFrame, which: str) -> DataFrame:
    """SRC-02: train = every shard but the last, val = the last one."""
    if which not in ("train", "val"):
        raise ValueError(f"split must be 'train' or 'val', got {which!r}")
    last = last_shard(df)
    return df.where(F.col("shard_idx") < last) if which == "train" else df.where(F.col("shard_idx") == last)


def with_split(df: DataFrame) -> DataFrame:
    """Both splits in one pass, as a ``split`` column."""
    return df.withColumn("split", F.when(F.col("shard_idx") == last_shard(df), "val").otherwise("train"))


def stride(df: DataFrame, start: int = 0, step: int = 1) -> DataFrame:
    """SRC-03: row groups ``start, start+step, ...`` restarting in every shard."""
    g = F.col("rg_idx")
    return df.where((g >= start) & (((g - start) % step) == 0))


def assign_rank(df: DataFrame, world: int) -> DataFrame:
    """SRC-04: rank r of W reads row groups r, r+W, ... of every shard."""
    return df.withColumn("rank", F.pmod(F.col("rg_idx"), F.lit(world)).cast("int"))


def doc_batches(df: DataFrame, n: int = 128) -> DataFrame:
    """SRC-05: fixed-size document batches inside a row group (order kept)."""
    b = df.withColumn("batch", (F.col("row_in_rg") / n).cast("int"))
    return (b.groupBy("shard_idx", "rg_idx", "batch")
             .agg(F.array_sort(F.collect_list(F.struct("row_in_rg", "doc_id"))).alias("_m"))
             .select("shard_idx", "rg_idx", "batch",
                     F.transform("_m", lambda m: m["doc_id"]).alias("doc_ids")))


def resume_from(df: DataFrame, cursor: dict, world: int, rank: int | None = None) -> DataFrame:
    """SRC-06: first-pass rows after a cursor ``{pq_idx, rg_idx, epoch}``.

    On the cursor's shard a rank continues at ``(rg div W + 1) * W + rank``;
    later shards start again at ``rank``; earlier shards are done. ``df`` is one
    split whose shards are numbered from 0 (``pq_idx`` counts inside the split).
    """
    r = assign_rank(df, world)
    if rank is not None:
        r = r.where(F.col("rank") == rank)
    pq, rg = int(cursor["pq_idx"]), int(cursor["rg_idx"])
    on_file = (F.col("shard_idx") == pq) & ((F.col("rg_idx") / world).cast("int") > rg // world)
    return (r.where((F.col("shard_idx") > pq) | on_file)
             .withColumn("epoch", F.lit(int(cursor.get("epoch", 1)))))


def repeat_epochs(df: DataFrame, epochs: int, start_epoch: int = 1) -> DataFrame:
    """SRC-07: the scan repeated ``epochs`` times, ordered by ``(epoch, pos)``.

    Each row is replicated by a generator (``explode(sequence)``) instead of a
    join, so the plan stays a narrow map.
    """
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(start_epoch), F.lit(start_epoch + epochs - 1))))


def missing_shards(spark: SparkSession, n: int, present: DataFrame, val_id: int) -> DataFrame:
    """SRC-15: requested ids ``0..n-1`` plus the val shard, minus those present."""
    wanted = spark.range(n).select(F.col("id").alias("shard_idx")).unionByName(
        spark.range(1).select(F.lit(val_id).cast("bigint").alias("shard_idx"))).distinct()
    have = present.select(F.col("shard_idx").cast("bigint").alias("shard_idx")).distinct()
    return wanted.join(have, "shard_idx", "left_anti")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: one word per line, stripped."""
    return spark.read.text(path).select(F.trim("value").alias("word"))


def words_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Word list derived from a text column (lower-cased letter runs)."""
    return (df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("\\p{L}+"), 0)).alias("word"))
              .distinct())


CORE_CSV_SCHEMA = T.StructType([
    T.StructField("Task", T.StringType()),
    T.StructField("Accuracy", T.StringType()),
    T.StructField("Centered", T.StringType()),
])


def read_core_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: padded CORE result CSV -> (task, accuracy, centered)."""
    raw = (spark.read.option("header", "false").option("ignoreLeadingWhiteSpace", "true")
           .option("ignoreTrailingWhiteSpace", "true").schema(CORE_CSV_SCHEMA).csv(path))
    # the header row is dropped by value: part files carry no order guarantee
    return (raw.where(F.col("Task").isNotNull() & F.col("Centered").isNotNull() & (F.col("Task") != "Task"))
               .select(F.col("Task").alias("task"),
                       F.expr("try_cast(nullif(Accuracy, '') AS DOUBLE)").alias("accuracy"),
                       F.expr("try_cast(Centered AS DOUBLE)").alias("centered"))
               .where(F.col("centered").isNotNull()))


SWEEP_SCHEMA = T.StructType([
    T.StructField("flops_budget", T.DoubleType()), T.StructField("depth", T.IntegerType()),
    T.StructField("model_dim", T.IntegerType()), T.StructField("params_wte", T.LongType()),
    T.StructField("params_value_embeds", T.LongType()), T.StructField("params_lm_head", T.LongType()),
    T.StructField("params_transformer", T.LongType()), T.StructField("params_scalars", T.LongType()),
    T.StructField("params_total", T.LongType()), T.StructField("num_iterations", T.LongType()),
    T.StructField("tokens_trained", T.LongType()), T.StructField("val_bpb", T.DoubleType()),
    T.StructField("core_score", T.DoubleType()), T.StructField("train_time_sec", T.LongType()),
])


def read_sweep_csv(spark: SparkSession, path: str, schema: T.StructType = SWEEP_SCHEMA) -> DataFrame:
    """SRC-12: sweep result CSV with an explicit schema (no inference)."""
    return spark.read.option("header", "true").schema(schema).csv(path)
