"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch handed to a Python worker, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: Parts that the ids of a label are ranked in.
SALTS = 64
#: Rows of a labelled sample over all labels (more only if there are more labels).
SAMPLE_ROWS = 25_600
#: Entries a worker's word table may hold before it is emptied (it is only a cache).
CACHE_WORDS = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; a cluster that has set smaller ones keeps its own."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(key, str(value))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: computed once, no lineage behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in no fold (null)."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


def in_fold(col: str, n: int, k: int) -> Column:
    """True if the id falls in fold k of n; false for a null id."""
    return F.coalesce(fold(col, n) == k, F.lit(False))


def labelled_sample(docs: DataFrame, ids: DataFrame, label: str, per_label: int, most: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of a bounded sample of labelled documents: (doc_id, text, label), at most ``per_label`` rows a label.

    ``ids`` has (doc_id, label). Every label has its part: if there are so many that the rows would be more than ``most``, each has as many
    fewer, one at least. The choice is by hash of the id, so it is the same on every run. Only ids are ranked
    and moved; those chosen come back as a broadcast. Ids of a frequent label are ranked in ``SALTS`` parts first. Of rows with the
    same id, the least text counts.
    """
    spark = docs.sparkSession
    by_id = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted, order = Window.partitionBy("label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))).orderBy(*by_id), Window.partitionBy("label").orderBy(*by_id)
    picked = (ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= per_label)
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label))
    picked = saved(picked.select("doc_id", "label", "rank"))
    labels = picked.where("rank = 1").count()
    schema = picked.schema
    rows = sorted((tuple(r) for r in picked.where(F.col("rank") <= max(1, min(per_label, most // max(labels, 1)))).collect()), key=lambda r: r[0])
    chosen = spark.createDataFrame(rows, schema).drop("rank")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word; a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes, in order; none if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mixed(h + _GOLD) + words[k: len(words) - n + 1 + k]
    return mixed(h + np.uint64(n))


def arrow_batches(batches: Iterable[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """``make(batch)`` gives a dict of columns; out come batches of ``schema``."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(make(batch), schema=schema)
