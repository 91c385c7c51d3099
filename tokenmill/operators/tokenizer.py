"""Tokenizer work as corpus-level Spark jobs.

* Byte tokenizer (TOK-13): ids = UTF-8 bytes, specials at 256..264. Pure SQL
  functions, so every byte-level result has an exact SQL oracle.
* BPE (TOK-02/03/04): chunk counts with a partial+final hash aggregate, then
  training over the *distinct chunk* table (``bpe_train``: an index from pairs to
  places in the tasks, exact counts and a priority queue on the driver).
  Encoding runs per partition with a chunk cache of the task; the merge table is
  bounded by the vocabulary size, so shipping it to the tasks is safe.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.text import (N_BYTES, SPECIAL_TOKENS, SPLIT_PATTERN, byte_ids, col,
                                      pretokenize)
from tokenmill.operators import bpe_train
from tokenmill.session import small_batches

# ----------------------------------------------------------------------------- byte level


def byte_special_id(name: str) -> int:
    return N_BYTES + SPECIAL_TOKENS.index(name)


BYTE_BOS = byte_special_id("<|bos|>")


def byte_encode(df: DataFrame, text: str = "text", out: str = "ids", prepend: int | None = None,
                append: int | None = None) -> DataFrame:
    """TOK-13/TOK-04 (byte): ids column, optional special prepended/appended. A text's bytes become its ids in one
    Arrow conversion for a whole batch, whose bytes are bounded."""
    small_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        data = texts.cast(pa.large_binary())
        _, offsets, values = data.buffers()
        at = np.frombuffer(offsets, np.int64)[data.offset: data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        flat = np.frombuffer(values, np.uint8)[at[0]: at[-1]].astype(np.int32) if values is not None else np.zeros(0, np.int32)
        mask = data.is_null() if data.null_count else None
        return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(flat), mask=mask)

    ids = ids_of(col(text))
    if prepend is not None:
        ids = F.concat(F.array(F.lit(prepend)), ids)
    if append is not None:
        ids = F.concat(ids, F.array(F.lit(append)))
    return df.withColumn(out, ids)


def byte_vocab(spark: SparkSession) -> DataFrame:
    """Vocabulary table of the byte tokenizer: (token_id, token_hex, is_special, n_bytes, name)."""
    rows = [(i, f"{i:02X}", False, 1, None) for i in range(N_BYTES)]
    rows += [(N_BYTES + j, None, True, 0, s) for j, s in enumerate(SPECIAL_TOKENS)]
    return spark.createDataFrame(rows, "token_id int, token_hex string, is_special boolean, n_bytes int, name string")


# chunks that a task's encoding cache may hold
CACHE_CHUNKS = 500_000

# ----------------------------------------------------------------------------- chunks


def chunk_counts(df: DataFrame, text: str = "text", pattern: str = SPLIT_PATTERN,
                 unicode: bool = True) -> DataFrame:
    """TOK-02: distinct chunk -> occurrence count (map-side partial aggregation)."""
    return (df.select(F.explode(pretokenize(text, pattern, unicode)).alias("chunk"))
              .groupBy("chunk").agg(F.count(F.lit(1)).alias("n")))


# ----------------------------------------------------------------------------- BPE training


@dataclass
class BPEModel:
    """Merge table ``(left, right) -> new id`` in rank order; specials follow the merges."""

    merges: list[tuple[int, int]] = field(default_factory=list)

    @property
    def n_merges(self) -> int:
        return len(self.merges)

    @property
    def vocab_size(self) -> int:
        return N_BYTES + self.n_merges + len(SPECIAL_TOKENS)

    def special_id(self, name: str) -> int:
        return N_BYTES + self.n_merges + SPECIAL_TOKENS.index(name)

    def token_bytes(self) -> dict[int, bytes]:
        table = {i: bytes([i]) for i in range(N_BYTES)}
        for r, (a, b) in enumerate(self.merges):
            table[N_BYTES + r] = table[a] + table[b]
        return table

    def merges_df(self, spark: SparkSession) -> DataFrame:
        tb = self.token_bytes()
        rows = [(r, a, b, N_BYTES + r, tb[N_BYTES + r].hex().upper()) for r, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, merged int, merged_hex string")

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        """Vocabulary: (token_id, token_hex, is_special, n_bytes, name)."""
        tb = self.token_bytes()
        rows = [(i, b.hex().upper(), False, len(b), None) for i, b in tb.items()]
        rows += [(self.special_id(s), None, True, 0, s) for s in SPECIAL_TOKENS]
        return spark.createDataFrame(rows, "token_id int, token_hex string, is_special boolean, n_bytes int, name string")


def train_bpe(chunks: DataFrame, vocab_size: int, **sizes: int) -> BPEModel:
    """TOK-03: greedy BPE on a ``(chunk, n)`` table of any size; see ``bpe_train`` for how, and for ``sizes``."""
    n_merges = vocab_size - N_BYTES - len(SPECIAL_TOKENS)
    if n_merges < 0:
        raise ValueError(f"vocab_size must be >= {N_BYTES + len(SPECIAL_TOKENS)}")
    return BPEModel(bpe_train.train(chunks, n_merges, **sizes))


# ----------------------------------------------------------------------------- BPE encode / decode


def _encode_chunk(chunk: bytes, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Merges of the lowest rank first, left to right: a linked list of tokens and a heap of (rank, place), n log n in the chunk's length."""
    ids, n = list(chunk), len(chunk)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] is None or j >= n or ranks.get((ids[i], ids[j])) != r:
            continue  # one of the two has been merged since
        ids[i], ids[j], after[i] = N_BYTES + r, None, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (s := ranks.get((ids[i], ids[after[j]]))) is not None:
                heapq.heappush(heap, (s, i))
        if before[i] >= 0 and (s := ranks.get((ids[before[i]], ids[i]))) is not None:
            heapq.heappush(heap, (s, before[i]))
    return [t for t in ids if t is not None]


def bpe_encode(df: DataFrame, model: BPEModel, text: str = "text", out: str = "ids",
               prepend: str | int | None = None, append: str | int | None = None,
               pattern: str = SPLIT_PATTERN) -> DataFrame:
    """TOK-04: ordinary encode (special strings in text are plain text).

    The JVM splits text into chunks; an iterator UDF turns chunks into ids with a cache of bounded size that lives
    as long as the task.
    """
    ranks = {pair: r for r, pair in enumerate(model.merges)}
    small_batches(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, list[int]] = {}
        for chunks in batches:
            if len(cache) > CACHE_CHUNKS:
                cache.clear()
            res = []
            for cs in chunks:
                ids: list[int] = []
                for c in cs if cs is not None else ():
                    v = cache.get(c)
                    if v is None:
                        cache[c] = v = _encode_chunk(c.encode("utf-8"), ranks)
                    ids.extend(v)
                res.append(ids)
            yield pd.Series(res)

    ids = enc(pretokenize(text, pattern))
    if prepend is not None:
        pid = model.special_id(prepend) if isinstance(prepend, str) else prepend
        ids = F.concat(F.array(F.lit(pid)), ids)
    if append is not None:
        aid = model.special_id(append) if isinstance(append, str) else append
        ids = F.concat(ids, F.array(F.lit(aid)))
    return df.withColumn(out, ids)


def bpe_decode(df: DataFrame, model: BPEModel, ids: str = "ids", out: str = "text") -> DataFrame:
    """TOK-05: ids -> text, invalid UTF-8 replaced by U+FFFD. Specials decode to their names."""
    tb = model.token_bytes()
    names = {model.special_id(s): s.encode("utf-8") for s in SPECIAL_TOKENS}
    small_batches(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def dec(seqs: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else
                          b"".join(tb.get(int(i)) or names.get(int(i), b"") for i in s).decode("utf-8", "replace")
                          for s in seqs])

    return df.withColumn(out, dec(col(ids)))


def byte_decode(df: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    from tokenmill.functions.text import bytes_to_text
    return df.withColumn(out, bytes_to_text(ids))


# ----------------------------------------------------------------------------- vocab-level tables


def token_bytes_table(vocab: DataFrame, mode: str = "replace") -> DataFrame:
    """SNK-03: per id the UTF-8 length of its decoded text; specials 0.

    ``mode='replace'`` decodes each token alone with replacement, so a lone
    invalid byte counts 3 (U+FFFD); ``mode='raw'`` counts raw bytes.
    """
    if mode == "raw":
        return vocab.select("token_id", F.when(F.col("is_special"), 0).otherwise(F.col("n_bytes"))
                            .cast("int").alias("token_bytes"))

    @F.pandas_udf(T.IntegerType())
    def repl_len(h: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None else len(bytes.fromhex(x).decode("utf-8", "replace").encode("utf-8"))
                          for x in h])

    return vocab.select("token_id", F.when(F.col("is_special"), F.lit(0))
                        .otherwise(repl_len(F.col("token_hex"))).alias("token_bytes"))


def token_bytes_stats(tb: DataFrame) -> DataFrame:
    """TOK-11: min / max / mean / sample std of non-zero token byte lengths."""
    nz = tb.where(F.col("token_bytes") > 0)
    return nz.agg(F.min("token_bytes").cast("bigint").alias("min_bytes"),
                  F.max("token_bytes").cast("bigint").alias("max_bytes"),
                  F.round(F.avg("token_bytes"), 6).alias("mean_bytes"),
                  F.round(F.stddev_samp("token_bytes"), 6).alias("std_bytes"))


def special_id(vocab: DataFrame, name: str) -> DataFrame:
    """TOK-07: id of a special token by its exact string (fails if absent)."""
    hit = vocab.where(F.col("is_special") & (F.col("name") == name))
    return hit.agg(F.coalesce(F.max("token_id"), F.raise_error(F.lit(f"unknown special token {name}")))
                   .alias("token_id"))


def bos_id(vocab: DataFrame) -> DataFrame:
    """TOK-07: the bos special, falling back to an endoftext special."""
    sp = vocab.where(F.col("is_special"))
    return sp.agg(F.coalesce(F.max(F.when(F.col("name") == "<|bos|>", F.col("token_id"))),
                             F.max(F.when(F.col("name") == "<|endoftext|>", F.col("token_id"))),
                             F.raise_error(F.lit("no bos token"))).alias("bos_id"))


def vocab_info(vocab: DataFrame) -> DataFrame:
    """TOK-08: vocabulary size, number of specials, and the special set."""
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"),
                     F.count(F.when(F.col("is_special"), 1)).alias("n_special"),
                     F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_special"), F.col("name")))), ",")
                     .alias("specials"))


def compression(df: DataFrame, by: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """TOK-09: bytes, tokens and bytes/token per group."""
    return (df.groupBy(*by).agg(F.sum(F.octet_length(text)).cast("bigint").alias("n_bytes"),
                                F.sum(F.size(ids)).cast("bigint").alias("n_tokens"))
              .withColumn("ratio", F.round(F.col("n_bytes") / F.col("n_tokens"), 6)))


def compare_tokenizers(base: DataFrame, ours: DataFrame, on: list[str]) -> DataFrame:
    """TOK-10: relative token difference % and which tokenizer compresses better."""
    b = base.select(*on, F.col("n_tokens").alias("base_tokens"), F.col("ratio").alias("base_ratio"))
    o = ours.select(*on, F.col("n_tokens").alias("ours_tokens"), F.col("ratio").alias("ours_ratio"))
    j = b.join(o, on)
    return j.withColumn("rel_diff_pct", F.round((F.col("base_tokens") - F.col("ours_tokens"))
                                                / F.col("base_tokens") * 100.0, 6)) \
            .withColumn("better", F.when(F.col("ours_ratio") > F.col("base_ratio"), "ours")
                        .when(F.col("ours_ratio") < F.col("base_ratio"), "base").otherwise("tie"))


def roundtrip_failures(df: DataFrame, text: str = "text", decoded: str = "decoded") -> DataFrame:
    """TOK-06: rows whose decode(encode(text)) differs from text."""
    return df.where(~F.col(decoded).eqNullSafe(F.col(text)))


LN2 = math.log(2.0)


def save_tokenizer(spark: SparkSession, model: BPEModel, path: str) -> None:
    """SNK-02: merges and vocabulary of a model as two tables below ``path``."""
    model.merges_df(spark).write.mode("overwrite").parquet(f"{path}/merges")
    model.vocab_df(spark).write.mode("overwrite").parquet(f"{path}/vocab")


def exclude_specials(vocab: DataFrame) -> DataFrame:
    """SET-05: the vocabulary without its special tokens."""
    return vocab.where(~F.col("is_special"))


# ----------------------------------------------------------------------------- UDF-03: tokenizer protocol


class ByteTokenizer:
    """Tokenizer protocol, byte implementation: ``encode(df)``, ``decode(df)``, ``vocab()``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids", prepend: str | None = None) -> DataFrame:
        return byte_encode(df, text, out, prepend=byte_special_id(prepend) if prepend else None)

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        return byte_decode(df, ids, out)

    def vocab(self) -> DataFrame:
        return byte_vocab(self.spark)

    def special_id(self, name: str) -> int:
        return byte_special_id(name)


class BPETokenizer:
    """Tokenizer protocol, BPE implementation over a trained :class:`BPEModel`."""

    def __init__(self, spark: SparkSession, model: BPEModel):
        self.spark, self.model = spark, model

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids", prepend: str | None = None) -> DataFrame:
        return bpe_encode(df, self.model, text, out, prepend=prepend)

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        return bpe_decode(df, self.model, ids, out)

    def vocab(self) -> DataFrame:
        return self.model.vocab_df(self.spark)

    def special_id(self, name: str) -> int:
        return self.model.special_id(name)
