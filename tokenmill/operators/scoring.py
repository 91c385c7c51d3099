"""Count-based next-token scorer and bits per byte.

No model runs here. Scores come from a bigram count model trained by Spark on
the train split: ``p(b | a) = (c(a,b) + 1) / (c(a) + V)`` (add-one smoothing),
``loss = -ln p``. The model table has at most ``(V + specials) * V`` rows, a
bound fixed by the vocabulary, so it is safe to broadcast.

The heavy step is one scan of the corpus that counts adjacent pairs batch by
batch in numpy; everything after that works on the small pair-count table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import N_BYTES, SPECIAL_TOKENS
from tokenmill.operators.ordering import checked_broadcast
from tokenmill.operators.tokenizer import BYTE_BOS
from tokenmill.session import small_batches

LN2 = math.log(2.0)


def adjacent_pairs(ids: str | Column) -> Column:
    """(a, b) structs for every adjacent pair of an id array."""
    c = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(c)
    return F.arrays_zip(F.slice(c, 1, n - 1).alias("a"), F.slice(c, 2, n - 1).alias("b"))


def pair_counts(df: DataFrame, by: Sequence[str], ids: str | Column) -> DataFrame:
    """(by..., a, b, n): adjacent pair counts per group, partial-aggregated map side."""
    p = df.select(*by, F.explode(adjacent_pairs(ids)).alias("p"))
    return p.groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.count(F.lit(1)).alias("n"))


def byte_pair_counts(docs: DataFrame, by: Sequence[str], text: str = "text", bos: int = BYTE_BOS) -> DataFrame:
    """Pair counts of BOS + UTF-8 bytes per document, grouped by ``by``.

    Each Arrow batch is counted with one ``bincount`` per group over ``a * width + b``; what leaves a batch is at
    most groups x width^2 partial counts, which Spark then sums. Null texts are empty.
    """
    small_batches(docs.sparkSession)
    width = max(N_BYTES, bos) + 1
    schema = docs.select(*by).schema.add("a", "integer").add("b", "integer").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[bytes]] = {}
            for key, t in zip(zip(*(batch[c].to_pylist() for c in by)) if by else repeat(()), batch["_text"].to_pylist()):
                if t:
                    groups.setdefault(key, []).append(t)
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, texts in groups.items():
                ends = np.cumsum([len(t) for t in texts])
                data = np.frombuffer(b"".join(texts), np.uint8)
                left = np.empty(len(data), np.int32)
                left[1:] = data[:-1]
                left[0], left[ends[:-1]] = bos, bos
                counts = np.bincount(left * width + data, minlength=width * width)
                seen = np.flatnonzero(counts)
                for c, v in zip(by, key):
                    out[c].append(pa.array([v] * len(seen), batch.schema.field(c).type))
                out["a"].append(pa.array(seen // width, pa.int32()))
                out["b"].append(pa.array(seen % width, pa.int32()))
                out["n"].append(pa.array(counts[seen], pa.int64()))
            if groups:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(v) for v in out.values()], names=list(out))

    rows = docs.select(*by, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, schema).groupBy(*by, "a", "b").agg(F.sum("n").alias("n"))


def bigram_model(pairs: DataFrame, train: Column | None = None, vocab: int = N_BYTES) -> tuple[DataFrame, DataFrame]:
    """(a, b, c_ab) and (a, c_a) tables from pair counts.

    ``train`` selects the training rows with a *conditional sum* rather than
    a filter: the filter would be pushed below the pair-count aggregate and
    make the plan scan the corpus again, while the conditional form keeps the
    subtree identical to the evaluation side so the shuffle is reused.
    """
    w = F.col("n") if train is None else F.when(train, F.col("n"))
    c_ab = pairs.groupBy("a", "b").agg(F.sum(w).alias("c_ab")).where(F.col("c_ab") > 0)
    c_a = c_ab.groupBy("a").agg(F.sum("c_ab").alias("c_a"))
    return c_ab, c_a


def score_pairs(pairs: DataFrame, model: tuple[DataFrame, DataFrame], vocab: int = N_BYTES) -> DataFrame:
    """Attach ``loss = -ln p(b|a)`` to a pair table (unseen contexts get 1/V)."""
    c_ab, c_a = model
    bound = (vocab + len(SPECIAL_TOKENS)) * vocab
    j = (pairs.join(checked_broadcast(c_ab, bound), ["a", "b"], "left")
              .join(checked_broadcast(c_a, vocab + len(SPECIAL_TOKENS)), ["a"], "left"))
    p = (F.coalesce(F.col("c_ab"), F.lit(0)) + 1.0) / (F.coalesce(F.col("c_a"), F.lit(0)) + float(vocab))
    return j.withColumn("loss", -F.log(p)).drop("c_ab", "c_a")


def argmax_table(model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Most likely next token per context (ties: smallest id): (a, argmax_token)."""
    c_ab, _ = model
    return c_ab.groupBy("a").agg(F.min_by("b", F.struct(-F.col("c_ab"), F.col("b"))).alias("argmax_token"))


def bits_per_byte(scored: DataFrame, by: Sequence[str], loss: str = "loss", n_bytes: str = "token_bytes",
                  weight: str | None = None) -> DataFrame:
    """AGG-01: sum(loss over targets with bytes>0) / (ln 2 * sum(bytes)); inf when no bytes.

    Targets < 0 (ignored) must already be filtered (FLT-14) or carry 0 bytes.
    """
    w = F.col(weight) if weight else F.lit(1)
    valid = F.col(n_bytes) > 0
    agg = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(valid, w)).cast("bigint").alias("n_targets"),
        F.sum(F.when(valid, F.col(n_bytes) * w)).cast("bigint").alias("n_bytes"),
        F.sum(F.when(valid, F.col(loss) * w)).alias("_loss"))
    return agg.select(*by, F.coalesce("n_targets", F.lit(0)).cast("bigint").alias("n_targets"),
                      F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("n_bytes"),
                      F.when(F.coalesce("n_bytes", F.lit(0)) == 0, F.lit(float("inf")))
                       .otherwise(F.round(F.col("_loss") / (F.lit(LN2) * F.col("n_bytes")), 6)).alias("bpb"))


def valid_targets(tokens: DataFrame, token_bytes: DataFrame, target: str = "target") -> DataFrame:
    """FLT-14 + JN-03: keep targets >= 0 and attach their byte length (0 when unknown).

    The vocabulary is broadcast by name: Spark knows nothing of its size, and takes targets from an ``explode`` for few; by
    itself it would collect those on the driver.
    """
    tb = token_bytes.select(F.col("token_id").alias(target), "token_bytes")  # one row per vocabulary entry
    j = tokens.where(F.col(target) >= 0).join(F.broadcast(tb), target, "left")
    return j.withColumn("token_bytes", F.coalesce("token_bytes", F.lit(0))).where(F.col("token_bytes") > 0)


def with_token_bytes(tokens: DataFrame, token_bytes: DataFrame, target: str = "target") -> DataFrame:
    """JN-03: token -> byte length, 0 for ignored targets and specials."""
    tb = token_bytes.select(F.col("token_id").alias(target), "token_bytes")  # one row per vocabulary entry
    return tokens.join(tb, target, "left").withColumn(
        "token_bytes", F.when(F.col(target) < 0, 0).otherwise(F.coalesce("token_bytes", F.lit(0))))


def align_next(scores: DataFrame, seq: str = "seq_id", pos: str = "pos", token: str = "token") -> DataFrame:
    """EVL-07: the score at position p belongs to token p+1; the last position has none."""
    w = Window.partitionBy(seq).orderBy(pos)
    return scores.withColumn("target", F.lead(token).over(w))


def corpus_bpb(docs: DataFrame, by: Sequence[str], vocab: int = N_BYTES) -> DataFrame:
    """Flagship: byte tokenizer -> bigram count model on train -> bpb per (split, by...).

    ``docs`` needs ``split`` and ``text``. The corpus is scanned once into the
    pair-count table (partial aggregation map side; at most groups x V^2
    rows). The model counts are windows over that small table -- partitioned
    by ``a`` and then by ``(a, b)``, which needs no second shuffle -- so no
    branch of the plan rescans the corpus.
    """
    keys = ["split", *by]
    pc = byte_pair_counts(docs, keys)
    tr = F.when(F.col("split") == "train", F.col("n"))
    m = pc.withColumn("c_a", F.sum(tr).over(Window.partitionBy("a"))) \
          .withColumn("c_ab", F.sum(tr).over(Window.partitionBy("a", "b")))
    p = (F.coalesce(F.col("c_ab"), F.lit(0)) + 1.0) / (F.coalesce(F.col("c_a"), F.lit(0)) + float(vocab))
    scored = m.withColumn("loss", -F.log(p)).withColumn("token_bytes", F.lit(1))
    return bits_per_byte(scored, keys, weight="n")
