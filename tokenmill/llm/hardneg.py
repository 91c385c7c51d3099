"""Hard-negative mining over vectors by rotated one-bit codes with deterministic intervals.

A vector of integer components is rotated at random and coded by the signs of its coordinates; its alignment with that
code, the inner product with the unit code vector, is stored. What the code leaves over is rotated and coded
again, ``LEVELS`` times in all, and the norm of the last rest is stored too. An anchor is rotated alike and rounded to
``PLANES`` bits a coordinate, so its inner product with a code is a sum of popcounts over bit planes. The sum over the
levels, each times its alignment, estimates the score; by Cauchy-Schwarz the rest and the rounding add no more than a known amount to
either side. Rows whose interval can't matter are dropped, all others get their integer score, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import bounded_batches, saved

#: One-bit codes of a vector, and bits of a rounded coordinate of an anchor.
LEVELS, PLANES = 4, 8
#: Anchors of one pass over the rows: what is broadcast is bounded by it, whatever the number of rows.
ANCHORS_A_PASS = 8_192
#: Rows that a task goes through; the rows it returns depend on the anchors of the pass only.
ROWS_A_TASK = 131_072
#: Cells (rows times anchors) of one matrix of estimates; pairs scored at once.
CELLS, PAIRS = 1 << 20, 1 << 17

_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("ints", pa.binary()), ("codes", pa.binary()),
                    ("aligned", pa.binary()), ("rest", pa.float64())])
_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def rotation(dims: int, seed: int = 1) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def integers(vectors: list, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; short vectors end in zeros. A score always fits a long, as components end at sqrt(2^62 / dims)."""
    most = float(int((2.0**62 / dims) ** 0.5))
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return np.clip(np.floor(scale * out), -most, most).astype(np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    words = -(-bits.shape[-1] // 64)
    wide = np.zeros((*bits.shape[:-1], words * 64), np.uint8)
    wide[..., :bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def encoded(ints: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, norm of the rest) of each row."""
    rest, codes, aligned = ints.astype(float), [], []
    unit = 1 / ints.shape[1] ** 0.5
    for _ in range(levels):
        rest = rest @ turn
        sign = np.where(rest >= 0, unit, -unit)
        a = (rest * sign).sum(1)
        codes.append(packed(rest >= 0))
        aligned.append(a)
        rest = rest - a[:, None] * sign
    return np.stack(codes, 1), np.stack(aligned, 1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Anchors of one pass, rotated and cut into bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, turn: np.ndarray, levels: int = LEVELS, planes: int = PLANES):
        self.ids, self.labels, self.ints, self.levels, self.planes = ids, labels, ints, levels, planes
        self.norm = np.linalg.norm(ints.astype(float), axis=1)
        q, self.bits, self.low, self.step, self.total, self.off = ints.astype(float), [], [], [], [], []
        for _ in range(levels):
            q = q @ turn
            low = q.min(1, initial=0)
            step = np.maximum((q.max(1, initial=0) - low) / (2**planes - 1), 1e-300)
            u = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
            self.bits.append(np.stack([packed((u >> b) & 1 == 1) for b in range(planes)]))
            self.low.append(low)
            self.step.append(step)
            self.total.append(u.sum(1))
            self.off.append(np.linalg.norm(q - (low[:, None] + step[:, None] * u), axis=1))

    def intervals(self, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible score of each row with each of ``some`` anchors."""
        dims = self.ints.shape[1]
        guess = np.zeros((len(codes), len(self.ids[some])))
        half = rest[:, None] * self.norm[some]
        for k in range(self.levels):
            count = np.zeros(guess.shape, np.int64)
            for b in range(self.planes):
                for w in range(codes.shape[2]):
                    count += np.bitwise_count(codes[:, k, w, None] & self.bits[k][b, some, w]).astype(np.int64) << b
            ones = np.bitwise_count(codes[:, k]).sum(1, dtype=np.int64)[:, None]
            inner = self.step[k][some] * (2 * count - self.total[k][some]) + self.low[k][some] * (2 * ones - dims)
            guess += (aligned[:, k] / dims ** 0.5)[:, None] * inner
            half += aligned[:, k, None] * self.off[k][some]
        half += 1 + 1e-9 * (rest[:, None] + aligned.sum(1)[:, None]) * self.norm[some]  # for rounding
        return guess - half, guess + half


class Best:
    """The first ``k`` (score, id) of each key: higher scores first, then smaller ids."""

    def __init__(self, keys: int, k: int):
        self.k, self.edge = k, np.full(keys, -np.inf)
        self.held = tuple(np.empty(0, np.int64) for _ in range(3))
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.new.append((key, score, ident))
        self.waiting += len(key)
        if self.waiting > max(100_000, len(self.held[0])):
            self.merge()

    def merge(self) -> None:
        key, score, ident = (np.concatenate(x) for x in zip(self.held, *self.new))
        self.new, self.waiting = [], 0
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        at = np.arange(len(key)) - np.searchsorted(key, key)
        last = at == self.k - 1
        self.edge[key[last]] = score[last]
        self.held = tuple(x[at < self.k] for x in (key, score, ident))


def _search(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int, dims: int, windows: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """The first k rows of each anchor, or of each of its windows, among the rows of a task.

    Without windows: other rows of the anchor's label. With (low, high), one column a window: rows of other labels
    with low <= score <= high.
    """
    slots = 1 if windows is None else windows[0].shape[1]
    best = Best(len(anchors.ids) * slots, k)
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        ids, labels = (batch[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        read = lambda c, kind: np.frombuffer(b"".join(batch[c].to_pylist()), kind)
        ints = read("ints", np.int64).reshape(rows, dims)
        aligned = read("aligned", np.float64).reshape(rows, anchors.levels)
        codes = read("codes", np.uint64).reshape(rows, anchors.levels, -1)
        rest = batch["rest"].to_numpy()
        step = max(1, CELLS // rows)
        for low in range(0, len(anchors.ids), step):
            some = slice(low, low + step)
            least, most = anchors.intervals(codes, aligned, rest, some)
            same = labels[:, None] == anchors.labels[some]
            if windows is None:
                keep = same & (ids[:, None] != anchors.ids[some]) & (most >= best.edge[some])
            else:
                edge = best.edge.reshape(-1, slots)[some]
                opens = np.maximum(windows[0][some], edge).min(1, initial=np.inf)
                keep = ~same & (most >= opens) & (least <= windows[1][some].max(1, initial=-1))
            row, anchor = np.nonzero(keep)
            anchor += low
            for a in range(0, len(row), PAIRS):
                r, q = row[a:a + PAIRS], anchor[a:a + PAIRS]
                score = np.einsum("ij,ij->i", ints[r], anchors.ints[q])
                for slot in range(slots):
                    take = slice(None)
                    if windows is not None:
                        take = (score >= windows[0][q, slot]) & (score <= windows[1][q, slot])
                    best.add(q[take] * slots + slot, score[take], ids[r][take])
    best.merge()
    key, score, ident = best.held
    for a in range(0, len(key), 10_000):
        part = slice(a, a + 10_000)
        yield pa.RecordBatch.from_pydict({"anchor": anchors.ids[key[part] // slots], "slot": (key[part] % slots).astype(np.int32),
                                          "score": score[part], "vec_id": ident[part]}, schema=_FOUND)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one for each id."""
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    again = saved(some.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if again.isEmpty():
        return some
    one = some.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.*")
    return some.join(again, "vec_id", "left_anti").union(one)


def coded(rows: DataFrame, dims: int, turn, scale: int, levels: int = LEVELS) -> DataFrame:
    """Integer components, codes, alignments and the norm of the rest for each usable row. ``turn``: broadcast rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = integers(batch["vector"].to_pylist(), dims, scale)
            codes, aligned, rest = encoded(ints, turn.value, levels)
            as_bytes = lambda x: [r.tobytes() for r in x]
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"], "ints": as_bytes(ints), "codes": as_bytes(codes),
                                              "aligned": as_bytes(aligned), "rest": rest}, schema=_CODED)

    return rows.mapInArrow(run, "vec_id long, label long, ints binary, codes binary, aligned binary, rest double")


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   anchors_a_pass: int = ANCHORS_A_PASS, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label, embedding; ``is_anchor`` is a condition on vec_id and label. A row's score is the inner
    product of floor(scale * x) with the anchor's. An anchor's positives are its first ``positives`` other rows of the same label; for each,
    the first ``negatives`` rows of another label with low * positive_score <= 100 * score <= high * positive_score come back.
    Higher scores come first, then smaller ids.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows without an id, which could
    not be named. Rows that share an id count once, as the least (label, vector). Short vectors count as filled up with zeros.
    Components are held within sqrt(2^62 / dims) so that a score fits a long. No rows, no anchors or no positives give no rows. Other columns are ignored.

    The anchors are a stated query set against all rows: they go in blocks of about ``anchors_a_pass``, which are broadcast, and each block passes
    over the rows twice. A task returns the first few rows of each anchor, not pairs. Nothing else is collected.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    some = saved(usable(rows).repartition(max(spark.sparkContext.defaultParallelism, rows.count() // rows_a_task)))
    dims = some.agg(F.max(F.size("vector"))).first()[0] or 1
    turn = spark.sparkContext.broadcast(rotation(dims))
    table = saved(coded(some, dims, turn, scale))
    chosen = saved(table.where(is_anchor).select("vec_id", "label", "ints"))
    blocks = -(-chosen.count() // anchors_a_pass)
    first = lambda df, by, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    schema, out = "anchor long, slot int, score long, vec_id long", []
    for block in range(blocks):
        held = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
        if not held:
            continue
        ints = np.frombuffer(b"".join(r.ints for r in held), np.int64).reshape(len(held), dims)
        anchors = spark.sparkContext.broadcast(Anchors(np.array([r.vec_id for r in held]), np.array([r.label for r in held]), ints, turn.value))
        near = first(table.mapInArrow(lambda b, a=anchors: _search(b, a.value, positives, dims, None), schema), ["anchor"], positives)
        near = saved(near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        bound = np.zeros((len(held), positives), np.int64), np.full((len(held), positives), -1, np.int64)  # empty windows
        place = {r.vec_id: i for i, r in enumerate(held)}
        for r in near.collect():  # at most ``positives`` a row of the block
            at = place[r.anchor], r.slot
            bound[0][at], bound[1][at] = -(-low * r.positive_score // 100), high * r.positive_score // 100
        limits = spark.sparkContext.broadcast(bound)
        far = first(table.mapInArrow(lambda b, a=anchors, w=limits: _search(b, a.value, negatives, dims, w.value), schema), ["anchor", "slot"], negatives)
        out.append(saved(far.join(near, ["anchor", "slot"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))))
        anchors.unpersist()
        limits.unpersist()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out) if out else empty
