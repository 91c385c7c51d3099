"""Sequence packing.

A *pack plan* is computed on lengths only: input ``(group, pos, doc_id, n_tokens)``,
output ``(group, row_id, slot, doc_id, take, n_tokens)`` -- "row ``row_id``
takes the first ``take`` tokens of ``doc_id``". Tokens are joined afterwards,
so the sequential step never carries text.

* :func:`pack_concat` (PCK-06) is declarative: a global prefix sum of lengths
  and an ``explode(sequence(first_row, last_row))``.
* Best-fit / greedy / first-fit-decreasing (PCK-01..05) are sequential per
  group (= a data-parallel rank's part of a stretch of shards). Each group is streamed
  through ``mapInPandas`` in ``pos`` order with a bounded buffer; state is
  the buffer, never the group.
"""

from __future__ import annotations

import bisect
import heapq
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.operators.ordering import prefix_sum

PLAN_SCHEMA = "grp bigint, row_id bigint, slot int, doc_id bigint, take bigint, n_tokens bigint"


# ----------------------------------------------------------------------------- declarative packers


def pack_concat(df: DataFrame, row_len: int, order: Sequence[str] = ("pos",), n: str = "n_tokens",
                bucket=None) -> DataFrame:
    """PCK-06: concatenate documents and cut the stream into ``row_len``-token rows.

    Returns ``(row_id, doc_id, start, take)``; a document crossing a row
    boundary appears in several rows.
    """
    p = prefix_sum(df, n, list(order), name="off", exclusive=True, bucket=bucket)
    first = (F.col("off") / row_len).cast("bigint")
    last = ((F.col("off") + F.col(n) - 1) / row_len).cast("bigint")
    e = p.where(F.col(n) > 0).withColumn("row_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("off"), F.col("row_id") * row_len)
    hi = F.least(F.col("off") + F.col(n), (F.col("row_id") + 1) * row_len)
    return e.select("row_id", "doc_id", (lo - F.col("off")).alias("start"), (hi - lo).alias("take"), "off", n)


def shift_targets(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """PCK-08: inputs = row[:-1], targets = row[1:]."""
    t = F.col(tokens)
    n = F.size(t) - 1
    return rows.withColumn("inputs", F.slice(t, 1, n)).withColumn("targets", F.slice(t, 2, n))


def pad_batch(df: DataFrame, by: Sequence[str], ids: str = "ids", pad_id: int = 0) -> DataFrame:
    """PCK-09: right-pad every sequence to the longest one of its batch."""
    mx = F.max(F.size(ids)).over(Window.partitionBy(*by))
    return df.withColumn("batch_len", mx).withColumn(
        "padded", F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), (F.col("batch_len") - F.size(ids)).cast("int"))))


def doc_boundaries(rows: DataFrame, tokens: str = "tokens", bos: int = 256) -> DataFrame:
    """PCK-10: 0-based positions of BOS tokens in each packed row."""
    pos = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.element_at(F.col(tokens), i + 1) == bos)
    return rows.withColumn("bos_positions", pos)


def min_crop(lengths: DataFrame, capacity: int, n: str = "n_tokens") -> DataFrame:
    """PCK-07 lower bound: share of tokens beyond the capacity (they can never fit)."""
    return lengths.agg(F.sum(F.greatest(F.col(n) - capacity, F.lit(0))).cast("bigint").alias("beyond"),
                       F.sum(n).cast("bigint").alias("total")) \
                  .withColumn("min_crop_pct", F.round(F.col("beyond") * 100.0 / F.col("total"), 6))


def pack_report(plan: DataFrame, capacity: int, by: Sequence[str] = ()) -> DataFrame:
    """PCK-07: utilisation, crop and pad percentages of a plan (every doc placed once)."""
    a = plan.groupBy(*by).agg(F.sum("take").alias("kept"), F.sum("n_tokens").alias("consumed"),
                              F.count(F.lit(1)).alias("n_docs"), F.countDistinct("grp", "row_id").alias("n_rows"))
    slots = F.col("n_rows") * capacity
    return a.select(*by, F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_docs").cast("bigint").alias("n_docs"),
                    F.round(F.col("kept") * 100.0 / slots, 6).alias("util_pct"),
                    F.round((F.col("consumed") - F.col("kept")) * 100.0 / F.col("consumed"), 6).alias("crop_pct"),
                    F.round((slots - F.col("kept")) * 100.0 / slots, 6).alias("pad_pct"))


def pack_progress(per_row: DataFrame, size, rows_per_task: int | None = None) -> DataFrame:
    """PCK-11: ``(grp, row_id, new_docs)`` -> consumed / size per row (clamped) and the last-row flag.

    Runs on the per-row table (one row per packed sequence, not per token). With ``rows_per_task`` the rows are one
    sequence of dense row ids, summed up in stretches; ``size`` is a number or a scalar subquery.
    """
    w = Window.partitionBy("grp").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    c = per_row.withColumn("consumed", F.sum("new_docs").over(w)) if rows_per_task is None else prefix_sum(
        per_row, "new_docs", ["row_id"], name="consumed", bucket=F.floor(F.col("row_id") / rows_per_task))
    return c.withColumn("progress", F.least(F.lit(1.0), F.col("consumed") / size)) \
            .withColumn("last_step", F.col("consumed") >= size)


def rows_of_plan(plan: DataFrame) -> DataFrame:
    """Per-row new-document counts of a kernel plan (each doc placed once)."""
    return plan.groupBy("grp", "row_id").agg(F.count(F.lit(1)).alias("new_docs"))


# ----------------------------------------------------------------------------- sequential kernels


class _Buffer:
    """Docs by length; ties resolved by insertion order (the reference scans its list)."""

    def __init__(self):
        self.by_len: dict[int, deque] = {}
        self.lens: list[int] = []
        self.size = 0

    def add(self, doc_id: int, n: int) -> None:
        q = self.by_len.get(n)
        if q is None:
            q = self.by_len[n] = deque()
            bisect.insort(self.lens, n)
        q.append(doc_id)
        self.size += 1

    def _pop(self, n: int) -> tuple[int, int]:
        q = self.by_len[n]
        d = q.popleft()
        if not q:
            del self.by_len[n]
            self.lens.pop(bisect.bisect_left(self.lens, n))
        self.size -= 1
        return d, n

    def largest_fitting(self, room: int):
        i = bisect.bisect_right(self.lens, room)
        return self._pop(self.lens[i - 1]) if i > 0 else None

    def shortest(self):
        return self._pop(self.lens[0])


def _batches(docs: Iterable[tuple[int, int, object]]) -> Iterator[list[tuple[int, int]]]:
    """Group consecutive docs sharing a batch key (the reader's refill unit)."""
    cur, key = [], object()
    for d, n, b in docs:
        if cur and b != key:
            yield cur
            cur = []
        key = b
        cur.append((d, n))
    if cur:
        yield cur


class BestFitPacker:
    """Push-based best fit: docs arrive in refill batches. A placement happens only once the buffer is full or the
    input has ended. The largest doc that fits goes first (the earliest of equals); when nothing fits, the row is
    completed by cropping the shortest doc, or by padding. Over-long docs never fit in pad mode: callers divert them.
    """

    def __init__(self, capacity: int, buffer: int, crop: bool):
        self.capacity, self.buffer, self.crop = capacity, buffer, crop
        self.buf = _Buffer()
        self.row, self.pos, self.slot, self.started = 0, 0, 0, False

    def _end_row(self):
        self.row, self.pos, self.slot, self.started = self.row + 1, 0, 0, False

    def add_batch(self, batch):
        for d, n in batch:
            self.buf.add(d, n)
        yield from self.pump(final=False)

    def pump(self, final: bool):
        while True:
            if self.buf.size < self.buffer and not final:
                return
            if self.buf.size == 0:
                if self.started:
                    self._end_row()
                return
            hit = self.buf.largest_fitting(self.capacity - self.pos)
            if hit is not None:
                d, n = hit
                yield self.row, self.slot, d, n, n
                self.pos += n
            elif self.crop:
                d, n = self.buf.shortest()
                yield self.row, self.slot, d, self.capacity - self.pos, n
                self.pos = self.capacity
            else:
                self._end_row()  # pad the rest of the row
                continue
            self.slot += 1
            self.started = True
            if self.pos >= self.capacity:
                self._end_row()


def bestfit(docs: Iterable[tuple[int, int, object]], capacity: int, buffer: int, crop: bool
            ) -> Iterator[tuple[int, int, int, int, int]]:
    """PCK-01 (crop=True) / PCK-02 (crop=False). Yields (row, slot, doc, take, n)."""
    packer = BestFitPacker(capacity, buffer, crop)
    for batch in _batches(docs):
        yield from packer.add_batch(batch)
    yield from packer.pump(final=True)


def greedy(docs: Iterable[tuple[int, int, object]], capacity: int, crop: bool
           ) -> Iterator[tuple[int, int, int, int, int]]:
    """PCK-03 (crop) / PCK-04 (pad): documents in order, no look-ahead.

    crop: an overflowing doc fills the row and its rest is discarded.
    pad: an overflowing doc starts the next row; a doc longer than a whole
    row is cropped to the capacity.
    """
    row, pos, slot = 0, 0, 0
    for d, n, _ in docs:
        if pos > 0 and n > capacity - pos:
            if crop:
                yield row, slot, d, capacity - pos, n
                row, pos, slot = row + 1, 0, 0
                continue
            row, pos, slot = row + 1, 0, 0
        take = min(n, capacity - pos)
        yield row, slot, d, take, n
        pos += take
        slot += 1
        if pos >= capacity:
            row, pos, slot = row + 1, 0, 0


def ffd(docs: Iterable[tuple[int, int, object]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """PCK-05: first-fit decreasing over the whole group; docs come longest first (:func:`pack` sorts them).

    Docs longer than the capacity are cropped to it; rows are padded. The open rows are filed by their free room, and a tree over the rooms
    has the lowest row of every range of them, so the first row with room enough is found in log2(capacity) steps. Full rows are forgotten.
    """
    none, leaves = float("inf"), 1 << capacity.bit_length()
    tree: list[float] = [none] * (2 * leaves)
    rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    state: dict[int, list[int]] = {}  # row -> [free room, next slot]
    made = 0

    def file(room: int) -> None:
        k = leaves + room
        tree[k] = rows[room][0] if rows[room] else none
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    for d, n, _ in docs:
        take = min(n, capacity)
        k, row = leaves + take, tree[leaves + take]
        while k > 1:  # what lies to the right has more room
            if not k & 1:
                row = min(row, tree[k + 1])
            k >>= 1
        if row == none:
            row, made = made, made + 1
            state[row] = [capacity, 0]
        else:
            heapq.heappop(rows[state[row][0]])
            file(state[row][0])
        room, slot = state[row]
        yield row, slot, d, take, n
        if left := room - take:
            state[row] = [left, slot + 1]
            heapq.heappush(rows[left], row)
            file(left)
        else:
            del state[row]


def pack_rejects(df: DataFrame, capacity: int, n: str = "n_tokens") -> DataFrame:
    """PCK-02 companion: items longer than the capacity (they would block a pad buffer)."""
    return df.where(F.col(n) > capacity)


ALGOS = ("bestfit_crop", "bestfit_pad", "greedy_crop", "greedy_pad", "ffd")


def run_kernel(algo: str, docs, capacity: int, buffer: int):
    if algo == "bestfit_crop":
        return bestfit(docs, capacity, buffer, crop=True)
    if algo == "bestfit_pad":
        return bestfit(docs, capacity, buffer, crop=False)
    if algo == "greedy_crop":
        return greedy(docs, capacity, crop=True)
    if algo == "greedy_pad":
        return greedy(docs, capacity, crop=False)
    if algo == "ffd":
        return ffd(docs, capacity)
    raise ValueError(algo)


def pack(df: DataFrame, algo: str, capacity: int, buffer: int = 1000, group: str = "rank", order: str = "pos",
         n: str = "n_tokens", batch: str | None = None, batch_size: int = 128) -> DataFrame:
    """PCK-01..05 plan: one sequential pass per group with a bounded buffer.

    Rows are hash-partitioned by ``group`` into as many partitions as the session has for shuffles (a fixed number,
    so that small groups aren't merged into one task) and sorted by ``(group, order)`` inside each, by length first
    for first-fit decreasing; the kernel streams the Arrow batches of a partition and restarts whenever the group changes.
    """
    if algo not in ALGOS:
        raise ValueError(f"unknown packing algorithm {algo}")
    if algo == "bestfit_pad":
        df = df.where(F.col(n) <= capacity)  # over-long items never fit: see pack_rejects
    bcol = F.col(batch) if batch else (F.col(order) / batch_size).cast("bigint")
    src = (df.select(F.col(group).cast("bigint").alias("grp"), F.col(order).cast("bigint").alias("pos"),
                     F.col("doc_id").cast("bigint").alias("doc_id"), F.col(n).cast("bigint").alias("n"),
                     bcol.cast("bigint").alias("bkey"))
             .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp"))
    first = [F.desc(F.least(F.col("n"), F.lit(capacity)))] if algo == "ffd" else []
    src = src.sortWithinPartitions("grp", *first, "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for pdf in batches:
                yield from pdf.itertuples(index=False)

        it = rows()
        first = next(it, None)
        while first is not None:
            g = first.grp
            nxt = [None]

            def docs_of_group(head=first):
                yield head.doc_id, head.n, head.bkey
                for r in it:
                    if r.grp != g:
                        nxt[0] = r
                        return
                    yield r.doc_id, r.n, r.bkey

            cols = ["row_id", "slot", "doc_id", "take", "n_tokens"]
            chunk = []
            for rec in run_kernel(algo, docs_of_group(), capacity, buffer):
                chunk.append(rec)
                if len(chunk) == 65536:
                    yield pd.DataFrame(chunk, columns=cols).assign(grp=g)[["grp", *cols]]
                    chunk = []
            if chunk:
                yield pd.DataFrame(chunk, columns=cols).assign(grp=g)[["grp", *cols]]
            first = nxt[0]

    return src.mapInPandas(run, PLAN_SCHEMA)


# ----------------------------------------------------------------------------- UDF-05: packing as a table function


def make_pack_udtf(capacity: int, buffer: int, crop: bool = True):
    """UDF-05: ``SELECT * FROM pack(TABLE(t) PARTITION BY grp ORDER BY pos)``.

    Spark hands each partition's rows in order to one instance, as Arrow batches; the state is the bounded buffer
    plus the pending refill batch.
    """
    names = ["row_id", "slot", "doc_id", "take", "n_tokens"]

    class Pack:
        def __init__(self):
            self.packer = BestFitPacker(capacity, buffer, crop)
            self.grp, self.key, self.pending = None, None, []

        def _table(self, placed) -> pa.Table:
            columns = list(zip(*placed)) or [[]] * 5
            made = {"grp": pa.array([self.grp] * len(columns[0]), pa.int64())}
            return pa.table(made | {c: pa.array(v, pa.int32() if c == "slot" else pa.int64()) for c, v in zip(names, columns)})

        def eval(self, batch):
            doc, n, key = (batch[c].to_pylist() for c in ("doc_id", "n", "bkey"))
            if not doc:
                return
            self.grp, placed = batch["grp"][0].as_py(), []
            for d, size, k in zip(doc, n, key):
                if self.pending and k != self.key:
                    placed += self.packer.add_batch(self.pending)
                    self.pending = []
                self.key = k
                self.pending.append((d, size))
            yield self._table(placed)

        def terminate(self):
            yield self._table([*self.packer.add_batch(self.pending), *self.packer.pump(final=True)])

    return F.arrow_udtf(Pack, returnType="grp bigint, row_id bigint, slot int, doc_id bigint, take bigint, n_tokens bigint")
