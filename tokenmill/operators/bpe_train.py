"""TOK-03: greedy byte-pair training on a distributed table of distinct chunks.

A round takes the most frequent pairs, in order of merging: the hot ones, by exact counts. The tasks cut every chunk between the tokens of a
pair that is not hot. Equal pieces are added up, and the driver merges on these few pieces. Its counts are exact as long as the next
pair is not after the last hot one in order. For the count of a pair never grows, and a pair of a new token lies where one older pair, always the
same, lay before: it is at most as frequent and has a larger id. So if that pair was not hot, the new one comes after it, and after the last hot
one. The first merge of a round always stands, and the merge list is the greedy one, however few pairs are hot. The tasks then make these merges on
all chunks, through an index from pairs to their places.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import N_BYTES, byte_ids
from tokenmill.session import cut_lineage

#: Distinct pieces that the driver merges on in a round, and their ids at most (about 60 bytes of memory for each).
SAMPLE_CHUNKS, SAMPLE_BYTES = 400_000, 1_500_000
#: Token ids that a task indexes at a time.
BLOCK_IDS = 2_000_000
#: Hot pairs of a round: in the first one, at most.
FIRST_HOT, MOST_HOT = 32, 32_768
#: Merges made again in each round before the chunk table is written with them.
REPLAYED = 256

_COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_PIECES = pa.schema([("ids", pa.binary()), ("n", pa.int64())])
_CHUNKS = pa.schema([("ids", pa.list_(pa.int32())), ("n", pa.int64())])
MASK = 0xFFFFFFFF


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their weights' sums, without those of sum zero."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.add.reduceat(weights, first)
    return keys[first][sums != 0], sums[sums != 0]


class PairIndex:
    """Weighted id sequences as linked lists, with the places of every adjacent pair."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, n: np.ndarray):
        self.tok = ids.astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(len(ids), dtype=np.int32)
        self.nxt, self.prv = at + np.int32(1), at - np.int32(1)
        if len(ids):
            self.nxt[ends[sizes > 0] - 1] = -1
            self.prv[(ends - sizes)[sizes > 0]] = -1
        self.weight = np.repeat(n.astype(np.int64), sizes)
        self.keys = self.places = None
        self.made: dict[int, list[np.ndarray]] = {}
        self.mark = np.zeros(len(ids), bool)

    def _keys(self, left: np.ndarray) -> np.ndarray:
        return self.tok[left] << 32 | self.tok[self.nxt[left]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero((self.nxt >= 0) & (self.tok >= 0))
        return summed(self._keys(left), self.weight[left])

    def copy(self) -> PairIndex:
        """An index that changes by itself; lists of places are shared until they grow."""
        new = object.__new__(PairIndex)
        new.__dict__ |= self.__dict__ | {"tok": self.tok.copy(), "nxt": self.nxt.copy(), "prv": self.prv.copy(), "mark": self.mark.copy(), "made": {k: v[:] for k, v in self.made.items()}}
        return new

    def merge(self, a: int, b: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts m for every (a, b), each sequence left to right; (pairs, change of their counts)."""
        if self.keys is None:  # made for the first merge; counting needs none
            left = np.flatnonzero(self.nxt >= 0).astype(np.int32)
            keys = self._keys(left)
            order = np.argsort(keys, kind="stable")
            self.keys, self.places = keys[order], left[order]
        key = a << 32 | b
        low, high = np.searchsorted(self.keys, (key, key + 1))
        at = np.concatenate([self.places[low:high], *self.made.pop(key, [])])
        at = at[self.tok[at] == a]
        at = at[self.nxt[at] >= 0]
        at = at[self.tok[self.nxt[at]] == b]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if a == b:  # in a run of one token every other place starts a pair
            at = np.sort(at)
            new_run = np.append(True, self.nxt[at[:-1]] != at[1:])
            first = np.flatnonzero(new_run)
            at = at[(np.arange(len(at)) - first[np.cumsum(new_run) - 1]) % 2 == 0]
        right = self.nxt[at]
        after, before = self.nxt[right], self.prv[at]
        self.mark[right] = True
        old = np.concatenate([before[(before >= 0) & ~self.mark[before]], at, right[after >= 0]])
        self.mark[right] = False
        gone, gone_weight = self._keys(old), self.weight[old]
        self.tok[at], self.nxt[at] = m, after
        self.prv[after[after >= 0]] = at[after >= 0]
        self.tok[right] = -1
        before = self.prv[at]
        new = np.concatenate([before[(before >= 0) & (self.tok[before] != m)], at[after >= 0]])
        keys = self._keys(new)
        order = np.argsort(keys, kind="stable")
        keys, new = keys[order], new[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        for k, places in zip(keys[cuts].tolist() if len(keys) else (), np.split(new, cuts[1:]) if len(keys) else ()):
            self.made.setdefault(k, []).append(places)
        return summed(np.concatenate([gone, keys]), np.concatenate([-gone_weight, self.weight[new]]))

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each sequence), as far as they still have a pair; and their weights."""
        alive = self.tok >= 0
        head = np.flatnonzero(alive & (self.prv < 0))
        ids = self.tok[alive]
        at = np.cumsum(alive)[head] - 1
        return ids, np.diff(np.append(at, len(ids))), self.weight[head]


class Queue:
    """Pair counts with a priority queue that is corrected when an entry comes up."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.heap = [(-c, k) for k, c in counts.items()]
        heapq.heapify(self.heap)

    def top(self) -> tuple[int, int] | None:
        """(pair, count) of the most frequent pair, of equal ones the first; None if there is none."""
        while self.heap:
            c, k = self.heap[0]
            now = self.counts.get(k, 0)
            if -c == now and now > 0:
                return k, now
            heapq.heappop(self.heap)
            if 0 < now < -c:
                heapq.heappush(self.heap, (-now, k))
        return None

    def change(self, pairs: Sequence[int], deltas: Sequence[int]) -> None:
        counts = self.counts
        for k, d in zip(pairs, deltas):
            now = counts.get(k, 0) + d
            if now > 0:
                counts[k] = now
                if d > 0:
                    heapq.heappush(self.heap, (-now, k))
            else:
                counts.pop(k, None)


def _blocks(batches: Iterator[pa.RecordBatch], done: list[tuple[int, int, int]]) -> Iterator[PairIndex]:
    """Indexes of bounded size, after the merges ``done``."""

    def made() -> PairIndex:
        index = PairIndex(*(np.concatenate(x) for x in zip(*held)))
        for merge in done:
            index.merge(*merge)
        return index

    held: list[tuple] = []
    size = 0
    for batch in batches:
        col, n = batch["ids"], batch["n"].to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((col.flatten().to_numpy(zero_copy_only=False), sizes, n))
        size += int(sizes.sum())
        if size >= BLOCK_IDS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def pair_counts(chunks: DataFrame, done: list[tuple[int, int, int]]) -> DataFrame:
    """(pair, n): the count of every pair, after the merges ``done``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in _blocks(batches, done):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in index.counts()], schema=_COUNTS)

    return chunks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pieces(chunks: DataFrame, done: list[tuple[int, int, int]], hot: np.ndarray) -> DataFrame:
    """(ids, n): what is left of all chunks after the merges ``done``, cut wherever a pair is not in ``hot`` (sorted); equal pieces are one row.

    Pieces of one token drop out. ``ids`` are 32-bit integers as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in _blocks(batches, done):
            ids, sizes, n = index.sequences()
            if not len(ids):
                continue
            keys = ids[:-1] << 32 | ids[1:]
            linked = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
            ends = np.cumsum(sizes)
            linked[ends[:-1] - 1] = False  # from one chunk to the next
            start = np.flatnonzero(np.append(True, ~linked))
            length = np.diff(np.append(start, len(ids)))
            live = length > 1
            start, length = start[live], length[live]
            if not len(start):
                continue
            of = np.searchsorted(ends, start, side="right")
            to = np.cumsum(length)
            flat = ids[np.arange(to[-1]) + np.repeat(start - to + length, length)].astype(np.int32)
            cut = pa.py_buffer((np.append(0, to) * 4).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(start), [None, cut, pa.py_buffer(flat)])
            t = pa.table([column, pa.array(n[of])], schema=_PIECES).group_by("ids").aggregate([("n", "sum")]).select(["ids", "n_sum"])
            yield from t.rename_columns(["ids", "n"]).combine_chunks().to_batches(50_000)

    return chunks.mapInArrow(run, "ids binary, n long").groupBy("ids").agg(F.sum("n").alias("n"))


def merged(chunks: DataFrame, done: list[tuple[int, int, int]]) -> DataFrame:
    """The chunk table after the merges ``done``; chunks of one token drop out, as they have no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in _blocks(batches, done):
            ids, sizes, n = index.sequences()
            live = sizes > 1
            ids, sizes, n = ids[np.repeat(live, sizes)], sizes[live], n[live]
            ends = np.append(0, np.cumsum(sizes))
            for low in range(0, len(n), 50_000):
                high = min(low + 50_000, len(n))
                at = pa.array((ends[low:high + 1] - ends[low]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(ids[ends[low]:ends[high]].astype(np.int32))), pa.array(n[low:high])], schema=_CHUNKS)

    return chunks.mapInArrow(run, "ids array<int>, n long")


def greedy(index: PairIndex, last: tuple[int, int] | None, first_new: int, want: int) -> list[tuple[int, int, int]]:
    """The next merges, ``want`` at most, up to the pair that comes after ``last`` (-count, pair) in order. ``index`` is used up."""
    queue, out = Queue(dict(zip(*(x.tolist() for x in index.counts())))), []
    while len(out) < want and (top := queue.top()):
        pair, count = top
        if last is not None and (-count, pair) > last:
            break
        a, b, m = pair >> 32, pair & MASK, first_new + len(out)
        out.append((a, b, m))
        keys, deltas = index.merge(a, b, m)
        queue.change(keys.tolist(), deltas.tolist())
    return out


def train(chunks: DataFrame, n_merges: int, sample_chunks: int = SAMPLE_CHUNKS, sample_bytes: int = SAMPLE_BYTES, replayed: int = REPLAYED) -> list[tuple[int, int]]:
    """The first ``n_merges`` greedy merges over ``(chunk, n)``, fewer if no pair is left.

    Greedy means: the most frequent adjacent pair (ties: smaller left id, then smaller right id) is merged everywhere, again and again.
    Null and one-byte chunks have no pair; repeated chunks count as often as they come. The driver holds ``sample_chunks`` pieces of
    ``sample_bytes`` ids in all at most, unless those of a single hot pair are more; with fewer there are more rounds, and the same merges.
    """
    from tokenmill.session import small_batches, spread
    small_batches(chunks.sparkSession)
    state = cut_lineage(spread(chunks.where(F.octet_length("chunk") >= 2).select(byte_ids("chunk").alias("ids"), F.col("n").cast("bigint").alias("n")).where("n > 0")))
    done: list[tuple[int, int, int]] = []
    base, want = 0, FIRST_HOT
    while len(done) < n_merges:
        want = min(want, MOST_HOT)
        first = pair_counts(state, done[base:]).orderBy(F.desc("n"), "pair").limit(want + 1).toArrow()
        pairs, counts = (first[k].to_numpy() for k in ("pair", "n"))
        if not len(pairs):
            break
        while True:
            hot = pairs[:want]
            got = pieces(state, done[base:], np.sort(hot)).limit(sample_chunks + 1).toArrow()
            size = max(got.num_rows / sample_chunks, got["ids"].nbytes / 4 / sample_bytes)
            if size <= 1 or want == 1:
                break
            want = max(1, min(want, len(pairs)) // 4)
        if want == 1 and got.num_rows > sample_chunks:
            got = pieces(state, done[base:], np.sort(hot)).toArrow()
        ids = got["ids"].combine_chunks()
        index = PairIndex(np.frombuffer(b"".join(ids.to_pylist()), np.int32), pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4, got["n"].to_numpy())
        last = (-int(counts[want - 1]), int(pairs[want - 1])) if want < len(pairs) else None
        done += greedy(index, last, N_BYTES + len(done), n_merges - len(done))
        if size < 0.25:
            want *= 2
        if len(done) - base >= replayed and len(done) < n_merges:
            state, base = cut_lineage(merged(state, done[base:])), len(done)
    return [(a, b) for a, b, _ in done]
