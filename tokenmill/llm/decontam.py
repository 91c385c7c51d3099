"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check of candidates.

Each benchmark item has a window size a little under its own length, from a ladder of sizes. Windows of that size are taken at every
``stride`` words of the corpus, and at each of the first and last ``stride`` places of the item; as the item is longer than the window by
as much, a copied item always holds a corpus window that starts at the same word as one of its own. A window's fingerprint
is the 64-bit SimHash of its word bigrams. Fingerprints within ``RADIUS`` bits agree in one of four 16-bit blocks up
to one bit; the item side stores each block with all single-bit changes, so that one look-up in each block finds all of them. Edits
in an item's middle lie in all of these windows. So shorter ones are looked for too, of a length of which a copy above the threshold must have left
one run unchanged however its edits lie; they are taken at every place of the corpus and at every few words of the item, and must be equal. Candidates
are compared exactly: weighted Jaccard similarity of the five-word shingles of the item and of as many words at that place,
where a shingle of the item weighs the more the fewer items of the whole benchmark have it, and any other as much as one that no item has. An item
of fewer than five words is one shingle, all of it: it is found where the same words stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import WordHash, bounded_batches, ngram_hashes, saved

SHINGLE, SIMILARITY = 5, 0.8
#: Sums that slide along a text may be off by so little.
ROUNDING = 1e-9
#: Four blocks, each searched within one bit, guarantee every fingerprint within 7 bits.
BLOCKS, RADIUS = 4, 7
#: Items whose windows are searched for in one pass over the corpus; more items take more passes.
ITEMS_A_PASS = 1000
#: Words by which a candidate's place may be off, at least; by as many as an item may have edited otherwise.
SHIFT = 3
#: Windows are made of so many words at a time.
CHUNK = 1 << 15

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8; ASCII characters other than letters and digits separate them."""
    return text.lower().encode().translate(_TABLE).split()


def window_of(n_words: int) -> tuple[int, int]:
    """(bigrams, stride) of the largest window for an item of n_words; eight bigrams, or all of a shorter item, at least."""
    best = (min(n_words - 1, 8), 1)
    g = 8
    while g < n_words:
        for grams in (g, g + g // 2):
            stride = max(1, grams // 8)
            if grams + 1 + stride - 1 <= n_words:
                best = (grams, stride)
        g *= 2
    return best


def simhash(bigrams: np.ndarray, sizes: Iterable[tuple[int, int]], first: int = 0) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each (grams, stride): places and SimHashes of the windows over ``bigrams`` (hashes in order).

    Windows start where (first + place) is a multiple of the stride. Sums over windows are built by doubling.
    """
    sizes = sorted(sizes)
    out = {}
    kind = np.uint8 if sizes[-1][0] < 256 else np.uint32
    sums = np.unpackbits(np.ascontiguousarray(bigrams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(kind, copy=False)
    parts: dict[int, np.ndarray] = {1: sums}
    power = 1
    while 2 * power <= sizes[-1][0] and len(parts[power]) > power:
        parts[2 * power] = parts[power][:-power] + parts[power][power:]
        power *= 2
    for grams, stride in sizes:
        n = len(bigrams) - grams + 1
        start = -first % stride
        if n <= start:
            continue
        total, at = None, 0
        for bit in reversed(range(grams.bit_length())):
            if grams >> bit & 1:
                part = parts[1 << bit][at + start: at + n: stride]
                total = part if total is None else total + part
                at += 1 << bit
        bits = np.packbits(total > grams // 2, axis=1, bitorder="little")
        out[grams, stride] = np.arange(start, n, stride), bits.view(np.uint64)[:, 0]
    return out


class _Class(NamedTuple):
    """Item windows of one size: fingerprint, item and place of each; for each block, entries by block value."""

    prints: np.ndarray
    items: np.ndarray
    places: np.ndarray
    starts: list[np.ndarray]
    entries: list[np.ndarray]


class _Runs(NamedTuple):
    """Short item windows of one size: sums of bigram hashes in order, item and place of each."""

    sums: np.ndarray
    items: np.ndarray
    places: np.ndarray


class Item(NamedTuple):
    """An item with its distinct shingles, their counts in it and the number of the benchmark's items that have each."""

    item_id: int
    text: str
    shingles: np.ndarray
    counts: np.ndarray
    holders: np.ndarray


class Index(NamedTuple):
    classes: dict[tuple[int, int], _Class]
    runs: dict[int, _Runs]
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    shifts: list[int]
    ids: list[int]
    sizes: list[int]
    shingles: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # hashes, counts, weights
    default: float


def shingles_of(h: np.ndarray) -> np.ndarray:
    """Shingle hashes of word hashes in order; fewer than ``SHINGLE`` words are one shingle, none have none."""
    return ngram_hashes(h, min(SHINGLE, len(h))) if len(h) else h


def edits_of(weights: np.ndarray, default: float) -> int:
    """Most words at the ends that an edit of an item can change above the threshold, each in one shingle of the least weight.
    An edit elsewhere changes four shingles at least, so that there are a quarter as many of those."""
    return int((1 - SIMILARITY) * weights.sum() / (weights.min() + SIMILARITY * default) + 1e-9)


def _sums(bigrams: np.ndarray, grams: int) -> np.ndarray:
    """Sum of the hashes in every window of so many bigrams."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bigrams, dtype=np.uint64)])
    return total[grams:] - total[:-grams]


def items_alone(items: list[tuple[int, str]]) -> list[Item]:
    """Items (item_id, text) as a benchmark of their own."""
    memo = WordHash()
    own = [np.unique(shingles_of(memo.of(words_of(t))), return_counts=True) for _, t in items]
    values, holders = np.unique(np.concatenate([x for x, _ in own] or [np.empty(0, np.uint64)]), return_counts=True)
    return [Item(i, t, x, n, holders[np.searchsorted(values, x)]) for (i, t), (x, n) in zip(items, own)]


def build_index(items: list[Item], n_items: int) -> Index:
    """Index of some items of a benchmark that has ``n_items`` in all; items without words are left out."""
    memo = WordHash()
    ids, sizes, shingles, shifts = [], [], [], []
    found: dict[tuple[int, int], list] = {}
    runs_of: dict[int, list] = {}
    short_of: dict[int, list] = {}
    default = float(np.log1p(n_items))
    for item in items:
        h = memo.of(words_of(item.text))
        if not len(h):
            continue
        k = len(ids)
        ids.append(item.item_id)
        sizes.append(len(h))
        weights = np.log1p(n_items / item.holders)
        shingles.append((item.shingles, item.counts, weights))
        if len(h) < SHINGLE:
            shifts.append(0)
            short_of.setdefault(len(h), []).append((item.shingles[0], k))
            continue
        pairs = ngram_hashes(h, 2)
        grams, stride = window_of(len(h))
        _, prints = simhash(pairs, [(grams, 1)])[grams, 1]
        for place in sorted({*range(min(stride, len(prints))), *range(max(0, len(prints) - stride), len(prints))}):
            found.setdefault((grams, stride), []).append((prints[place], k, place))
        edits = edits_of(np.repeat(weights, item.counts), default)
        shifts.append(max(SHIFT, edits))
        grams, stride = window_of(max(2, (len(h) - edits) // (edits // 4 + 1)))
        sums = _sums(pairs, grams)
        runs_of.setdefault(grams, []).extend((sums[place], k, place) for place in range(0, len(sums), stride))
    classes = {}
    for key, rows in found.items():
        prints = np.array([r[0] for r in rows], np.uint64)
        starts, entries = [], []
        for b in range(BLOCKS):
            block = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            near = np.concatenate([block] + [block ^ (1 << bit) for bit in range(16)])
            order = np.argsort(near, kind="stable")
            starts.append(np.searchsorted(near[order], np.arange(65537)).astype(np.int32))
            entries.append(np.tile(np.arange(len(prints), dtype=np.int32), 17)[order])
        classes[key] = _Class(prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), starts, entries)
    runs, short = {}, {}
    for grams, rows in runs_of.items():
        sums = np.array([r[0] for r in rows], np.uint64)
        order = np.argsort(sums, kind="stable")
        runs[grams] = _Runs(sums[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order])
    for n, rows in short_of.items():
        rows.sort()
        short[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])
    return Index(classes, runs, short, shifts, ids, sizes, shingles, default)


def _candidates(c: _Class, at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the corpus, entry) of all pairs of fingerprints within the radius."""
    places, entries = [], []
    for b in range(BLOCKS):
        block = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        low = c.starts[b][block]
        count = c.starts[b][block + 1] - low
        some = np.flatnonzero(count)
        count, low = count[some].astype(np.int64), low[some].astype(np.int64)
        entry = c.entries[b][np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        window = np.repeat(some, count)
        near = np.bitwise_count(prints[window] ^ c.prints[entry]) <= RADIUS
        places.append(at[window[near]])
        entries.append(entry[near])
    return np.concatenate(places), np.concatenate(entries)


def _equal(r: _Runs, table: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the corpus, entry) of all pairs of equal sums; ``table`` is true at the low bits of each of the item's."""
    some = np.flatnonzero(table[sums & np.uint64(len(table) - 1)])
    low = np.searchsorted(r.sums, sums[some], "left")
    count = np.searchsorted(r.sums, sums[some], "right") - low
    return np.repeat(some, count), np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())


def similarities(index: Index, item: int, words: np.ndarray, first: int, last: int) -> Iterator[tuple[int, float]]:
    """(place, similarity) of an item at every place from first to last of a text's word hashes.

    The window slides: a shingle comes in on the right, one goes out on the left, and the sums follow.
    """
    own, n_own, weights = index.shingles[item]
    size = index.sizes[item]
    there = ngram_hashes(words[first: min(last + size, len(words))], SHINGLE)
    at = np.searchsorted(own, there)
    at[at == len(own)] = 0
    which = np.where(own[at] == there, at, -1).tolist()
    w, n = weights.tolist(), n_own.tolist()
    have = [0] * len(own)
    all_own, both, known, others, right = float((weights * n_own).sum()), 0.0, 0.0, 0, 0
    for a in range(first, last + 1):
        stop = min(a + size, len(words)) - SHINGLE + 1 - first
        while right < stop:
            x = which[right]
            right += 1
            if x < 0:
                others += 1
                continue
            if have[x] < n[x]:
                both += w[x]
            have[x] += 1
            known += w[x]
        yield a, both / (all_own + known - both + index.default * others)
        x = which[a - first] if a - first < right else None
        if x is None:
            return
        if x < 0:
            others -= 1
            continue
        have[x] -= 1
        if have[x] < n[x]:
            both -= w[x]
        known -= w[x]


class Match(NamedTuple):
    item_id: int
    place: int  # words before it
    similarity: float
    whole: bool  # it tells a copy from ordinary text: an item of ``SHINGLE`` words or more, or all of the text


class Searcher:
    """Matches of texts: for each text, the best match of each item."""

    def __init__(self, index: Index):
        self.index, self.memo = index, WordHash()
        self.tables = {}
        for grams, r in index.runs.items():
            self.tables[grams] = np.zeros(1 << 20, bool)
            self.tables[grams][r.sums & np.uint64((1 << 20) - 1)] = True

    def __call__(self, texts: list[str | None]) -> list[list[Match]]:
        split = [words_of(t or "") for t in texts]
        ends = np.cumsum([len(w) for w in split])
        h = np.concatenate([self.memo.of(w) for w in split]) if len(split) else np.empty(0, np.uint64)
        out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        if len(h) >= 2 and self.index.classes:
            self._search(h, ends, out)
        self._search_short(h, ends, out)
        sizes = self.index.sizes
        return [[Match(self.index.ids[k], place, s, sizes[k] >= SHINGLE or sizes[k] == len(words)) for k, (s, place) in sorted(found.items())]
                for words, found in zip(split, out)]

    def _search_short(self, h: np.ndarray, ends: np.ndarray, out: list[dict]) -> None:
        for n, (hashes, items) in self.index.short.items():
            there = ngram_hashes(h, n)
            for place in np.flatnonzero(np.isin(there, hashes)).tolist():
                text = int(np.searchsorted(ends, place, "right"))
                if place + n <= ends[text]:
                    low, high = np.searchsorted(hashes, there[place], "left"), np.searchsorted(hashes, there[place], "right")
                    for k in items[low:high].tolist():
                        out[text].setdefault(k, (1.0, place - (int(ends[text - 1]) if text else 0)))

    def _search(self, h: np.ndarray, ends: np.ndarray, out: list[dict]) -> None:
        pairs = ngram_hashes(h, 2)
        most = max(g for g, _ in self.index.classes)
        seen = set()
        for first in range(0, len(pairs), CHUNK):
            found = simhash(pairs[first: first + CHUNK + most - 1], self.index.classes, first)
            for key, (at, prints) in found.items():
                mine = at < CHUNK
                c = self.index.classes[key]
                places, entries = _candidates(c, at[mine] + first, prints[mine])
                for place, k, off in zip(places.tolist(), c.items[entries].tolist(), c.places[entries].tolist()):
                    seen.add((place - off, int(np.searchsorted(ends, place, "right")), k))
            for grams, r in self.index.runs.items():
                some = pairs[first: first + CHUNK + grams - 1]
                if len(some) >= grams:
                    places, entries = _equal(r, self.tables[grams], _sums(some, grams))
                    for place, k, off in zip((places + first).tolist(), r.items[entries].tolist(), r.places[entries].tolist()):
                        seen.add((place - off, int(np.searchsorted(ends, place, "right")), k))
        spots: dict[tuple[int, int], list[int]] = {}
        for place, text, k in seen:
            spots.setdefault((text, k), []).append(place)
        for (text, k), places in spots.items():
            low, high = (int(ends[text - 1]) if text else 0), int(ends[text])
            shift, best, upto = self.index.shifts[k], (0.0, 0), low - 1
            for place in sorted(places):
                first, last = max(upto + 1, place - shift), min(max(place + shift, low), high - SHINGLE)
                if first <= last:
                    for a, s in similarities(self.index, k, h[:high], first, last):
                        if s > best[0] + ROUNDING:
                            best = min(s, 1.0), a - low
                    upto = last
            if best[0] >= SIMILARITY - ROUNDING:
                out[text][k] = best


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, shingles, counts, holders) of each different item with words, stored, and how many there are.

    How many items hold a shingle is counted over the whole benchmark, so that weights don't depend on how it is cut into blocks.
    """
    made = pa.schema([("row", pa.int64()), ("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                x, n = np.unique(shingles_of(memo.of(words_of(text))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row)), pa.array(x.view(np.int64)), pa.array(n)], schema=made)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    rows = saved(rows.distinct().withColumn("row", F.monotonically_increasing_id()))
    each = saved(rows.select("row", "text").mapInArrow(run, "row long, shingle long, n long"))
    held = each.groupBy("shingle").agg(F.count("*").alias("holders"))
    lists = each.join(held, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n", "holders")).alias("s"))
    items = saved(rows.join(lists, "row").select("item_id", "text", "s"))
    return items, items.count()


def _passes(items: DataFrame, items_a_pass: int) -> Iterator[list[Item]]:
    """The items in blocks; a block at a time comes to the driver."""
    rows = items.orderBy("item_id", "text").toLocalIterator()
    while some := list(islice(rows, items_a_pass)):
        out = []
        for r in some:
            x = np.array([e["shingle"] for e in r["s"]], np.int64).view(np.uint64)
            order = np.argsort(x)
            out.append(Item(r["item_id"], r["text"], x[order], np.array([e["n"] for e in r["s"]])[order], np.array([e["holders"] for e in r["s"]])[order]))
        yield out


def leaks(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, place, similarity) for every row of ``docs`` and every item that it holds: the item's best place
    (number of words before it, the first of equals) and similarity, at least ``SIMILARITY``.

    The benchmark is read in blocks of ``items_a_pass`` items; each block's index is broadcast and is searched for in one pass over
    all texts, without a shuffle. With more than one block, the blocks go one after another: a block's rows are stored and its index is let go
    before the next. The result does not depend on the blocks. Null and empty texts hold nothing; null items and items without words are
    found nowhere; an item of fewer than five words is found, with similarity 1, wherever the same words stand. Repeated rows of ``docs`` each have their matches;
    of repeated items with the same text one counts, others are items of their own. Texts are read whole; other columns are ignored; empty
    tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("place", pa.int64()), ("similarity", pa.float64())])
    items, n = benchmark_items(benchmark)
    parts = []
    for some in _passes(items, items_a_pass):
        index = spark.sparkContext.broadcast(build_index(some, n))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            search = Searcher(index.value)
            for batch in batches:
                rows = [(d, *m[:3]) for d, found in zip(batch["doc_id"].to_pylist(), search(batch["text"].to_pylist())) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        part = texts.mapInArrow(run, "doc_id long, item_id long, place long, similarity double")
        if n > items_a_pass:
            part = saved(part)
            index.unpersist()
        parts.append(part)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "doc_id long, item_id long, place long, similarity double")


def without_leaks(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item. Fewer than five words also stand in ordinary text, so an item of so few
    drops a text only if it is all of it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items, n = benchmark_items(benchmark)
    for some in _passes(items, items_a_pass):
        index = spark.sparkContext.broadcast(build_index(some, n))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            search = Searcher(index.value)
            for batch in batches:
                yield batch.filter(pa.array([not any(m.whole for m in found) for found in search(batch["text"].to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n > items_a_pass:
            docs = saved(docs)
            index.unpersist()
    return docs
