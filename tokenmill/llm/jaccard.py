"""Set-similarity join of documents on distinct word n-grams, by PartEnum signatures.

Two sets link when their Jaccard similarity is at least num / den. Sizes lie in bands. A document of a band gives
signatures for that band and, if it can have larger partners there, for the next. All similar pairs of a band differ
in at most k elements. The domain of shingles is split by hash into n1 parts of n2 subparts each. At most
k // (k2 + 1) parts hold more than k2 differences, so with n1 = k // (k2 + 1) + 1 + 2 * slack parts, at least
2 * slack + 1 parts hold k2 at most, even after both documents have left out the ``slack`` parts in which they have the
fewest elements. In such a part at least n2 - k2 subparts are equal, and a signature is a hash of the elements in one
such subset of subparts, so the pair shares a signature: no similar pair is lost. An exact comparison follows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import WordHash, arrow_batches, bounded_batches, mixed, ngram_hashes, saved, texts_of
from tokenmill.llm.components import connected_components

WIDTH, NUM, DEN = 3, 90, 100
#: Elements that a signature should cover on average, and signatures a document may have for it.
COVER, MOST = 8, 1.35
#: Elements in the sets of one block of the exact comparison (8 bytes each).
BLOCK_ITEMS = 500_000
#: Hashes of sets that a task remembers, so as to hand on their signatures once.
SEEN = 1_000_000
#: Bits of the table that preselects documents for the exact comparison.
FILTER_BITS = 1 << 23


@lru_cache(maxsize=None)
def bands(num: int, den: int) -> tuple[int, ...]:
    """Largest size of each band; a band spans about the square of den / num."""
    tops, low = [], 1
    while low < 1 << 40:
        tops.append(max(low, low * den * den // (num * num)))
        low = tops[-1] + 1
    return tuple(tops)


@lru_cache(maxsize=None)
def plan(band: int, num: int, den: int) -> tuple[int, int, int, int, np.ndarray]:
    """(n1, n2, k2, slack, subsets) for a band; subsets is an n2 x C matrix of zeros and ones."""
    tops = bands(num, den)
    most = tops[band]
    least = max(1, (tops[band - 1] + 1 if band else 1) * num // den)
    k = 2 * most * (den - num) // (den + num)
    slack = 2 if k >= 20 else 0
    options = []
    for k2 in range(min(k, 5) + 1):
        n1 = k // (k2 + 1) + 1 + 2 * slack
        for n2 in range(k2 + 1, k2 + 5):
            options.append((comb(n2, k2) * n1, least * (n2 - k2) / (n1 * n2), n1, n2, k2))
    enough = [o for o in options if o[1] >= COVER and o[0] <= max(24, MOST * (k + 1 + 2 * slack))]
    _, _, n1, n2, k2 = min(enough) if enough else max(options, key=lambda o: (min(o[1], COVER) if o[0] <= max(24, MOST * (k + 1 + 2 * slack)) else -1, -o[0]))
    subsets = np.zeros((n2, comb(n2, k2)), np.uint64)
    for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
        subsets[list(chosen), c] = 1
    return n1, n2, k2, slack, subsets


def shingle_set(words: list[bytes], memo: WordHash, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; fewer words are one run; no words, no run."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(memo.of(words), min(width, len(words))))


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    m = mixed(shingles)
    total = np.add.reduce(m, keepdims=True) ^ mixed(np.bitwise_xor.reduce(m, keepdims=True)) + np.uint64(len(m))
    return int(mixed(total).view(np.int64)[0])


def signatures(shingles: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """PartEnum signatures of one set, as signed 64-bit integers."""
    size = len(shingles)
    if size * (den - num) < num:
        return np.empty(0, np.int64)  # too small to be similar to any other set
    tops = bands(num, den)
    own = bisect_left(tops, size)
    out = []
    m = mixed(shingles)
    for band in (own, own + 1):
        if band > own and size * den < num * (tops[own] + 1):
            break
        n1, n2, _, slack, subsets = plan(band, num, den)
        at = (((m >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, at, m)
        parts = np.arange(n1)
        if slack:
            parts = np.sort(np.argsort(np.bincount(at // n2, minlength=n1), kind="stable")[slack:])
        of_subset = sums.reshape(n1, n2)[parts] @ subsets
        salt = (np.uint64(band) << np.uint64(40)) + (parts.astype(np.uint64)[:, None] << np.uint64(8)) + np.arange(subsets.shape[1], dtype=np.uint64)
        out.append(mixed(of_subset + mixed(salt + np.uint64(1))).ravel())
    return np.concatenate(out).view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("sigs", pa.list_(pa.int64()))])
_SETS = pa.schema([("fp", pa.int64()), ("items", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n, fp, sigs) of every row: set size, hash of the set (null if empty) and its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()

        def make(batch: pa.RecordBatch) -> dict:
            n, fp, sigs = [], [], []
            for text in texts_of(batch["text"]):
                s = shingle_set(text.lower().split(), memo, width)
                n.append(len(s))
                fp.append(fingerprint(s) if len(s) else None)
                sigs.append(signatures(s, num, den))
            return {"doc_id": batch["doc_id"], "n": n, "fp": fp, "sigs": sigs}

        yield from arrow_batches(batches, _SKETCH, make)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, fp long, sigs array<long>")


def shared_signatures(sketch: DataFrame) -> DataFrame:
    """(sig, fp, n, lead) for the signatures that different sets have; lead is the least of their hashes.

    A task hands on the signatures of a set once, so those of a frequent text are few. They are shuffled once, sorted, and gone through
    with one row held, however many sets share a signature.
    """
    made = pa.schema([("sig", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])
    kept = pa.schema([*made, ("lead", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fps, rows = batch["fp"].to_pylist(), []
            for k, fp in enumerate(fps):
                if fp is not None and fp not in seen:
                    seen.add(fp)
                    rows.append(k)
            if len(seen) > SEEN:
                seen.clear()
            batch = batch.take(pa.array(rows, pa.int64()))
            sigs = batch["sigs"]
            of = np.repeat(np.arange(batch.num_rows), np.diff(sigs.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([sigs.flatten(), batch["fp"].take(pa.array(of)), batch["n"].take(pa.array(of))], schema=made)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead, is_out = np.empty((3, 0), np.int64), None, True  # the last row, the least set of its signature, whether the row is out
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch[k].to_numpy() for k in made.names])], axis=1)
            if not batch.num_rows:
                continue
            new_sig = np.append(True, rows[0, 1:] != rows[0, :-1])
            new = new_sig | np.append(True, rows[1, 1:] != rows[1, :-1])
            rows, new_sig = rows[:, new], new_sig[new]
            group = np.cumsum(new_sig) - 1
            leads, keep = rows[1, new_sig][group], np.bincount(group)[group] > 1
            if last.shape[1]:
                leads[group == 0] = lead
            is_out_now = bool(keep[-1]) or (rows.shape[1] == 1 and last.shape[1] == 1 and is_out)
            if last.shape[1] and is_out:
                keep[0] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.vstack([rows, leads])[:, keep]], schema=kept)
            last, lead, is_out = rows[:, -1:], leads[-1], is_out_now

    rows = sketch.select("fp", "n", "sigs").mapInArrow(each, "sig long, fp long, n long").repartition("sig").sortWithinPartitions("sig", "fp")
    return rows.mapInArrow(shared, "sig long, fp long, n long, lead long")


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(41)).astype(np.int64)


def _preselection(ids: DataFrame) -> np.ndarray:
    """Table of FILTER_BITS flags, set for the ids; its size does not depend on how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch["doc_id"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"at": bit >> 6, "flags": (np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64)})

    words = ids.mapInArrow(run, "at long, flags long").groupBy("at").agg(F.bit_or("flags").alias("flags")).toPandas()
    flags = np.zeros(FILTER_BITS // 64, np.uint64)
    flags[words["at"].to_numpy(np.int64)] = words["flags"].to_numpy(np.int64).view(np.uint64)
    return flags


def candidate_sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(fp, c, s, items) for the (fp, doc_id, c, s) in ``chosen``: the sorted shingle hashes as bytes, and their block.

    ``chosen`` names one document for each set; another one that has the same set and the same flag does as well. A task hands on a set once. The
    join and the aggregate have the same key, so the sets are shuffled once, whether ``chosen`` is broadcast or not.
    """
    flags = docs.sparkSession.sparkContext.broadcast(_preselection(chosen.select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = WordHash(), flags.value
        seen: set[int] = set()
        for batch in batches:
            bit = _bit(batch["doc_id"].to_numpy(zero_copy_only=False))
            keep = (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
            out: dict[int, bytes] = {}
            for t in texts_of(batch["text"].filter(pa.array(keep.astype(bool)))):
                x = shingle_set(t.lower().split(), memo, width)
                if len(x) and (fp := fingerprint(x)) not in seen:
                    seen.add(fp)
                    out[fp] = x.tobytes()
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_pydict({"fp": list(out), "items": list(out.values())}, schema=_SETS)

    found = _texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "fp long, items binary")
    return found.join(chosen.select("fp", "c", "s"), "fp").groupBy("fp").agg(*[F.first(k).alias(k) for k in ("c", "s", "items")])


def links_of(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links among the sets of ``a``, or between ``a`` and ``b``, as far as they join components: at most one less than there are sets.

    Sets are walked from neighbour to neighbour. If two sets are similar, then among the rarest elements of each, as many as may be missing and
    one more, there is one that both have; only sets that share such an element are compared, and only until they are reached.
    Memory is in proportion to the elements, whatever the number of sets.
    """
    ids, sets = [i for i, _ in a + (b or [])], [x for _, x in a + (b or [])]
    sizes = np.array([len(x) for x in sets])
    starts = np.append(0, np.cumsum(sizes))
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    rare_first = at[np.lexsort((at, np.bincount(at, minlength=len(values))[at], owner))]
    chosen = np.arange(len(at)) - starts[owner] < (sizes - -(-num * sizes // den) + 1)[owner]
    element, holder = rare_first[chosen], owner[chosen]
    shared = np.bincount(element, minlength=len(values))[element] > 1
    element, holder = element[shared], holder[shared]
    first = np.searchsorted(holder, np.arange(len(sets) + 1))
    by_element = np.argsort(element, kind="stable")
    holders, ends = holder[by_element], np.searchsorted(element[by_element], np.arange(len(values) + 1))
    todo, right, has, links = np.ones(len(sets), bool), np.arange(len(sets)) >= len(a), np.zeros(len(values), bool), []
    for seed in range(len(a)):
        walk = [seed] if todo[seed] else []
        todo[seed] = False
        while walk:
            x = walk.pop()
            near = [holders[ends[e]:ends[e + 1]] for e in element[first[x]:first[x + 1]]]
            if not near:
                continue
            c = np.concatenate(near)
            c = c[todo[c] & (sizes[c] * den >= num * sizes[x]) & (sizes[x] * den >= num * sizes[c])]
            c = np.unique(c if b is None else c[right[c] != right[x]])
            if not len(c):
                continue
            own = at[starts[x]:starts[x + 1]]
            has[own] = True
            upto = np.cumsum(sizes[c])
            both = np.add.reduceat(has[at[np.arange(upto[-1]) + np.repeat(starts[c] - upto + sizes[c], sizes[c])]], upto - sizes[c], dtype=np.int64)
            has[own] = False
            found = c[den * both >= num * (sizes[x] + sizes[c] - both)]
            todo[found] = False
            links += [(ids[x], ids[f]) for f in found]
            walk += found.tolist()
    return links


PAIR = ["ca", "sa", "cb", "sb"]


def blocks_of(members: DataFrame, block_items: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """((fp, c, s) block of each set of the small clusters, the same for the large clusters, (sig, fp) of the latter); None if none is large.

    Sets that share signatures, directly or not, are one block (c, 0) if they have up to ``block_items`` elements in all.
    A larger cluster is dealt over about as many blocks of that size as it fills. Sets with the same most frequent signature go to the
    same block, unless they alone fill more than one; then they are split by hash. The large clusters are few, one for ``block_items`` elements
    at most, and so are broadcast; only the signatures of their sets are moved again.
    """
    cluster = connected_components(members.select("fp", "lead"), "fp", "lead").select(F.col("node").alias("fp"), F.col("component").alias("c"))
    placed = saved(members.select("fp", "n").distinct().join(cluster, "fp"))
    bins = F.ceil(F.col("w") / block_items).cast("long")
    heavy = saved(placed.groupBy("c").agg(F.sum("n").alias("w")).where(F.col("w") > block_items).select("c", bins.alias("bins")))
    whole = F.lit(0).cast("long").alias("s")
    if heavy.isEmpty():
        return placed.select("fp", "c", whole), None, None
    small = placed.join(F.broadcast(heavy), "c", "left_anti").select("fp", "c", whole)
    large = saved(members.select("sig", "fp", "n").join(placed.join(F.broadcast(heavy), "c").select("fp", "c", "bins"), "fp"))
    per_sig = large.groupBy("sig").agg(F.sum("n").alias("w"))
    main = large.join(per_sig, "sig").groupBy("fp", "c", "bins").agg(F.max(F.struct("w", "sig")).alias("m"))
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("m.w") / block_items).cast("long"))
    of_bin = F.when(F.col("m.w") <= block_items, F.pmod(F.xxhash64("m.sig"), F.col("bins"))).otherwise(F.xxhash64("m.sig", part))
    return small, saved(main.select("fp", "c", of_bin.alias("s"))), large.select("sig", "fp")


_LINKS = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def compared_inside(held: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) links found by comparing the sets of each block with each other; ``held`` has each block in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for row in zip(*(batch[k].to_pylist() for k in ("c", "s", "fp", "items"))))
        for _, group in groupby(found, key=lambda r: r[:2]):
            sets = [(fp, np.frombuffer(items, np.uint64)) for *_, fp, items in group]
            if len(sets) > 1:
                links = links_of(sets, None, num, den)
                yield pa.RecordBatch.from_pydict({"x": [x for x, _ in links], "y": [y for _, y in links]}, schema=_LINKS)

    return held.select("c", "s", "fp", "items").mapInArrow(run, "x long, y long")


def dealt_to(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """(fp, ca, sa, cb, sb, side): the pairs of blocks that each of the sets (fp, c, s) in ``near`` takes part in."""
    one = lambda c, s, side: F.struct(F.col(c).alias("c"), F.col(s).alias("s"), F.lit(side).alias("side"))
    sides = pairs.select(*PAIR, F.explode(F.array(one("ca", "sa", 0), one("cb", "sb", 1))).alias("e"))
    return sides.select(*PAIR, "e.*").join(near, ["c", "s"]).select("fp", *PAIR, "side")


def compared(parts: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) links found by comparing the sets that ``parts`` deals to each pair of different blocks, no more of them than there are sets in it."""
    dealt = parts.join(held.select("fp", "items"), "fp").select(*PAIR, "side", "fp", "items").repartition(*PAIR).sortWithinPartitions(*PAIR, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for row in zip(*(batch[k].to_pylist() for k in (*PAIR, "side", "fp", "items"))))
        for _, group in groupby(found, key=lambda r: r[:4]):
            both: tuple[list, list] = ([], [])
            for *_, side, fp, items in group:
                both[side].append((fp, np.frombuffer(items, np.uint64)))
            if both[0] and both[1]:
                links = links_of(both[0], both[1], num, den)
                yield pa.RecordBatch.from_pydict({"x": [x for x, _ in links], "y": [y for _, y in links]}, schema=_LINKS)

    return dealt.mapInArrow(run, "x long, y long")


def similar_sets(docs: DataFrame, sketch: DataFrame, width: int, num: int, den: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(node, component) over hashes of sets that are linked, directly or not.

    Signatures shared by different sets give candidates, in blocks of bounded size, and a task compares the sets of one
    pair of blocks exactly. First every block is compared with itself. Of the blocks of a large cluster, each is then compared with
    the first block that it shares a signature with; near copies are mostly joined by that, in a number of comparisons in
    proportion to the blocks. What is left are pairs of blocks with a signature whose sets still lie in different components; all
    of those are compared, so no link between components is lost. Only the sets of large clusters are stored, and only those that hold a
    signature whose sets lie in different components are moved again.
    """
    members = saved(shared_signatures(sketch))
    small, split, of_sig = blocks_of(members, block_items)
    first_doc = sketch.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).where("fp is not null and doc_id is not null")
    held_of = lambda block: candidate_sets(docs, saved(first_doc.join(block, "fp")), width).repartition("c", "s").sortWithinPartitions("c", "s", "fp")
    pair = lambda c, sa, sb: [F.col(c).alias("ca"), F.col(sa).alias("sa"), F.col(c).alias("cb"), F.col(sb).alias("sb")]
    links = saved(compared_inside(held_of(small), num, den))
    if split is not None:
        held = saved(held_of(split))  # the blocks of a large cluster are read again
        links = saved(links.union(compared_inside(held, num, den)))
        tried = None
        for first in (True, False):
            comps = connected_components(links, "x", "y").withColumnRenamed("node", "fp")
            placed = of_sig.join(split.join(comps, "fp", "left").withColumn("comp", F.coalesce("component", "fp")), "fp")
            by_block = placed.groupBy("sig", "c", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            open_ = by_block.groupBy("sig").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.min("s").alias("s0"), F.max("s").alias("s1"))
            open_ = open_.where("least <> most and s0 <> s1").select("sig", "s0")
            left = saved(by_block.join(open_, "sig"))
            if first:
                pairs = left.where("s <> s0").groupBy("c", "s").agg(F.min("s0").alias("s0")).select(*pair("c", "s0", "s"))
                tried = pairs = saved(pairs)
            else:
                other = left.select("sig", F.col("s").alias("t"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
                pairs = left.join(other, "sig").where((F.col("s") < F.col("t")) & ~((F.col("lo") == F.col("thi")) & (F.col("hi") == F.col("tlo"))))
                pairs = pairs.select(*pair("c", "s", "t")).distinct().join(tried, PAIR, "left_anti")
            near = of_sig.join(left.select("sig").distinct(), "sig", "left_semi").select("fp").distinct().join(split, "fp")
            links = saved(links.union(compared(dealt_to(pairs, near), held, num, den)))
    return connected_components(links, "x", "y")


def jaccard_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links, the row's own included. Null, empty and blank texts have
    no shingles and link with nothing. Repeated rows and repeated ids are rows of their own; a null id takes part in
    links but never names a component (null if no id in it is known). Texts are read whole. Other columns are ignored.
    Sets are told apart by 64-bit hashes of shingles and of sets.
    """
    sketch = saved(sketches(docs, width, num, den))
    comps = similar_sets(docs, sketch, width, num, den)
    rows = sketch.select("doc_id", "n", "fp").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    rows = saved(rows.select("doc_id", "n", "label"))
    # stored, so that the join deals out both sides anew and may split a large component's rows
    least = saved(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when every component is left with its least doc_id.

    Rows with the same id count as one document: one of them stays, if any. Rows without an id, and documents without shingles, stay.
    """
    rows = saved(jaccard_components(docs, width, num, den).where("doc_id is not null"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = ids.where(~F.col("stays")).select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    again = saved(ids.where(F.col("stays") & (F.col("n") > 1)).select("doc_id"))
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
