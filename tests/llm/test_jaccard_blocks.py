"""Parts of the n-gram Jaccard join: shared signatures in one shuffle, exact comparison of a block in bounded memory."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenmill.llm import jaccard


def groups_of(ids, links):
    lead = {i: i for i in ids}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for x, y in links:
        lead[find(x)] = find(y)
    return {frozenset(j for j in ids if find(j) == find(i)) for i in ids}


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(9, 10), (8, 10), (5, 10)]), st.booleans())
def test_links_of_a_block_are_those_of_all_pairs(seed, ratio, two):
    rng = np.random.default_rng(seed)
    num, den = ratio
    base = [rng.choice(60, rng.integers(1, 25), replace=False) for _ in range(4)]
    sets = []
    for i in range(rng.integers(2, 30)):
        s = set(base[rng.integers(4)].tolist())
        for _ in range(rng.integers(0, 4)):
            s ^= {int(rng.integers(60))}
        sets.append((i, np.array(sorted(s or {1}), np.uint64)))
    cut = len(sets) // 2
    a, b = (sets[:cut], sets[cut:]) if two else (sets, None)
    pairs = itertools.product(a, b) if two else itertools.combinations(a, 2)
    want = []
    for (x, s), (y, t) in pairs:
        both = len(np.intersect1d(s, t))
        if den * both >= num * (len(s) + len(t) - both):
            want.append((x, y))
    links = jaccard.links_of(a, b, num, den)
    assert len(links) < len(sets) and set(map(frozenset, links)) <= set(map(frozenset, want))
    assert groups_of(range(len(sets)), links) == groups_of(range(len(sets)), want)


def test_a_block_of_many_short_texts_takes_little_memory():
    memo = jaccard.WordHash()
    sets = [(n, jaccard.shingle_set(f"page {n} not found on this server please go back {n % 97}".encode().split(), memo, 3)) for n in range(50_000)]
    tracemalloc.start()
    links = jaccard.links_of(sets + [(-n, s) for n, s in sets[1:500]], None, 90, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 499 and peak < 1 << 30


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_shared_signatures_are_all_found_with_their_least_set(spark, rows_a_batch):
    rng = np.random.default_rng(3)
    sets = {int(fp): sorted({int(x) for x in rng.choice(40, rng.integers(0, 6))}) for fp in rng.choice(10_000, 60, replace=False)}
    rows = [(fp, len(s), s) for fp, s in sets.items() for _ in range(1 + fp % 3)] + [(None, 0, [])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        got = jaccard.shared_signatures(spark.createDataFrame(rows, "fp long, n long, sigs array<long>").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    owners = {}
    for fp, s in sets.items():
        for sig in s:
            owners.setdefault(sig, set()).add(fp)
    want = {(sig, fp, len(sets[fp]), min(fps)) for sig, fps in owners.items() if len(fps) > 1 for fp in fps}
    assert set(map(tuple, got)) == want
    assert len(got) == len(want)


def test_candidate_sets_are_shuffled_once_without_a_broadcast(spark):
    """What grows with the sets must not be shuffled more often when the chosen documents are too many to be broadcast."""
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    docs = spark.createDataFrame([(1, text), (2, f"{text} now"), (2, f"{text} now"), (3, f"{text} now"), (4, text), (None, text), (5, None), (6, "other words here")], "doc_id long, text string")
    held = {r["doc_id"]: r["fp"] for r in jaccard.sketches(docs).collect()}
    chosen = spark.createDataFrame([(held[1], 1, 10, 0), (held[2], 2, 10, 0)], "fp long, doc_id long, c long, s long")
    settings_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        sets = jaccard.candidate_sets(docs, chosen, 3)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        got = sets.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2  # the sets, and what was chosen
    want = {held[i]: jaccard.shingle_set(t.encode().split(), jaccard.WordHash(), 3).tobytes() for i, t in ((1, text), (2, f"{text} now"))}
    assert {r["fp"]: bytes(r["items"]) for r in got} == want and len(got) == 2
    assert {(r["c"], r["s"]) for r in got} == {(10, 0)}


def test_one_large_cluster_does_not_move_the_sets_of_the_others_again(spark, monkeypatch):
    """Only the sets of the large cluster are stored, and only those that hold a signature of two components come to the comparison of blocks."""
    rows, members = [], {}
    for group, copies in enumerate((30, 3, 2, 4)):
        for k in range(copies):
            members.setdefault(group, set()).add(len(rows))
            rows.append((len(rows), " ".join([*(f"word{group}x{i}" for i in range(60)), f"only{k}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = jaccard.sketches(docs).collect()
    large = {r["fp"] for r in sketch if r["doc_id"] in members[0]}
    stored, dealt = [], []
    saved, compared = jaccard.saved, jaccard.compared

    def spy_saved(df):
        out = saved(df)
        if "items" in df.columns:
            stored.extend(r["fp"] for r in out.select("fp").collect())
        return out

    def spy_compared(parts, *rest):
        dealt.append({r["fp"] for r in parts.select("fp").collect()})
        return compared(parts, *rest)

    monkeypatch.setattr(jaccard, "saved", spy_saved)
    monkeypatch.setattr(jaccard, "compared", spy_compared)
    held = spark.createDataFrame(sketch, "doc_id long, n long, fp long, sigs array<long>")
    comps = jaccard.similar_sets(docs, held, 3, 90, 100, 400).collect()
    assert set(stored) == large and len(stored) == len(large)
    assert len(dealt) == 2 and dealt[0] and not dealt[1] and dealt[0] <= large  # all are joined after the first pass
    fp_of = {r["doc_id"]: r["fp"] for r in sketch}
    groups = {}
    for r in comps:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert set(map(frozenset, groups.values())) == {frozenset(fp_of[i] for i in g) for g in members.values()}


def test_blocks_of_small_clusters_are_whole_and_none_is_split(spark):
    rows = [(1, 10, 5, 10), (1, 11, 5, 10), (2, 11, 5, 11), (2, 12, 5, 11), (3, 20, 7, 20), (3, 21, 7, 20)]
    members = spark.createDataFrame(rows, "sig long, fp long, n long, lead long")
    small, split, of_sig = jaccard.blocks_of(members, 15)
    assert {tuple(r) for r in small.collect()} == {(10, 10, 0), (11, 10, 0), (12, 10, 0), (20, 20, 0), (21, 20, 0)} and small.count() == 5
    assert split is None and of_sig is None
    small, split, of_sig = jaccard.blocks_of(members, 14)
    assert {tuple(r) for r in small.collect()} == {(20, 20, 0), (21, 20, 0)}
    assert sorted((r["fp"], r["c"]) for r in split.collect()) == [(10, 10), (11, 10), (12, 10)]
    assert sorted(map(tuple, of_sig.collect())) == [(1, 10), (1, 11), (2, 11), (2, 12)]
