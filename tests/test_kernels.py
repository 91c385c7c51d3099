"""Shard closing, row groups, ordered rules, shared prefixes and the watchdog's timers against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenmill.operators import evaluation as EV
from tokenmill.operators import joins as JN
from tokenmill.sources import corpus as C
from tokenmill.sources import io as IO


def closing(chars, limit, acc=0, shard=0):
    out = []
    for c in chars:
        acc += c
        out.append((shard, acc >= limit))
        if acc >= limit:
            acc, shard = 0, shard + 1
    return out, acc, shard


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 70), st.integers(0, 69))
def test_transfer_functions_compose(blocks, limit, acc):
    acc %= limit
    _, want_acc, want_shard = closing([c for b in blocks for c in b], limit, acc)
    whole = IO.Closing.of(blocks[0], limit)
    for b in blocks[1:]:
        whole = whole.then(IO.Closing.of(b, limit))
    assert whole(acc) == (want_shard, want_acc)
    assert len(whole.need) <= 1 + sum(map(len, blocks)) and all(x < y for x, y in zip(whole.need, whole.need[1:]) if x != y)


@pytest.mark.parametrize("block, fan", [(4, 2), (7, 3), (4096, 64)])
def test_shards_close_as_one_after_another(spark, block, fan):
    rng = random.Random(block)
    chars = [rng.choice([0, 1, 5, 40, 400]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(chars)), "rg long, chars long").repartition(5)
    got = [(r.shard_idx, r.closes) for r in IO.shard_of_groups(df, 300, block, fan).orderBy("rg").collect()]
    assert got == closing(chars, 300)[0]
    assert IO.shard_of_groups(df.limit(0), 300, block, fan).count() == 0


def test_row_groups_are_those_of_the_files(spark, tmp_path):
    sizes = {"shard_00000.parquet": [5, 1, 9], "shard_00001.parquet": [3], "shard_00002.parquet": [2, 2, 2, 7]}
    for name, groups in sizes.items():
        rows = [f"{name} {g} {r}" for g, n in enumerate(groups) for r in range(n)]
        schema = pa.schema([("text", pa.string())])
        with pq.ParquetWriter(tmp_path / name, schema) as w:
            at = 0
            for n in groups:
                w.write_table(pa.table({"text": rows[at:at + n]}, schema=schema), row_group_size=n)
                at += n
    (tmp_path / "shard_00003.parquet.tmp").write_bytes(b"not yet")
    got = C.scan_corpus(spark, str(tmp_path)).collect()
    assert len(got) == 31
    for r in got:
        name, g, k = r.text.split()
        assert (f"shard_{r.shard_idx:05d}.parquet", r.rg_idx, r.row_in_rg) == (name, int(g), int(k)) and r.pos == sum(sizes[name][:int(g)]) + int(k)
    groups = C.row_groups(spark, str(tmp_path)).orderBy("shard_idx", "rg_idx").collect()
    assert [(r.shard_idx, r.rg_idx, r.n_rows) for r in groups] == [(s, g, n) for s, x in enumerate(sizes.values()) for g, n in enumerate(x)]
    assert {r.text for r in C.stride(C.scan_corpus(spark, str(tmp_path)), 1, 2).collect()} == {r.text for r in got if int(r.text.split()[1]) % 2 == 1}


def test_resharded_files_have_whole_row_groups(spark, tmp_path):
    docs = spark.range(2600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    plan = IO.reshard_plan(docs, 12_000, drop_tail=False)
    IO.write_reshard(docs, plan, str(tmp_path / "w"))
    groups = C.row_groups(spark, str(tmp_path / "w")).orderBy("shard_idx", "rg_idx").collect()
    assert [(r.shard_idx, r.n_rows) for r in groups] == [(0, 1024), (0, 1024), (1, 552)]
    meta = pq.read_metadata(groups[0].file_path.replace("file://", "").replace("%3D", "="))
    column = meta.row_group(0).column(0)
    assert column.compression == "ZSTD" and not column.has_dictionary_page and not (column.is_stats_set and column.statistics.has_min_max)


@pytest.mark.parametrize("rules_a_pass", [JN.RULES_A_PASS, 3])
def test_first_rule_whose_substrings_all_occur(spark, rules_a_pass):
    rng = random.Random(4)
    words = ["ab", "abc", "b", "ca", "É", "x y", "zz"]
    rules = [(rng.randrange(6), rng.sample(words, rng.randint(1, 3)), float(k)) for k in range(12)] + [(0, ["ab", None], 90.0), (0, None, 91.0), (9, [], 92.0), (9, [""], 93.0), (3, ["AB", "ab"], 94.0)]
    texts = [None, "", "nothing", *("".join(rng.choices(["a", "b", "c", "é", "x ", "y", "z", "A"], k=rng.randint(1, 9))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, txt string")
    for some in (rules, [r for r in rules if r[1]], []):
        table = spark.createDataFrame(some, "priority int, substrings array<string>, value double")
        got = {r.id: r.value for r in JN.first_match(df, "txt", table, -1.0, rules_a_pass=rules_a_pass).collect()}
        for i, t in enumerate(texts):
            hits = [(p, v) for p, subs, v in some if subs is not None and None not in subs and all(s.lower() in (t or "").lower() for s in subs)]
            assert got[i] == (min(hits)[1] if hits else -1.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=4), max_size=6), st.booleans())
def test_shared_ends_of_groups(groups, reverse):
    def brute(lists):
        if not lists:
            return 0
        lists = [x[::-1] if reverse else x for x in lists]
        n = 0
        while all(len(x) > n for x in lists) and len({x[n] for x in lists}) == 1:
            n += 1
        return n

    got = EV.shared_ends(pa.array(groups, pa.list_(pa.list_(pa.int32()))), reverse)
    assert got.tolist() == [brute(g) for g in groups]
    padded = pa.array([[[7]], *groups, [[1], [1]]], pa.list_(pa.list_(pa.int32()))).slice(1, len(groups))  # a slice of a longer array
    assert EV.shared_ends(padded, reverse).tolist() == got.tolist()
    assert isinstance(got, np.ndarray)
