"""Packing plans are checked placement by placement against the stated rules; nothing is packed again here."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import packing as P

CAP, BUFFER = 257, 20


def _docs(spark, n=400):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("pos"), (F.col("id") % 3 == 0).cast("bigint").alias("grp"),
                                 F.floor(F.col("id") / 7).alias("batch"), (F.abs(F.hash("id")) % 300 + 1).cast("bigint").alias("n_tokens"))


def _groups(df):
    out = defaultdict(list)
    for r in df.orderBy("grp", "pos").collect():
        out[r["grp"]].append(r)
    return out


def _placements(plan):
    out = defaultdict(list)
    for r in plan.orderBy("grp", "row_id", "slot").collect():
        out[r["grp"]].append(r)
    return out


def _plan(df, algo):
    return P.pack(df, algo, CAP, buffer=BUFFER, group="grp", batch="batch")


@pytest.mark.parametrize("algo", ["bestfit_crop", "bestfit_pad"])
def test_every_best_fit_placement_is_the_right_choice(spark, algo):
    df = _docs(spark)
    plan = _placements(_plan(df, algo))
    for g, docs in _groups(df).items():
        docs = [d for d in docs if algo == "bestfit_crop" or d["n_tokens"] <= CAP]
        arrival = {d["doc_id"]: i for i, d in enumerate(docs)}
        size = {d["doc_id"]: d["n_tokens"] for d in docs}
        keys = list(dict.fromkeys(d["batch"] for d in docs))
        waiting, row, used = set(), 0, 0
        for p in plan[g]:
            while len(waiting) < BUFFER and keys:  # whole batches are let in until enough documents wait
                k = keys.pop(0)
                waiting |= {d["doc_id"] for d in docs if d["batch"] == k}
            if p["row_id"] != row:
                assert used == CAP or (algo == "bestfit_pad" and min(size[w] for w in waiting) > CAP - used)
                row, used = row + 1, 0
            assert p["row_id"] == row and p["doc_id"] in waiting and p["n_tokens"] == size[p["doc_id"]]
            fitting = [w for w in waiting if size[w] <= CAP - used]
            if fitting:
                assert p["take"] == p["n_tokens"] == max(size[w] for w in fitting)
            else:
                assert algo == "bestfit_crop" and p["take"] == CAP - used and p["n_tokens"] == min(size[w] for w in waiting)
            assert p["doc_id"] == min((w for w in waiting if size[w] == p["n_tokens"]), key=arrival.get)
            waiting.remove(p["doc_id"])
            used += p["take"]
        assert not waiting and not keys


def test_first_fit_decreasing_takes_the_first_row_with_room(spark):
    df = _docs(spark)
    for g, placed in _placements(_plan(df, "ffd")).items():
        docs = _groups(df)[g]
        by_doc = {p["doc_id"]: p for p in placed}
        used = defaultdict(int)
        for d in sorted(docs, key=lambda d: (-min(d["n_tokens"], CAP), d["pos"])):
            p = by_doc[d["doc_id"]]
            assert p["take"] == min(d["n_tokens"], CAP) <= CAP - used[p["row_id"]]
            assert all(used[r] + p["take"] > CAP for r in range(p["row_id"]))
            used[p["row_id"]] += p["take"]


def test_invariants_all_algorithms(spark):
    df = _docs(spark)
    n = {x: df.count() if x != "bestfit_pad" else df.where(F.col("n_tokens") <= CAP).count() for x in P.ALGOS}
    for algo in P.ALGOS:
        plan = _plan(df, algo)
        assert plan.groupBy("grp", "row_id").agg(F.sum("take").alias("t")).where(F.col("t") > CAP).isEmpty(), algo
        assert plan.count() == plan.select("doc_id").distinct().count() == n[algo]
    assert P.pack_rejects(df, CAP).count() == n["ffd"] - n["bestfit_pad"]
    kept = {x: _plan(df, x).agg(F.sum("take")).first()[0] for x in ("bestfit_crop", "greedy_crop")}
    assert kept["bestfit_crop"] >= kept["greedy_crop"]


def test_results_independent_of_shuffle_partitions(spark):
    df = _docs(spark)
    a = sorted(_plan(df, "bestfit_crop").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(_plan(df, "bestfit_crop").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_groups_run_in_several_tasks(spark):
    df = _docs(spark).withColumn("grp", F.col("doc_id") % 16)
    parts = _plan(df, "greedy_crop").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 3


def test_udtf_equals_map_in_pandas(spark):
    df = _docs(spark)
    plan = sorted(tuple(r) for r in _plan(df, "bestfit_crop").collect())
    spark.udtf.register("t_pack", P.make_pack_udtf(CAP, BUFFER, crop=True))
    df.select("grp", "pos", "doc_id", F.col("n_tokens").alias("n"), F.col("batch").alias("bkey")).createOrReplaceTempView("t_in")
    u = spark.sql("SELECT * FROM t_pack(TABLE(t_in) PARTITION BY grp ORDER BY pos)").collect()
    assert sorted(tuple(r) for r in u) == plan


def test_stream_pack_equals_batch_plan(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    stream = sorted(tuple(r) for r in E.queries()["str07_stream_pack"](spark, sf).collect())
    batch = sorted(tuple(r) for r in E.queries()["pck01_bestfit_crop"](spark, sf).collect())
    assert stream == batch
