"""What must not grow with the input: plans, batches, rounds and micro-batches."""

from pyspark.sql import functions as F

from tokenmill.operators import conversation as CV


def test_render_parses_a_derived_message_once(spark):
    """Messages that are themselves worked out are worked out once, not once for each place that names them."""
    rows = spark.range(3).select("id", F.concat(F.lit("a <<1+1=2>> b "), F.col("id").cast("string")).alias("t"))
    parts = CV.parse_tool_calls("t")
    none = F.lit(None).cast("array<struct<type:string,text:string>>")
    msg = lambda turn, role, text, p: F.struct(F.lit(turn).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"), p.alias("parts"))
    r = CV.render(rows.select("id", F.array(msg(0, "user", "?", none), msg(1, "assistant", "", parts)).alias("messages")), max_tokens=None)
    plan = r.select("id", "ids", "mask")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert plan.count("ArrowEvalPython") == 1
    got = {x["id"]: (x["ids"], x["mask"]) for x in r.collect()}
    assert got[2][0] == [256, 257, 63, 258, 259, 97, 32, 261, 49, 43, 49, 262, 263, 50, 264, 32, 98, 32, 50, 260]
    assert got[2][1] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1]


def test_index_over_many_frequent_values(spark, monkeypatch):
    """Values that fill several buckets each are cut by one more aggregate; nulls, NaN and infinite second keys keep their order."""
    from tokenmill.operators import ordering
    nan, inf = float("nan"), float("inf")
    seconds = [None, nan, inf, -inf, *[float(x * x) for x in range(36)]]
    rows = [(k, s, f"{k}/{s}") for k in (None, nan, -1.5, *[float(x) for x in range(12)]) for s in seconds]
    df = spark.createDataFrame(rows, "k double, s double, id string").repartition(3)
    calls = []
    first = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: calls.append(1) or first(self))
    got = ordering.with_index(df, ["k", "s", "id"], rows_per_bucket=8).collect()
    assert len(calls) <= 3
    want = [r["id"] for r in df.orderBy("k", "s", "id").collect()]
    assert [r["id"] for r in sorted(got, key=lambda r: r["idx"])] == want
    assert sorted(r["idx"] for r in got) == list(range(len(rows)))
    b, n = ordering.range_bucket(df, ["k", "s"], 8)
    assert b.groupBy("_bkt").count().agg(F.max("count")).first()[0] < 64  # not one bucket for each value


def test_words_are_found_once(spark, sf):
    """The generators read stored words, whatever number of times they need them."""
    from tokenmill.plans.q_tasks import corpus_words, letter_rows
    assert corpus_words(spark, sf) is corpus_words(spark, sf)
    assert "regexp_extract_all" not in letter_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path):
    from tokenmill.plans.q_stream import N_FILES, _per_batch
    for files in (1, N_FILES, 3 * N_FILES):
        path = str(tmp_path / str(files))
        spark.range(40).repartition(files).write.parquet(path)
        assert _per_batch(spark, path) == max(1, files // N_FILES)


def test_batches_for_python_are_bounded_by_bytes(spark):
    from tokenmill.operators import scoring, tokenizer
    from tokenmill.session import BATCH_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, model = spark.createDataFrame([("a b",)], "text string"), tokenizer.BPEModel()
    for use in (lambda: tokenizer.byte_encode(docs), lambda: tokenizer.bpe_encode(docs, model), lambda: scoring.byte_pair_counts(docs, [])):
        spark.conf.set(key, str(1 << 30))
        use()
        assert int(spark.conf.get(key)) == BATCH_BYTES
    spark.conf.set(key, "1000")
    tokenizer.byte_encode(docs)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)
