"""Literal cases (FIXTURES.md part C) and ordering invariants."""

from pyspark.sql import functions as F

from tokenmill.operators import conversation as CV
from tokenmill.operators import ordering as O
from tokenmill.operators import runlogs as RL


def test_classify_lines(spark):
    cases = [
        ("step 00017/02520 | loss: nan | lrm: 0.42", "nonfinite_loss", "loss_nan"),
        ("Step 00010 | Validation bpb: NaN", "nonfinite_validation", "validation_nan"),
        ("RUNPOD_GUARD_FAIL reason=nonfinite_loss step=17 micro_step=3 model_tag=d12", "guard_fail", "nonfinite_loss"),
        ("Traceback (most recent call last):", "traceback", "traceback"),
        ("RuntimeError: CUDA error: device-side assert triggered", "cuda_error", "cuda_error"),
        ("loss: -inf", "nonfinite_loss", "loss_-inf"),
        ("step 00001/00010 | loss: 2.345", None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "line string")
    got = [(r["c"]["kind"], r["c"]["reason"]) for r in df.select(RL.classify_line("line").alias("c")).collect()]
    assert got == [(c[1], c[2]) for c in cases]


def test_guard_fields(spark):
    df = spark.createDataFrame([('RUNPOD_GUARD_FAIL reason=a step=17 x y=1 y="2"',)], "line string")
    m = df.select(RL.parse_fields(F.regexp_extract("line", RL.GUARD_RE, 1)).alias("m")).first()["m"]
    assert m == {"reason": "a", "step": "17", "y": "2"}


def test_model_tags(spark):
    df = spark.createDataFrame([("d12-grkan-g4",), ("d12-grkan-g16",), ("d12-mlp",), ("d8-grkan",)], "t string")
    got = [tuple(r["m"]) for r in df.select(RL.parse_model_tag("t").alias("m")).collect()]
    assert got == [(12, "grkan", 4), (12, "grkan", 16), (12, "mlp", None), (8, "grkan", 8)]


def test_state_regression(spark):
    states = ["launched", "running", "stopping", "stopped", "running"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "run int, ts int, state string")
    v = [r["violation"] for r in RL.state_violations(df).orderBy("ts").collect()]
    assert v == [False, False, False, False, True]


def test_tool_calls_and_answer(spark):
    ans = "12/60 = $<<12/60=0.2>>0.2 per minute\n#### 10"
    df = spark.createDataFrame([(ans,), ("no answer",)], "a string")
    r = df.select(CV.parse_tool_calls("a").alias("p"), CV.extract_answer("a").alias("x"),
                  CV.parts_to_text(CV.parse_tool_calls("a")).alias("back")).collect()
    parts = [(p["type"], p["text"]) for p in r[0]["p"]]
    assert parts == [("text", "12/60 = $"), ("python", "12/60"), ("python_output", "0.2"),
                     ("text", "0.2 per minute\n#### 10")]
    assert r[0]["x"] == "10" and r[1]["x"] is None
    assert r[0]["back"] == ans


def test_index_and_permutation(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    idx = O.with_index(df, ["k"], rows_per_bucket=300).collect()
    assert sorted((r["k"], r["idx"]) for r in idx) == [(i, i) for i in range(5000)]
    perm = O.permute(df, "k", seed=3).collect()
    assert sorted(r["perm_idx"] for r in perm) == list(range(5000))  # bijection
    perm2 = O.permute(df, "k", seed=3, n_buckets=16).collect()
    assert sorted((r["k"], r["perm_idx"]) for r in perm) == sorted((r["k"], r["perm_idx"]) for r in perm2)


def test_prefix_sum_matches_running_sum(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = sorted((r["k"], r["cum"]) for r in O.prefix_sum(df, "v", ["k"], rows_per_bucket=250).collect())
    run, exp = 0, []
    for k in range(3000):
        run += k % 7
        exp.append((k, run))
    assert got == exp


def test_strip_sees_unicode_white_space(spark):
    import duckdb
    from tokenmill.functions.text import strip, strip_sql
    cases = [" a ", " \t\n\x0b\x0c\r\x1c\x85a b　\n", "", " ", "a​", "\nx\n\n"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r["s"] for r in df.orderBy("i").select(strip("t").alias("s")).collect()] == [c.strip() for c in cases]
    con = duckdb.connect()
    assert [con.execute(f"SELECT {strip_sql('?')}", [c]).fetchall()[0][0] for c in cases] == [c.strip() for c in cases]


def test_program_without_fence_loses_its_last_newline(spark):
    df = spark.createDataFrame([("def f(x):\n    return 1\n",), ("x\n```python\n  y = 1 \n\n```\nz",)], "c string")
    assert [r["p"] for r in df.select(CV.extract_program("c").alias("p")).collect()] == ["def f(x):\n    return 1", "y = 1"]


def test_bytes_that_are_no_utf8_are_replaced(spark):
    from tokenmill.functions.text import bytes_to_text
    cases = [[0xFF, 0x41], [0xE2, 0x82], [0x41, 300, 0xC3, 0xA9], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>")
    want = [bytes(x for x in c if x < 256).decode("utf-8", "replace") for c in cases]
    assert [r["t"] for r in df.orderBy("i").select(bytes_to_text("ids").alias("t")).collect()] == want


def test_calculator_floor_division():
    from tokenmill.functions.calculator import calculate
    assert [calculate(e) for e in ("7//2", "12/60", "2**3", "-(3+4)*2", "'abca'.count('a')", "1//0", "__import__")] == ["3", "0.2", None, "-14", "2", None, None]


def test_ema_keeps_the_whole_history(spark):
    for beta in (0.5, 0.9, 0.999):
        df = spark.range(3000).select(F.lit(1).alias("run"), F.col("id").alias("step"), (F.sin("id") + 2).alias("x"))
        got = [r["ema"] for r in RL.ema(df, "x", beta).orderBy("step").collect()]
        xs = [r["x"] for r in df.orderBy("step").collect()]
        s = 0.0
        for t, (x, g) in enumerate(zip(xs, got)):
            s = beta * s + (1 - beta) * x
            assert abs(g - s / (1 - beta ** (t + 1))) < 1e-9


def test_buckets_are_even_whatever_the_keys(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.exp(F.col("id") / 2000)).cast("double").alias("k"))
    b, _ = O.range_bucket(df, ["k", "id"], rows_per_bucket=500)
    sizes = [r["count"] for r in b.groupBy("_bkt").count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 20_000
    got = [r["id"] for r in O.with_index(df, ["k", "id"], rows_per_bucket=500).orderBy("idx").collect()]
    assert got == [r["id"] for r in df.orderBy("k", "id").collect()]


def test_items_with_empty_spans_stay(spark):
    from tokenmill.operators import evaluation as EV
    choices = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 0)], "item_id int, choice int, gold int")
    losses = spark.createDataFrame([(1, 1, 9.0)], "item_id int, choice int, loss double")
    got = {r["item_id"]: (r["pred"], r["correct"]) for r in EV.decide_choice(losses, choices).collect()}
    assert got == {1: (1, True), 2: (0, True)}
    none = spark.createDataFrame([], "item_id int, argmax_token int, b int")
    assert [r["correct"] for r in EV.decide_lm(none, choices.select("item_id").distinct()).collect()] == [True, True]


def test_draw_above_the_rounded_sum_takes_the_last_token(spark):
    from tokenmill.operators import evaluation as EV
    s = spark.createDataFrame([(1, t, 0.1 * t) for t in range(10)], "g int, token int, logit double")
    import unittest.mock as m
    with m.patch.object(EV, "hash_unit", lambda *a: F.lit(1.0 + 1e-9)):
        assert EV.topk_softmax(s, ["g"], 0, 1.0, 1).first()["sampled"] == 0


def test_unmergeable_conversations_are_not_rendered(spark):
    rows = [(1, [("system", "a"), ("assistant", "b")]), (2, [("user", "a"), ("tool", "b")]), (3, [("system", "s"), ("user", "a"), ("assistant", "b")])]
    df = spark.createDataFrame([(i, [(k, r, t, None) for k, (r, t) in enumerate(m)]) for i, m in rows],
                               "conv_id int, messages array<struct<turn:bigint,role:string,text:string,parts:array<struct<type:string,text:string>>>>")
    assert [r["conv_id"] for r in CV.render(df).collect()] == [3]
    assert {r["conv_id"]: r["reason"] for r in CV.unrenderable(df).collect()} == {1: "system_not_followed_by_user", 2: "bad_role"}


def test_tool_calls_are_rendered_with_their_masks(spark):
    parts = [("text", "a"), ("python", "1+1"), ("python_output", "2"), ("text", "b")]
    df = spark.createDataFrame([(1, [(0, "user", "q", None), (1, "assistant", "", parts)])],
                               "conv_id int, messages array<struct<turn:bigint,role:string,text:string,parts:array<struct<type:string,text:string>>>>")
    r = CV.render(df).first()
    sp = CV.byte_special
    want = [(sp("<|bos|>"), 0), (sp("<|user_start|>"), 0), (ord("q"), 0), (sp("<|user_end|>"), 0), (sp("<|assistant_start|>"), 0), (ord("a"), 1),
            (sp("<|python_start|>"), 1), *[(ord(c), 1) for c in "1+1"], (sp("<|python_end|>"), 1), (sp("<|output_start|>"), 0), (ord("2"), 0),
            (sp("<|output_end|>"), 0), (ord("b"), 1), (sp("<|assistant_end|>"), 1)]
    assert list(zip(r["ids"], r["mask"])) == want


def test_nonfinite_values_at_any_depth(spark):
    from tokenmill.operators import tasks as TS
    schema = "i int, x double, s struct<a:float,t:struct<b:array<double>,c:string>>, m map<string,double>, l array<struct<q:double>>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1.0, (1.0, ([1.0], "c")), {"k": 2.0}, [(1.0,)]), (1, nan, (inf, ([1.0, -inf, nan], "c")), {"k": nan}, [(1.0,), (inf,)]), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r["i"]: r["nonfinite"] for r in TS.nonfinite_columns(df, ["i", "x", "s", "m", "l"]).collect()}
    assert got == {0: None, 1: "x,s.a,s.t.b[],m{},l[].q", 2: None}


def test_every_check_of_a_run(spark):
    from tokenmill.operators import joins as JN
    full = ["model", "meta", "optim"]
    rows = [(0, "complete", 5, 9, full, False, 9, True), (1, "running", 5, 9, full, False, 9, True), (2, "complete", 5, 9, full, False, 9, True),
            (3, "complete", None, 9, full, False, 9, True), (4, "complete", 5, 9, full, False, 9, True), (5, "complete", 5, 9, ["meta"], False, 9, True),
            (6, "complete", 5, 9, full, True, 9, True), (7, "complete", 5, 9, full, False, 8, True), (8, "complete", 5, 9, full, False, 9, False)]
    runs = spark.createDataFrame(rows, "run int, state string, log_lines int, final_step int, critical array<string>, meta_nonfinite boolean, meta_step int, has_cursor boolean")
    stops, missing = spark.createDataFrame([(4, "guard_fail")], "run int, kind string"), spark.createDataFrame([(2, "b*"), (2, "a")], "run int, pattern string")
    got = {r["run"]: r["reason"] for r in JN.verify_runs(runs, stops, missing).collect()}
    assert got == {0: None, 1: "state:running", 2: "missing:a,b*", 3: "no_log", 4: "stop:guard_fail", 5: "critical:model,optim", 6: "nonfinite_metadata",
                   7: "metadata_step", 8: "no_cursor"}


def test_checkpoints_by_name(spark):
    from tokenmill.sources.io import checkpoint_paths
    paths = ["a/d12/meta_000100.json", "d12-mlp/meta_5.json", "x/model_000100.pt", "b/other/meta_7.json", "meta_9.json", "c/tag=d4/meta_000001.json"]
    got = {r["path"]: (r["tag"], r["step"], r["depth"]) for r in checkpoint_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: ("d12", 100, 12), paths[1]: ("d12-mlp", 5, 12), paths[3]: ("other", 7, None), paths[5]: ("d4", 1, 4)}


def test_few_shot_draws_are_distinct_and_never_the_item(spark):
    from tokenmill.operators import evaluation as EV
    for n, k in ((1, 2), (2, 3), (5, 4), (60, 5)):
        items = spark.range(n).withColumnRenamed("id", "item_id")
        shots = {}
        for r in EV.fewshot(items, k, seed=3).collect():
            shots.setdefault(r["item_id"], []).append(r["shot_id"])
        assert all(i not in s and len(set(s)) == len(s) == min(k, n - 1) for i, s in shots.items()) and len(shots) == (n if n > 1 else 0)
    assert len({tuple(sorted((x - i) % 60 for x in s)) for i, s in shots.items()}) > 30  # not the same distances for all
