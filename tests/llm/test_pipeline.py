"""Every stage of the pipeline against a brute-force version on its own input, and the registered queries' results."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from tokenmill.llm import langid, packing, queries
from tests_of_ops import brute_components, brute_leaks, brute_spans, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Output of every stage, each written and read again, over documents with planted rows and a clashing column."""
    docs = table(spark, sf, "documents")
    item = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    base = docs.where("lang = 'en' and n_chars > 900").orderBy("doc_id").first()["text"]
    planted = [(9001, f"{base[:400]} {item} {base[400:800]}", "en"), (9002, base, "en"), (9003, base.replace("the", "thx", 1), "en"), (9004, None, "en"), (9005, "", "fr"), (9006, "123 !!", "de"),
               (9007, f"{base[5:600]} password = abcdef123 {base[600:900]}", "en"), (9007, f"{base[5:600]} password = abcdef123 {base[600:900]}", "en"), (None, base[:700], "en")]
    more = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in planted], docs.schema)
    rows = docs.union(more).withColumn("length", F.lit("clash"))
    out = [rows.checkpoint()]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], sf).checkpoint())
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay_until_the_last_stage(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1]) and len(P.STAGES) == 5


def test_language_stage_drops_what_is_rejected(spark, stages):
    model = langid.train(stages[0], 4, 2)
    rows = texts(stages[0])
    keep = [lang != "und" and not ambiguous for lang, _, ambiguous in langid.Predictor(model)([t for _, t in rows])]
    assert Counter(texts(stages[1])) == Counter(r for r, k in zip(rows, keep) if k)
    assert sum(keep) >= 0.97 * len(rows)


def test_join_stage_keeps_one_of_each_group(stages):
    rows = texts(stages[1])
    stay = {c for _, _, c in brute_components(rows) if c is not None}
    got = texts(stages[2])
    assert Counter(i for i, _ in got if i is not None) == Counter(stay)
    assert Counter(t for i, t in got if i is None) == Counter(t for i, t in rows if i is None)


def test_decontamination_stage_drops_leaks(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    rows = texts(stages[2])
    leaked = {d for d, _ in brute_leaks([(k, t) for k, (_, t) in enumerate(rows)], items)}
    assert leaked and Counter(texts(stages[3])) == Counter(r for k, r in enumerate(rows) if k not in leaked)


def test_secret_stage_redacts_and_keeps_every_document(stages):
    before, after = texts(stages[3]), dict(texts(stages[4]))
    assert sorted(after, key=str) == sorted((i for i, _ in before), key=str)
    for i, t in before:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(t).split(",") if s]
        want, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert after[i] == want + (t or "")[at:]
    assert stages[4].where(F.col("n_chars") != F.length("text")).isEmpty()


def test_packing_stage_holds_every_document(stages):
    want = packing.tokenized_pieces(stages[4], queries.public_tokenizers.path(queries.TOKENIZER))
    assert stages[5].select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(stages[5].select(want.columns)).isEmpty()
    rows = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert rows.where((F.col("n") > 1024) | (F.col("n") != F.col("end"))).isEmpty()


def test_run_is_the_stages_one_after_the_other(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf).checkpoint()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert P.run(spark, sf).select(cols).exceptAll(docs.select(cols)).isEmpty()


def test_one_query_for_each_operator_and_the_pipeline():
    names = E.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


CONTRACT = {"op1": "doc_id piece start length ids_crc32 sequence_id offset", "op2": "doc_id held_out score predicted", "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
            "op5": "doc_id held_out lang_pred score", "op6": "page_id host path rule verdict", "op7": "doc_id n_shingles component_id", "op8": "doc_id held_out score predicted",
            "op9": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op10": "doc_id n_assign n_access n_hex base_sha256 spans"}


@pytest.mark.parametrize("op", CONTRACT)
def test_contract_columns_and_rows(spark, sf, op):
    name = next(n for n in queries.QUERIES if n.startswith(f"{op}_"))
    df = queries.QUERIES[name](spark, sf)
    assert set(CONTRACT[op].split()) <= set(df.columns)
    n = df.count()
    if op == "op6":
        assert n == table(spark, sf, "pages").count()
    elif op == "op9":
        assert n == table(spark, sf, "conversations").select("conv_id").distinct().count() + 1
    elif op != "op1":
        assert n == table(spark, sf, "documents").count()
