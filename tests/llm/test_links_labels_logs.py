"""Relative links of the URL filter, languages beyond any fixed number, the event log of chats, clashing names of redaction."""

from __future__ import annotations

from collections import Counter
from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from tokenmill.llm import chat, langid, secrets, urls
from tokenmill.llm.common import labelled_sample

BASES = ["http://a.example.com/x/y/z.html?q=1#f", "https://a.example.com", "https://a.example.com/x/", "http://a.example.com/x"]
TARGETS = ["page.html", "../up.html", "../../../../top", "./here/./there/../x", "?id=3", "/abs/../root.html?x=../y", "//b.example.org/p", "https://c.example.net/fr/1", "sub/?a=1&amp;b=2#frag", "..", ".", ""]


def test_relative_targets_are_resolved_like_a_browser_does(spark):
    rows = spark.createDataFrame([(b, t) for b in BASES for t in TARGETS], "base string, target string")
    got = {(r.base, r.target): r.u for r in rows.select("base", "target", urls.absolute(F.col("target"), F.col("base")).alias("u")).collect()}
    node = lambda u: spark.createDataFrame([(u,)], "u string").select(urls.node_of(F.col("u"))).first()[0]
    for (base, target), u in got.items():
        if target:
            want = urljoin(base, target.replace("&amp;", "&"))
            assert u == want or node(u) == node(want), (base, target, u, want)
        else:
            assert u is None
    odd = spark.createDataFrame([("http://a.b/c", t) for t in ("#top", "mailto:x@y.z", "javascript:void(0)", "  ")], "base string, target string")
    assert {r[0] for r in odd.select(urls.absolute(F.col("target"), F.col("base"))).collect()} == {None}


def test_block_decisions_reach_relative_aliases(spark):
    canon = lambda t: f'<html><link rel="canonical" href="{t}"><p>x</p></html>'
    rows = [(1, "http://example.com/en/story/1.html", None), (2, "http://shop.net/a/b.html", canon("http://example.com/en/story/1.html")), (3, "http://shop.net/a/c.html", canon("b.html")),
            (4, "http://shop.net/a/d/e.html", canon("../c.html")), (5, "http://shop.net/a/c.html?id=7", canon("?")), (6, "http://free.org/q", canon("?id=3")), (7, "http://free.org/q?id=3", None),
            (8, "http://free.org/z", None), (9, "http://other.org/p", '<meta http-equiv="refresh" content="0; url=../x/../a">'), (10, "http://other.org/a", canon("http://shop.net/a/b.html")), (11, None, canon("x")), (12, "nothing", canon("x"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "alias_of").collect()
    blocked = {r.page_id for r in got if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 5, 9, 10}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert Counter(map(tuple, got)) == Counter(con.execute(urls.judge_sql()).fetchall())


def test_every_language_is_learned_from(spark):
    word = lambda k, n: " ".join(chr(0x4E00 + 7 * k) + chr(0x4E00 + 11 * k + j % 3) for j in range(n))
    rows = [(10 * k + j, word(k, 4 + j), f"l{k:03d}") for k in range(300) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(docs, 4, 2, per_language=2).languages) > 280  # all but those whose texts are all held out
    ids = docs.select("doc_id", "lang")
    assert labelled_sample(docs, ids, "lang", 3, most=10).groupBy("label").count().agg(F.count("*"), F.max("count")).first() == (300, 1)
    assert labelled_sample(docs, ids, "lang", 3, most=600).groupBy("label").count().agg(F.count("*"), F.min("count"), F.max("count")).first() == (300, 2, 2)


def test_the_log_holds_every_operation_and_folds_to_the_turns(spark):
    rows = [(1, 1, "user", "first question"), (1, 2, "assistant", "an answer"), (1, 3, "system", "note"), (2, 1, "assistant", ""), (2, 2, None, None), (None, 1, "user", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.turn_events(conv)
    assert {r.op for r in log.select("op").distinct().collect()} == {"start", "delta", "edit", "regenerate", "delete"}
    assert log.groupBy("conv_id", "seq").count().where("count > 1").isEmpty()
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(log).collect()}
    assert got == {1: [("user", "first question"), ("assistant", "an answer"), ("system", "note")], 2: [("assistant", ""), ("", "")], None: [("user", "x")]}


def test_redaction_keeps_columns_of_any_name(spark):
    key = "password = hunter2hunter2"
    docs = spark.createDataFrame([(1, key, "kept", 3)], "doc_id long, text string, __cut string, n_chars int")
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.first()["__cut"] == "kept" and "hunter2" not in out.first()["text"]


def test_ftrl_updates_are_those_of_the_plain_rule():
    """Follow the regularised leader, one coordinate at a time in Python numbers."""
    import math

    import numpy as np

    from tokenmill.llm import quality

    rng = np.random.default_rng(4)
    labels = [1, 0, 0, 1, 0, 0]
    examples = [(np.append(np.sort(rng.choice(9, 4, replace=False)), quality.BUCKETS), np.append(rng.random(4) * 5, 1.0)) for _ in labels]
    model = quality.fit(examples, labels, 0.3)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for k in range(quality.PASSES):
        for e in np.random.default_rng(k).permutation(len(examples)):
            at, x = (v.tolist() for v in examples[e])
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i, wi, xi in zip(at, w, x):
                g = (0.5 * 6 / 2 if labels[e] else 0.5 * 6 / 4) * (p - labels[e]) * xi
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose([model.weights[i] for i in range(9)], [weight(i) for i in range(9)], atol=1e-5)
    assert abs(model.bias - (weight(quality.BUCKETS) + math.log(0.3 / 0.7))) < 1e-6


def test_language_decoding_is_that_of_plain_sums():
    """Each bit's output is a mean of weights over the text's n-grams; a language's loss is the trusted sum of logistic losses."""
    import math

    texts = {"aa": "the cat and the dog", "bb": "der hund und die katze", "cc": "el perro y el gato", "dd": "le chien et le chat"}
    learned = [(langid.letters_of(f"{t} {k}x{chr(97 + k)}"), x) for k in range(12) for x, t in texts.items()]
    model = langid.fit([t for t, _ in learned], [x for _, x in learned])
    predict = langid.Predictor(model)
    for text in ("a cat", "hund", "y", "chat et chien", "xyz"):
        grams = langid.buckets_of(langid.letters_of(text)).tolist()
        outputs = [sum(float(model.weights[g, b]) for g in grams) / len(grams) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(float(model.trust[b]) * math.log1p(math.exp(-f * int(word[b]))) for b, f in enumerate(outputs)) for word in model.code]
        share = [math.exp(-model.sharpness * (x - min(loss))) for x in loss]
        (lang, score, ambiguous), = predict([text])
        best = max(range(4), key=lambda i: share[i])
        assert lang == model.languages[best] and abs(score - share[best] / sum(share)) < 1e-4
        top = sorted(share)[-2:]
        assert ambiguous == ((top[1] - top[0]) / sum(share) < langid.CLEAR)
