"""Corpus scan, filter and ordering queries (SRC-*, FLT-01/02/07, WIN-01..03, SRT-01, AGG-19/20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_sql
from tokenmill.operators import ordering
from tokenmill.operators.filters import char_budget, crop_docs, min_length
from tokenmill.operators.stats import shard_totals, text_stats
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import CORPUS_SQL, corpus
from tokenmill.sources import corpus as C
from tokenmill.session import table


@register("src02_split_scan", sql=f"""
WITH {CORPUS_SQL}
SELECT split, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       CAST(min(doc_id) AS BIGINT) AS first_doc, CAST(max(doc_id) AS BIGINT) AS last_doc,
       CAST(count(DISTINCT shard_idx) AS BIGINT) AS n_shards
FROM corpus_split GROUP BY split
""")
def split_scan(spark, sf):
    c = corpus(spark, sf)
    parts = [C.split(c, s).withColumn("split", F.lit(s)) for s in ("train", "val")]
    u = parts[0].unionByName(parts[1])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("bigint").alias("n_chars"),
                                  F.min("doc_id").cast("bigint").alias("first_doc"),
                                  F.max("doc_id").cast("bigint").alias("last_doc"),
                                  F.countDistinct("shard_idx").alias("n_shards"))


@register("src01_shard_listing", sql=f"""
WITH {CORPUS_SQL}
SELECT CAST(shard_idx AS BIGINT) AS shard_idx, CAST(count(DISTINCT rg_idx) AS BIGINT) AS n_row_groups,
       CAST(count(*) AS BIGINT) AS n_docs
FROM corpus GROUP BY shard_idx
""")
def shard_listing(spark, sf):
    c = corpus(spark, sf)
    return c.groupBy(F.col("shard_idx").cast("bigint").alias("shard_idx")).agg(
        F.countDistinct("rg_idx").alias("n_row_groups"), F.count(F.lit(1)).alias("n_docs"))


@register("src03_row_group_stride", sql=f"""
WITH {CORPUS_SQL}
SELECT doc_id, CAST(shard_idx AS BIGINT) AS shard_idx, CAST(rg_idx AS BIGINT) AS rg_idx
FROM corpus_split WHERE split = 'train' AND rg_idx >= 1 AND (rg_idx - 1) % 2 = 0
""")
def row_group_stride(spark, sf):
    tr = C.split(corpus(spark, sf), "train")
    s = C.stride(tr, start=1, step=2)
    return s.select("doc_id", F.col("shard_idx").cast("bigint").alias("shard_idx"),
                    F.col("rg_idx").cast("bigint").alias("rg_idx"))


@register("src04_assign_rank", sql=f"""
WITH {CORPUS_SQL}
SELECT CAST(rg_idx % 3 AS BIGINT) AS rank, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(count(DISTINCT (shard_idx, rg_idx)) AS BIGINT) AS n_row_groups,
       CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM corpus_split WHERE split = 'train' GROUP BY rg_idx % 3
""")
def assign_rank(spark, sf):
    r = C.assign_rank(C.split(corpus(spark, sf), "train"), 3)
    return r.groupBy(F.col("rank").cast("bigint").alias("rank")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.countDistinct("shard_idx", "rg_idx").alias("n_row_groups"),
        F.sum("n_chars").cast("bigint").alias("n_chars"))


@register("src05_doc_batches", sql=f"""
WITH {CORPUS_SQL}
SELECT CAST(shard_idx AS BIGINT) AS shard_idx, CAST(rg_idx AS BIGINT) AS rg_idx, CAST(row_in_rg // 5 AS BIGINT) AS batch,
       CAST(count(*) AS BIGINT) AS n_docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY row_in_rg) AS doc_ids
FROM corpus GROUP BY shard_idx, rg_idx, row_in_rg // 5
""")
def doc_batches(spark, sf):
    b = C.doc_batches(corpus(spark, sf), n=5)
    return b.select(F.col("shard_idx").cast("bigint").alias("shard_idx"), F.col("rg_idx").cast("bigint").alias("rg_idx"),
                    F.col("batch").cast("bigint").alias("batch"), F.size("doc_ids").cast("bigint").alias("n_docs"),
                    F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@register("src06_resume_scan", sql=f"""
WITH {CORPUS_SQL}
SELECT doc_id, CAST(shard_idx AS BIGINT) AS shard_idx, CAST(rg_idx AS BIGINT) AS rg_idx,
       CAST(rg_idx % 2 AS BIGINT) AS rank, CAST(2 AS BIGINT) AS epoch
FROM corpus_split
WHERE split = 'train' AND (shard_idx > 3 OR (shard_idx = 3 AND rg_idx // 2 > 2 // 2))
""")
def resume_scan(spark, sf):
    tr = C.split(corpus(spark, sf), "train")
    r = C.resume_from(tr, {"pq_idx": 3, "rg_idx": 2, "epoch": 2}, world=2)
    return r.select("doc_id", F.col("shard_idx").cast("bigint").alias("shard_idx"),
                    F.col("rg_idx").cast("bigint").alias("rg_idx"), F.col("rank").cast("bigint").alias("rank"),
                    F.col("epoch").cast("bigint").alias("epoch"))


@register("src07_repeat_epochs", sql=f"""
WITH {CORPUS_SQL}, e AS (SELECT doc_id, pos, unnest(range(1, 4)) AS epoch FROM corpus)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch,
       CAST(row_number() OVER (ORDER BY epoch, pos) - 1 AS BIGINT) AS seq
FROM e
""")
def repeat_epochs(spark, sf):
    docs = corpus(spark, sf).select("doc_id", "pos")
    n = docs.agg(F.max("pos") + 1).scalar()
    e = C.repeat_epochs(docs, 3).withColumn("_k", (F.col("epoch") - 1) * n + F.col("pos"))
    return ordering.with_index(e, ["_k"], name="seq").select("doc_id", F.col("epoch").cast("bigint").alias("epoch"), "seq")


@register("src15_missing_shards", sql=f"""
WITH {CORPUS_SQL},
present AS (SELECT DISTINCT shard_idx FROM corpus WHERE n_chars > 15000),
n AS (SELECT max(shard_idx) AS last FROM corpus),
wanted AS (SELECT range AS shard_idx FROM range(0, (SELECT last FROM n) + 3)
           UNION SELECT last FROM n)
SELECT CAST(shard_idx AS BIGINT) AS shard_idx FROM wanted
WHERE shard_idx NOT IN (SELECT shard_idx FROM present)
""")
def missing_shards(spark, sf):
    c = corpus(spark, sf)
    present = c.where(F.col("n_chars") > 15000).select("shard_idx").distinct()
    last = c.agg(F.max("shard_idx")).first()[0]  # one scalar: the val shard id
    return C.missing_shards(spark, last + 3, present, last)


@register("flt01_crop_docs", sql="""
SELECT doc_id, CAST(length(substring(text, 1, 10000)) AS BIGINT) AS n_chars,
       md5(substring(text, 1, 10000)) AS text_md5
FROM documents
""")
def crop(spark, sf):
    d = crop_docs(table(spark, sf, "documents"), cap=10000)
    return d.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("flt02_char_budget", sql=f"""
WITH {CORPUS_SQL},
c AS (SELECT doc_id, pos, length(substring(text, 1, 10000)) AS n FROM corpus_split WHERE split = 'train'),
p AS (SELECT doc_id, n, sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, CAST(before AS BIGINT) AS chars_before FROM p WHERE before <= 300000
""")
def budget(spark, sf):
    tr = crop_docs(C.split(corpus(spark, sf), "train"), cap=10000)
    b = char_budget(tr, 300000, ["pos"], bucket=(F.col("pos") / 4096).cast("bigint"))
    return b.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
                    F.col("chars_before").cast("bigint").alias("chars_before"))


@register("flt07_min_length", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents WHERE length(text) >= 100 GROUP BY lang
""")
def min_len(spark, sf):
    d = min_length(table(spark, sf, "documents"), 100)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("bigint").alias("n_chars"))


@register("win01_dense_index", sql="""
SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS idx FROM documents
""")
def dense_index(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return ordering.with_index(d, ["n_chars", "doc_id"], rows_per_bucket=64).select("doc_id", "idx")


@register("win02_prefix_sum", sql="""
SELECT doc_id, CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS BIGINT) AS cum_bytes
FROM documents
""")
def prefix_sum_q(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("nb"))
    return ordering.prefix_sum(d, "nb", ["doc_id"], name="cum_bytes", rows_per_bucket=100).select("doc_id", "cum_bytes")


@register("win03_member_offsets", sql="""
WITH m AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns,
       CAST(sum(n_turns) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_turns AS BIGINT) AS offset
FROM m
""")
def member_offsets(spark, sf):
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return ordering.member_offsets(m, "n_turns", ["conv_id"]).select("conv_id", "n_turns", "offset")


@register("srt01_permute", sql=f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {hash_sql(42, "doc_id")}, doc_id) - 1 AS BIGINT) AS perm_idx
FROM documents
""")
def permute(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return ordering.permute(d, "doc_id", seed=42)


@register("agg19_text_stats", sql="""
SELECT source, CAST(count(*) AS BIGINT) AS n_files,
       CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n_lines,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_chars,
       CAST(sum(octet_length(encode(text))) // 4 AS BIGINT) AS n_tokens_approx
FROM documents GROUP BY source
""")
def text_stats_q(spark, sf):
    return text_stats(table(spark, sf, "documents"), ["source"])


@register("agg20_shard_totals", sql=f"""
WITH {CORPUS_SQL},
s AS (SELECT shard_idx, count(*) AS n_docs, sum(n_chars) AS n_chars FROM corpus GROUP BY shard_idx)
SELECT CAST(shard_idx AS BIGINT) AS shard_idx, CAST(n_docs AS BIGINT) AS n_docs, CAST(n_chars AS BIGINT) AS n_chars,
       CAST(sum(n_docs) OVER (ORDER BY shard_idx) AS BIGINT) AS total_docs,
       CAST(sum(n_chars) OVER (ORDER BY shard_idx) AS BIGINT) AS total_chars
FROM s
""")
def shard_totals_q(spark, sf):
    return shard_totals(corpus(spark, sf))
