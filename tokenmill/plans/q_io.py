"""Source / sink round trips (SRC-08/10/11/12/14, SNK-01/02/04/05/06/07) on data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.hashing import hash_sql
from tokenmill.functions.text import bytes_to_text
from tokenmill.operators import evaluation as EV
from tokenmill.operators import tokenizer as TK
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import ROLLOUTS_SQL, rollouts
from tokenmill.plans.q_conversation import assembled
from tokenmill.plans.q_results import BASE_SQL, CHAT_BASELINES
from tokenmill.plans.q_tokenizer import BPE_SQL
from tokenmill.sources import corpus as C
from tokenmill.sources import io as IO
from tokenmill.session import table
from tokenmill.streaming.jobs import scratch

CHARS_PER_SHARD = 150_000
RG = 16


def _plan(spark, sf, drop_tail=True):
    return IO.reshard_plan(table(spark, sf, "documents"), CHARS_PER_SHARD, RG, seed=42, drop_tail=drop_tail)


RESHARD_SQL = f"""WITH RECURSIVE
p AS (SELECT doc_id, length(text) AS n,
             row_number() OVER (ORDER BY {hash_sql(42, "doc_id")}, doc_id) - 1 AS pos FROM documents),
r AS (SELECT pos // {RG} AS rg, sum(n) AS chars FROM p GROUP BY 1),
t(rg, acc, shard, closes) AS (
  SELECT rg, chars, 0, chars >= {CHARS_PER_SHARD} FROM r WHERE rg = 0
  UNION ALL
  SELECT r.rg, CASE WHEN t.closes THEN r.chars ELSE t.acc + r.chars END,
         CASE WHEN t.closes THEN t.shard + 1 ELSE t.shard END,
         (CASE WHEN t.closes THEN r.chars ELSE t.acc + r.chars END) >= {CHARS_PER_SHARD}
  FROM t JOIN r ON r.rg = t.rg + 1),
kept AS (SELECT rg, shard FROM t WHERE shard <= (SELECT max(shard) FROM t WHERE closes)),
f AS (SELECT rg, shard, rg - min(rg) OVER (PARTITION BY shard) AS rg_idx FROM kept),
plan AS (SELECT p.doc_id, p.n, CAST(f.shard AS BIGINT) AS shard_idx, CAST(f.rg_idx AS BIGINT) AS rg_idx
         FROM p JOIN f ON p.pos // {RG} = f.rg)"""


WHOLE_RESHARD_SQL = RESHARD_SQL.replace(" WHERE shard <= (SELECT max(shard) FROM t WHERE closes)", "")


@register("snk01_reshard_plan", sql=f"{RESHARD_SQL} SELECT doc_id, shard_idx, rg_idx FROM plan")
def reshard_plan_q(spark, sf):
    return _plan(spark, sf).select("doc_id", "shard_idx", F.col("rg_idx").cast("bigint").alias("rg_idx"))


@register("snk01_reshard_files", sql=f"""{RESHARD_SQL}
SELECT shard_idx, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars FROM plan GROUP BY shard_idx""")
def reshard_files_q(spark, sf):
    """Write the shards, then read them back as a corpus (SRC-01 over real files)."""
    docs = table(spark, sf, "documents")
    path = scratch(spark, "snk01")
    IO.write_reshard(docs, _plan(spark, sf), path, rows_per_group=RG)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("shard").cast("bigint").alias("shard_idx")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars"))


@register("src01_scan_corpus_files", sql=f"""{WHOLE_RESHARD_SQL}
SELECT shard_idx, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT rg_idx) AS BIGINT) AS n_row_groups,
       CAST(max(CASE WHEN shard_idx = (SELECT max(shard_idx) FROM plan) THEN 1 ELSE 0 END) AS BIGINT) AS is_val
FROM plan GROUP BY shard_idx""")
def scan_corpus_files_q(spark, sf):
    """Resharded files scanned back as a corpus: shard from the sorted file listing, row group
    from the files' footers, split from the last shard."""
    path = scratch(spark, "src01")
    IO.write_reshard(table(spark, sf, "documents"), _plan(spark, sf, drop_tail=False), path, rows_per_group=RG)
    c = C.with_split(C.scan_corpus(spark, path))
    return c.groupBy(F.col("shard_idx").cast("bigint").alias("shard_idx")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("rg_idx").alias("n_row_groups"),
        F.max(F.when(F.col("split") == "val", 1).otherwise(0)).cast("bigint").alias("is_val"))


@register("src01_row_groups", sql=f"""{WHOLE_RESHARD_SQL}
SELECT shard_idx, rg_idx, CAST(sum(count(*)) OVER w - count(*) AS BIGINT) AS first_row, CAST(count(*) AS BIGINT) AS n_rows
FROM plan GROUP BY shard_idx, rg_idx WINDOW w AS (PARTITION BY shard_idx ORDER BY rg_idx)""")
def row_groups_q(spark, sf):
    """The row groups that the written files really have."""
    path = scratch(spark, "src01g")
    IO.write_reshard(table(spark, sf, "documents"), _plan(spark, sf, drop_tail=False), path, rows_per_group=RG)
    return C.row_groups(spark, path).select(F.col("shard_idx").cast("bigint").alias("shard_idx"), F.col("rg_idx").cast("bigint").alias("rg_idx"), "first_row", "n_rows")


@register("src03_row_group_stride_files", sql=f"""{WHOLE_RESHARD_SQL}
SELECT shard_idx, rg_idx, md5(string_agg(text, chr(10) ORDER BY pos)) AS texts_md5
FROM plan JOIN (SELECT doc_id, text FROM documents) USING (doc_id) JOIN (SELECT doc_id, pos FROM p) USING (doc_id)
WHERE rg_idx >= 1 AND (rg_idx - 1) % 2 = 0 GROUP BY shard_idx, rg_idx""")
def row_group_stride_files_q(spark, sf):
    """Every second real row group from the second on, restarting with each file; texts in file order."""
    path = scratch(spark, "src03")
    IO.write_reshard(table(spark, sf, "documents"), _plan(spark, sf, drop_tail=False), path, rows_per_group=RG)
    c = C.stride(C.scan_corpus(spark, path), start=1, step=2)
    g = c.groupBy("shard_idx", "rg_idx").agg(F.array_sort(F.collect_list(F.struct("row_in_rg", "text"))).alias("t"))
    return g.select(F.col("shard_idx").cast("bigint").alias("shard_idx"), F.col("rg_idx").cast("bigint").alias("rg_idx"),
                    F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("texts_md5"))


@register("snk06_src08_conversations_jsonl", sql="""
WITH m AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT conv_id, max(n) AS n, bool_or(role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS bad FROM m
      GROUP BY conv_id)
SELECT CASE WHEN n < 2 THEN 'too_few_messages' WHEN bad THEN 'bad_role' ELSE 'ok' END AS reason,
       CAST(count(*) AS BIGINT) AS n
FROM c GROUP BY 1""")
def conversations_jsonl_q(spark, sf):
    path = scratch(spark, "snk06")
    IO.write_conversations(assembled(spark, sf), path)
    ok, bad = IO.read_conversations_jsonl(spark, path)
    u = ok.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason"))
    return u.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _chat_results(spark, sf):
    r = EV.accuracy(rollouts(spark, sf), ["task"])
    b = F.create_map(*[x for t, v in CHAT_BASELINES.items() for x in (F.lit(t), F.lit(v))])
    return r.withColumn("centered", EV.centered(F.col("accuracy"), b[F.col("task")], percent=False))


@register("snk04_src11_core_csv", sql=f"""
WITH {ROLLOUTS_SQL},
r AS (SELECT task, avg(CAST(correct AS DOUBLE)) AS acc FROM rollouts GROUP BY task),
c AS (SELECT task, acc, (acc - {BASE_SQL}) / (1.0 - {BASE_SQL}) AS centered FROM r)
SELECT task, round(acc, 6) AS accuracy, round(centered, 6) AS centered FROM c
UNION ALL SELECT 'CORE', NULL, round(avg(centered), 6) FROM c""")
def core_csv_q(spark, sf):
    path = scratch(spark, "snk04")
    IO.write_core_csv(_chat_results(spark, sf), path)
    return C.read_core_csv(spark, path)


RUN_SCHEMA = T.StructType([T.StructField("p_brand", T.StringType()), T.StructField("p_size", T.IntegerType()),
                           T.StructField("batch", T.IntegerType())])


@register("snk05_append_runs", sql="""
SELECT DISTINCT p_brand, p_size, CASE WHEN p_size <= 25 THEN 1 ELSE 2 END AS batch FROM part""")
def append_runs_q(spark, sf):
    path = scratch(spark, "snk05")
    keys = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    IO.append_runs(keys.where(F.col("p_size") <= 25).withColumn("batch", F.lit(1)), path, ["p_brand", "p_size"], RUN_SCHEMA)
    IO.append_runs(keys.withColumn("batch", F.lit(2)), path, ["p_brand", "p_size"], RUN_SCHEMA)  # re-run: skips present keys
    return spark.read.option("header", "true").schema(RUN_SCHEMA).csv(path)


@register("snk07_report_rows", sql=f"""
WITH {ROLLOUTS_SQL},
r AS (SELECT task, count(*) AS n, avg(CAST(correct AS DOUBLE)) AS acc FROM rollouts GROUP BY task),
items AS (SELECT task || ' accuracy' AS key, printf('%.4f', acc) AS v FROM r
          UNION ALL SELECT task || ' samples', CASE WHEN n >= 10000 THEN format('{{:,}}', n) ELSE CAST(n AS VARCHAR) END FROM r)
SELECT 'Chat evaluation' AS section, 'chat-evaluation' AS slug, '- ' || key || ': ' || v AS line FROM items""")
def report_rows_q(spark, sf):
    r = rollouts(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("a"))
    acc = r.select(F.lit(0).alias("ord"), F.concat("task", F.lit(" accuracy")).alias("key"), F.col("a").alias("dval"),
                   F.lit(None).cast("bigint").alias("ival"), F.lit(None).cast("string").alias("sval"))
    cnt = r.select(F.lit(1).alias("ord"), F.concat("task", F.lit(" samples")).alias("key"), F.lit(None).cast("double").alias("dval"),
                   F.col("n").alias("ival"), F.lit(None).cast("string").alias("sval"))
    empty = r.select(F.lit(2).alias("ord"), F.concat("task", F.lit(" notes")).alias("key"), F.lit(None).cast("double").alias("dval"),
                     F.lit(None).cast("bigint").alias("ival"), F.lit("").alias("sval"))  # falsy: skipped
    rows = IO.report_rows(acc.unionByName(cnt).unionByName(empty), "Chat evaluation")
    return rows.select("section", "slug", "line")


@register("src10_read_words", sql=r"""
SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents""")
def read_words_q(spark, sf):
    path = scratch(spark, "src10")
    words = C.words_from_text(table(spark, sf, "documents"))
    words.select(F.concat(F.lit("  "), "word", F.lit(" ")).alias("value")).write.text(path)  # padded lines
    return C.read_words(spark, path).distinct()


@register("src12_read_sweep_csv", sql="""
SELECT CAST(p_size AS DOUBLE) * 1e18 AS flops_budget, CAST(p_partkey % 20 + 4 AS INTEGER) AS depth,
       round(p_retailprice / 1000, 6) AS val_bpb
FROM part WHERE p_retailprice / 1000 > 0""")
def read_sweep_q(spark, sf):
    path = scratch(spark, "src12")
    p = table(spark, sf, "part")
    z = F.lit(0).cast("bigint")
    sweep = p.select((F.col("p_size").cast("double") * 1e18).alias("flops_budget"),
                     (F.col("p_partkey") % 20 + 4).cast("int").alias("depth"), ((F.col("p_partkey") % 20 + 4) * 64).cast("int").alias("model_dim"),
                     z.alias("params_wte"), z.alias("params_value_embeds"), z.alias("params_lm_head"), z.alias("params_transformer"),
                     z.alias("params_scalars"), z.alias("params_total"), z.alias("num_iterations"), z.alias("tokens_trained"),
                     F.round(F.col("p_retailprice") / 1000, 6).alias("val_bpb"), F.lit(None).cast("double").alias("core_score"),
                     z.alias("train_time_sec"))
    sweep.write.option("header", "true").csv(path)
    back = C.read_sweep_csv(spark, path)
    from tokenmill.operators.filters import complete_runs
    return complete_runs(back, "val_bpb").select("flops_budget", "depth", "val_bpb")


@register("src14_detokenize", sql="SELECT doc_id, md5(text) AS text_md5 FROM documents")
def detokenize_q(spark, sf):
    path = scratch(spark, "src14")
    TK.byte_encode(table(spark, sf, "documents"), out="tokens").select("doc_id", "tokens").write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("doc_id", F.md5(bytes_to_text("tokens")).alias("text_md5"))


@register("snk02_save_tokenizer", sql=f"""{BPE_SQL}
SELECT is_special, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, md5(string_agg(coalesce(token_hex, name), ',' ORDER BY token_id)) AS tokens_md5,
       (SELECT md5(string_agg(a || ' ' || b, ',' ORDER BY rank)) FROM merges) AS merges_md5 FROM vocab GROUP BY is_special""")
def save_tokenizer_q(spark, sf):
    from tokenmill.plans.q_tokenizer import train_corpus_bpe
    m = train_corpus_bpe(spark, sf)
    path = scratch(spark, "snk02")
    TK.save_tokenizer(spark, m, path)
    vocab, merges = (spark.read.parquet(f"{path}/{t}") for t in ("vocab", "merges"))
    joined = lambda rows: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), ","))
    of_merges = merges.agg(joined(F.struct("rank", F.concat_ws(" ", "left", "right").alias("t"))).alias("merges_md5"))  # vocabulary-sized
    out = vocab.groupBy("is_special").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"),
                                          joined(F.struct("token_id", F.coalesce("token_hex", "name").alias("t"))).alias("tokens_md5"))
    return out.withColumn("merges_md5", of_merges.scalar())
