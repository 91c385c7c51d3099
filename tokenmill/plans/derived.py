"""Stand-ins derived from the given tables (Spark form and SQL form side by side).

Every registered query reads the driver's tables; these functions map them on
the reference's inputs (FIXTURES.md part B). Each Spark builder has an SQL twin
written as a CTE so the DuckDB oracle starts from the identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_key, hash_sql
from tokenmill.functions.text import first_half, second_half
from tokenmill.session import cut_lineage, spread, table
from tokenmill.sources.corpus import corpus_layout, with_split

# virtual corpus layout of `documents`: 16 rows per row group, 4 row groups per shard
RG_ROWS, RG_PER_SHARD = 16, 4


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_layout(spread(table(spark, sf, "documents")), "doc_id", RG_ROWS, RG_PER_SHARD)


def corpus_split(spark: SparkSession, sf: str) -> DataFrame:
    return with_split(corpus(spark, sf))


CORPUS_SQL = f"""corpus AS (
  SELECT doc_id, text, lang, source, n_chars, doc_id AS pos,
         CAST(doc_id // {RG_ROWS * RG_PER_SHARD} AS INTEGER) AS shard_idx,
         CAST((doc_id % {RG_ROWS * RG_PER_SHARD}) // {RG_ROWS} AS INTEGER) AS rg_idx,
         CAST(doc_id % {RG_ROWS} AS INTEGER) AS row_in_rg
  FROM documents),
corpus_split AS (
  SELECT *, CASE WHEN shard_idx = (SELECT max(shard_idx) FROM corpus) THEN 'val' ELSE 'train' END AS split
  FROM corpus)"""


# byte tokens of a text column in SQL: one row per byte, i = 1-based byte position
def byte_rows_sql(src: str, keys: str, text: str = "text") -> str:
    return f"""(SELECT {keys}, i, CAST(('0x' || substr(h, 2 * i - 1, 2)) AS INTEGER) AS tok
   FROM (SELECT {keys}, h, unnest(range(1, CAST(length(h) // 2 AS BIGINT) + 1)) AS i
         FROM (SELECT {keys}, hex(encode({text})) AS h FROM {src})))"""


# ---------------------------------------------------------------- training logs from `events`
# run = user_id; step = 0-based order by (ts, event_id) inside the run; metric = value.

def run_steps(spark: SparkSession, sf: str) -> DataFrame:
    # alias first, then window on `run`: later per-run windows reuse this partitioning (no second shuffle)
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_type",
                                           F.col("value").alias("metric"), "event_id")
    w = Window.partitionBy("run").orderBy("ts", "event_id")
    return ev.select("run", (F.row_number().over(w) - 1).cast("bigint").alias("step"),
                     "ts", "event_type", "metric", "event_id")


RUN_STEPS_SQL = """run_steps AS (
  SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
         ts, event_type, value AS metric, event_id
  FROM events)"""


# ---------------------------------------------------------------- rollouts from `lineitem`
# problem = l_orderkey; sample = 0-based row order over all columns; correct = returnflag 'R'.
# chat task names (fixed values of the ChatCORE definition)
CHAT_TASKS = ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "SpellingBee"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return li.select(F.col("l_orderkey").alias("problem"), (F.row_number().over(w) - 1).cast("bigint").alias("sample"),
                     (F.col("l_returnflag") == "R").alias("correct"),
                     F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
                     F.col("l_quantity").cast("bigint").alias("seq_len"),
                     F.col("l_discount").alias("logp"),
                     F.year("l_shipdate").cast("bigint").alias("step"),
                     F.when(F.col("l_linestatus") == "O", -1).otherwise(F.col("l_linenumber")).cast("bigint").alias("target"),
                     F.col("l_linestatus").alias("subject"),
                     F.element_at(F.array(*[F.lit(t) for t in CHAT_TASKS]), (F.col("l_orderkey") % 6 + 1).cast("int"))
                     .alias("task"))


ROLLOUTS_SQL = f"""rollouts AS (
  SELECT l_orderkey AS problem,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS BIGINT) AS sample,
         (l_returnflag = 'R') AS correct, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS reward,
         CAST(l_quantity AS BIGINT) AS seq_len, l_discount AS logp, CAST(year(l_shipdate) AS BIGINT) AS step,
         CAST(CASE WHEN l_linestatus = 'O' THEN -1 ELSE l_linenumber END AS BIGINT) AS target,
         l_linestatus AS subject, {CHAT_TASKS!r}[l_orderkey % 6 + 1] AS task
  FROM lineitem)"""


# ---------------------------------------------------------------- CORE-style items from `benchmark`
# query/context = first half of the words, gold continuation = second half;
# distractors = continuations of the next three items in a seeded permutation.
ITEM_SEED = 7
ITEM_BUCKETS = 64  # range buckets of the item permutation (items are uniform 60-bit hashes)


def bench_items(spark: SparkSession, sf: str) -> DataFrame:
    from tokenmill.operators.ordering import hash_bucket, with_index
    b = table(spark, sf, "benchmark")
    b = b.select("item_id", first_half("text").alias("query"), second_half("text").alias("continuation"),
                 hash_key(ITEM_SEED, "item_id").alias("h"))
    return with_index(b, ["h", "item_id"], name="perm", bucket=hash_bucket("h", ITEM_BUCKETS),
                      n_buckets=ITEM_BUCKETS).drop("h")


BENCH_ITEMS_SQL = f"""bench_items AS (
  SELECT item_id, query, continuation,
         CAST(row_number() OVER (ORDER BY h, item_id) - 1 AS BIGINT) AS perm
  FROM (SELECT item_id,
               array_to_string(w[1:greatest(CAST(floor(len(w) / 2) AS INTEGER), 1)], ' ') AS query,
               array_to_string(w[greatest(CAST(floor(len(w) / 2) AS INTEGER), 1) + 1:], ' ') AS continuation,
               {hash_sql(ITEM_SEED, "item_id")} AS h
        FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)))"""


_ITEMS: dict[tuple, DataFrame] = {}


def eval_items(spark: SparkSession, sf: str, n_choices: int = 4) -> DataFrame:
    """The item table, stored once for each session, path and size: every stage of the evaluation reads it."""
    key = (spark.sparkContext.applicationId, sf, n_choices)
    if key not in _ITEMS:
        _ITEMS[key] = cut_lineage(_eval_items(spark, sf, n_choices))
    return _ITEMS[key]


def _eval_items(spark: SparkSession, sf: str, n_choices: int) -> DataFrame:
    """(item_id, perm, query, continuation, gold, choices, context_options).

    Distractors are the items at the next ``n_choices - 1`` permutation
    positions (equi-join on position, no pairs); the gold answer is inserted
    at a hashed position.
    """
    it = bench_items(spark, sf)
    n = it.agg(F.count(F.lit(1))).scalar()  # scalar subquery: number of items
    offs = it.select("item_id", "perm", F.explode(F.sequence(F.lit(1), F.lit(n_choices - 1))).alias("k"))
    offs = offs.withColumn("dperm", (F.col("perm") + F.col("k")) % n)
    d = offs.join(it.select(F.col("perm").alias("dperm"), F.col("query").alias("dq"),
                            F.col("continuation").alias("dc")), "dperm")
    dist = d.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "dq", "dc"))).alias("ds"))
    j = it.join(dist, "item_id").withColumn("gold", (hash_key(ITEM_SEED + 1, "item_id") % n_choices).cast("int"))

    def insert(own: str, field: str):
        ds = F.transform("ds", lambda s: s[field])
        return F.concat(F.slice(ds, 1, F.col("gold")), F.array(own), F.slice(ds, F.col("gold") + 1, n_choices))

    return j.select("item_id", "perm", "query", "continuation", "gold",
                    insert("continuation", "dc").alias("choices"),
                    insert("query", "dq").alias("context_options"))


def mc_items(spark: SparkSession, sf: str, n_choices: int = 4) -> DataFrame:
    return eval_items(spark, sf, n_choices)


def eval_items_sql(n_choices: int = 4) -> str:
    return BENCH_ITEMS_SQL + f""",
ev_dist AS (
  SELECT a.item_id, list(b.continuation ORDER BY k) AS dc, list(b.query ORDER BY k) AS dq
  FROM (SELECT item_id, perm, unnest(range(1, {n_choices})) AS k FROM bench_items) a
  JOIN bench_items b ON b.perm = (a.perm + a.k) % (SELECT count(*) FROM bench_items)
  GROUP BY a.item_id),
eval_items AS (
  SELECT i.item_id, i.perm, i.query, i.continuation, g.gold,
         list_concat(list_concat(d.dc[1:g.gold], [i.continuation]), d.dc[g.gold + 1:]) AS choices,
         list_concat(list_concat(d.dq[1:g.gold], [i.query]), d.dq[g.gold + 1:]) AS context_options
  FROM bench_items i JOIN ev_dist d USING (item_id)
  JOIN (SELECT item_id, CAST({hash_sql(ITEM_SEED + 1, "item_id")} % {n_choices} AS INTEGER) AS gold
        FROM bench_items) g USING (item_id))"""
