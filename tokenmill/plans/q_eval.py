"""CORE-style evaluation queries on `benchmark` items scored by the bigram count model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_sql
from tokenmill.functions.text import strip_sql as text_strip_sql
from tokenmill.operators import evaluation as EV
from tokenmill.operators import scoring
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import CORPUS_SQL, byte_rows_sql, corpus_split, eval_items, eval_items_sql
from tokenmill.session import cut_lineage

K = 2             # shots
SHOT_SEED = 1234
DELIM = " "
CROP_DEMO = 256   # context used by the crop query


# ----------------------------------------------------------------------------- Spark side


def items(spark, sf):
    return eval_items(spark, sf)


_STORED: dict = {}


def _stored(spark, sf, name, make):
    """What ``make`` gives, stored in the checkpoint folder once for each session and path."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(make())
    return _STORED[key]


def shots(spark, sf):
    return _stored(spark, sf, "shots", lambda: EV.fewshot(items(spark, sf), K, seed=SHOT_SEED))


def model(spark, sf):
    # the pair-count table is small (splits x V^2 rows); storing it lets the
    # three model lookups (pair, context, argmax) share one corpus scan
    pc = _stored(spark, sf, "pairs", lambda: scoring.byte_pair_counts(corpus_split(spark, sf), ["split"]))
    m = scoring.bigram_model(pc, F.col("split") == "train")
    return m, scoring.argmax_table(m)


def mc_tokens(spark, sf, kind="mc"):
    it, sh = items(spark, sf), shots(spark, sf)
    p = EV.prompts_mc(it, sh, DELIM) if kind == "mc" else EV.prompts_schema(it, sh, DELIM)
    return EV.with_tokens(p)


def spans(spark, sf, kind="mc"):
    return EV.scored_spans(mc_tokens(spark, sf, kind), kind)


def lm_spans(spark, sf):
    return EV.spans_lm(EV.prompts_lm(items(spark, sf).withColumnRenamed("query", "context"), shots(spark, sf), DELIM))


def decide(spark, sf, kind):
    m, amax = model(spark, sf)
    if kind == "lm":
        s = lm_spans(spark, sf)
        return EV.decide_lm(EV.span_losses(s, m, amax, ["item_id"]), items(spark, sf))
    losses = EV.span_losses(spans(spark, sf, kind), m, amax, ["item_id", "choice"])
    options = F.posexplode("choices" if kind == "mc" else "context_options").alias("choice", "_o")
    choices = items(spark, sf).select("item_id", F.col("gold").cast("bigint").alias("gold"), options)
    return EV.decide_choice(losses, choices.withColumn("choice", F.col("choice").cast("bigint")))


def results(spark, sf):
    """Per-task accuracy of the three CORE-style tasks (one row per task, stored once per session)."""
    parts = lambda: [EV.accuracy(decide(spark, sf, k).withColumn("task", F.lit(k))) for k in ("mc", "schema", "lm")]
    return _stored(spark, sf, "results", lambda: reduce(lambda a, b: a.unionByName(b), parts()))


def baselines(spark, sf):
    """Random baseline in percent, derived from the item tables: 100 / #choices; 0 for LM."""
    it = items(spark, sf)
    b = it.select(F.lit("mc").alias("task"), (100.0 / F.size("choices")).alias("baseline")).unionByName(
        it.select(F.lit("schema").alias("task"), (100.0 / F.size("context_options")).alias("baseline"))).unionByName(
        it.select(F.lit("lm").alias("task"), F.lit(0.0).alias("baseline")))
    return b.groupBy("task").agg(F.max("baseline").alias("baseline"))


# ----------------------------------------------------------------------------- SQL side

ITEMS_SQL = eval_items_sql()
SHOTS_SQL = f"""{ITEMS_SQL},
sp AS (SELECT item_id, row_number() OVER (ORDER BY {hash_sql(SHOT_SEED, "item_id")}, item_id) - 1 AS p
       FROM eval_items),
sd AS (SELECT item_id, p, n, {hash_sql(f"{SHOT_SEED}/0", "item_id")} % greatest(n - 1, 1) AS d0,
              {hash_sql(f"{SHOT_SEED}/1", "item_id")} % greatest(n - 2, 1) AS r1 FROM sp, (SELECT count(*) AS n FROM sp)),
shots AS (
  SELECT a.item_id, CAST(a.r AS BIGINT) AS shot_rank, b.item_id AS shot_id
  FROM (SELECT item_id, p, n, unnest([1, 2]) AS r, unnest([d0, r1 + CAST(r1 >= d0 AS INTEGER)]) AS d FROM sd) a
  JOIN sp b ON b.p = (a.p + 1 + a.d) % a.n WHERE a.r < a.n)"""  # two shots (K)


def _prefix_sql(shot_expr: str) -> str:
    return f"""prefix AS (
  SELECT s.item_id, string_agg({shot_expr} || chr(10) || chr(10), '' ORDER BY s.shot_rank) AS prefix
  FROM shots s JOIN eval_items i ON i.item_id = s.shot_id GROUP BY s.item_id)"""


def strip_sql(x: str) -> str:
    return text_strip_sql(x)


PROMPTS_MC_SQL = f"""{SHOTS_SQL},
{_prefix_sql("i.query || ' ' || i.choices[i.gold + 1]")},
prompts AS (
  SELECT item_id, choice, gold, coalesce(prefix, '') || query || ' ' || c AS prompt
  FROM (SELECT item_id, gold, query, unnest(range(len(choices))) AS choice, unnest(choices) AS c FROM eval_items)
  LEFT JOIN prefix USING (item_id))"""

PROMPTS_SCHEMA_SQL = f"""{SHOTS_SQL},
{_prefix_sql("i.context_options[i.gold + 1] || ' ' || i.continuation")},
prompts AS (
  SELECT item_id, choice, gold, coalesce(prefix, '') || ctx || ' ' || continuation AS prompt
  FROM (SELECT item_id, gold, continuation, unnest(range(len(context_options))) AS choice,
               unnest(context_options) AS ctx FROM eval_items)
  LEFT JOIN prefix USING (item_id))"""

PROMPTS_LM_SQL = f"""{SHOTS_SQL},
{_prefix_sql(strip_sql("i.query") + " || ' ' || i.continuation")},
lm AS (
  SELECT item_id, {strip_sql("coalesce(prefix, '') || " + strip_sql("query") + " || ' '")} AS prompt_without,
         coalesce(prefix, '') || {strip_sql("query")} || ' ' || continuation AS prompt_with
  FROM eval_items LEFT JOIN prefix USING (item_id))"""


def tok_list(x: str) -> str:
    return (f"list_concat([256], list_transform(range(1, length(hex(encode({x}))) // 2 + 1), "
            f"lambda k: CAST(('0x' || substr(hex(encode({x})), 2 * k - 1, 2)) AS INTEGER)))")


def spans_sql(prompts_sql: str, side: str) -> str:
    rev = "list_reverse(t)" if side == "right" else "t"
    start = "cl" if side == "left" else "len(t) - cl"
    return f"""{prompts_sql},
toks AS (SELECT item_id, choice, gold, {tok_list("prompt")} AS t FROM prompts),
tpos AS (SELECT item_id, unnest(range(1, len(tt) + 1)) AS i, unnest(tt) AS tok
         FROM (SELECT item_id, {rev} AS tt FROM toks)),
diff AS (SELECT item_id, i FROM tpos GROUP BY item_id, i HAVING count(DISTINCT tok) > 1),
ml AS (SELECT item_id, min(len(t)) AS ml FROM toks GROUP BY item_id),
common AS (SELECT m.item_id, coalesce(min(d.i) FILTER (WHERE d.i <= m.ml) - 1, m.ml) AS cl
           FROM ml m LEFT JOIN diff d USING (item_id) GROUP BY m.item_id, m.ml),
spans AS (SELECT item_id, choice, gold, t, CAST({start} AS BIGINT) AS s_start, CAST(len(t) AS BIGINT) AS s_end
          FROM toks JOIN common USING (item_id))"""


def crop_sql(m: int) -> str:
    return f"""crop AS (
  SELECT item_id, choice, gold,
         CASE WHEN len(t) > {m} THEN t[len(t) - {m} + 1:] ELSE t END AS t,
         s_start - greatest(len(t) - {m}, 0) AS s_start, s_end - greatest(len(t) - {m}, 0) AS s_end
  FROM spans)"""


MODEL_SQL = f"""{CORPUS_SQL},
mtoks AS {byte_rows_sql("corpus_split", "doc_id, split")},
mpairs AS (SELECT split, coalesce(lag(tok) OVER (PARTITION BY doc_id ORDER BY i), 256) AS a, tok AS b FROM mtoks),
c_ab AS (SELECT a, b, count(*) AS c_ab FROM mpairs WHERE split = 'train' GROUP BY a, b),
c_a AS (SELECT a, sum(c_ab) AS c_a FROM c_ab GROUP BY a),
amax AS (SELECT a, first(b ORDER BY c_ab DESC, b) AS argmax_token FROM c_ab GROUP BY a)"""

SCORED_SQL = """lpos AS (SELECT item_id, choice, unnest(range(s_start, s_end)) AS i, t FROM crop),
lrows AS (SELECT item_id, choice, t[i] AS a, t[i + 1] AS b FROM lpos),
scored AS (
  SELECT l.item_id, l.choice, l.b, amax.argmax_token,
         -ln((coalesce(c_ab.c_ab, 0) + 1.0) / (coalesce(c_a.c_a, 0) + 256.0)) AS loss
  FROM lrows l LEFT JOIN c_ab USING (a, b) LEFT JOIN c_a USING (a) LEFT JOIN amax USING (a))"""


def decide_choice_sql(prompts_sql: str, side: str) -> str:
    return f"""{spans_sql(prompts_sql, side)}, crop AS (SELECT * FROM spans), {MODEL_SQL}, {SCORED_SQL},
mlo AS (SELECT p.item_id, p.choice, coalesce(round(avg(s.loss), 9), 'inf'::DOUBLE) AS mean_loss
        FROM prompts p LEFT JOIN scored s USING (item_id, choice) GROUP BY ALL),
pred AS (SELECT item_id, first(choice ORDER BY mean_loss, choice) AS pred FROM mlo GROUP BY item_id),
decided AS (SELECT p.item_id, CAST(p.pred AS BIGINT) AS pred, CAST(g.gold AS BIGINT) AS gold, p.pred = g.gold AS correct
            FROM pred p JOIN (SELECT DISTINCT item_id, gold FROM prompts) g USING (item_id))"""


LM_DECIDE_SQL = f"""{PROMPTS_LM_SQL},
spans AS (
  SELECT item_id, 0 AS choice, 0 AS gold, {tok_list("prompt_with")} AS t,
         CAST(len({tok_list("prompt_without")}) AS BIGINT) AS s_start,
         CAST(len({tok_list("prompt_with")}) AS BIGINT) AS s_end
  FROM lm),
crop AS (SELECT * FROM spans), {MODEL_SQL}, {SCORED_SQL},
lm_decided AS (SELECT item_id, coalesce(bool_and(coalesce(argmax_token = b, false)) FILTER (WHERE b IS NOT NULL), true) AS correct
               FROM lm LEFT JOIN scored USING (item_id) GROUP BY item_id)"""


def results_sql() -> str:
    mc = decide_choice_sql(PROMPTS_MC_SQL, "left")
    sc = decide_choice_sql(PROMPTS_SCHEMA_SQL, "right")
    lm = LM_DECIDE_SQL
    return f"""
WITH r_mc AS (WITH {mc} SELECT 'mc' AS task, CAST(count(*) AS BIGINT) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy FROM decided),
r_sc AS (WITH {sc} SELECT 'schema' AS task, CAST(count(*) AS BIGINT) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy FROM decided),
r_lm AS (WITH {lm} SELECT 'lm' AS task, CAST(count(*) AS BIGINT) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy FROM lm_decided),
results AS (SELECT * FROM r_mc UNION ALL SELECT * FROM r_sc UNION ALL SELECT * FROM r_lm),
baselines AS (SELECT 'mc' AS task, 25.0 AS baseline UNION ALL SELECT 'schema', 25.0 UNION ALL SELECT 'lm', 0.0),
centered AS (SELECT task, n, accuracy, baseline, (accuracy - 0.01 * baseline) / (1.0 - 0.01 * baseline) AS centered
             FROM results JOIN baselines USING (task))"""


# ----------------------------------------------------------------------------- registered queries


@register("jn02_fewshot", sql=f"WITH {SHOTS_SQL} SELECT item_id, shot_rank, shot_id FROM shots")
def fewshot_q(spark, sf):
    return shots(spark, sf)


@register("evl01_prompts_mc", sql=f"""
WITH {PROMPTS_MC_SQL}
SELECT item_id, CAST(choice AS BIGINT) AS choice, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len
FROM prompts""")
def prompts_mc_q(spark, sf):
    p = EV.prompts_mc(items(spark, sf), shots(spark, sf), DELIM)
    return p.select("item_id", "choice", F.md5("prompt").alias("prompt_md5"),
                    F.char_length("prompt").cast("bigint").alias("prompt_len"))


@register("evl02_prompts_schema", sql=f"""
WITH {PROMPTS_SCHEMA_SQL}
SELECT item_id, CAST(choice AS BIGINT) AS choice, md5(prompt) AS prompt_md5 FROM prompts""")
def prompts_schema_q(spark, sf):
    p = EV.prompts_schema(items(spark, sf), shots(spark, sf), DELIM)
    return p.select("item_id", "choice", F.md5("prompt").alias("prompt_md5"))


@register("evl03_prompts_lm", sql=f"""
WITH {PROMPTS_LM_SQL}
SELECT item_id, md5(prompt_without) AS without_md5, md5(prompt_with) AS with_md5 FROM lm""")
def prompts_lm_q(spark, sf):
    p = EV.prompts_lm(items(spark, sf).withColumnRenamed("query", "context"), shots(spark, sf), DELIM)
    return p.select("item_id", F.md5("prompt_without").alias("without_md5"), F.md5("prompt_with").alias("with_md5"))


@register("evl04_common_prefix_spans", sql=f"""
WITH {spans_sql(PROMPTS_MC_SQL, "left")}
SELECT item_id, CAST(choice AS BIGINT) AS choice, s_start AS start, s_end AS "end" FROM spans""")
def spans_mc_q(spark, sf):
    return spans(spark, sf, "mc").select("item_id", "choice", "start", "end")


@register("evl05_common_suffix_spans", sql=f"""
WITH {spans_sql(PROMPTS_SCHEMA_SQL, "right")}
SELECT item_id, CAST(choice AS BIGINT) AS choice, s_start AS start, s_end AS "end" FROM spans""")
def spans_schema_q(spark, sf):
    return spans(spark, sf, "schema").select("item_id", "choice", "start", "end")


@register("evl05_lm_spans", sql=f"""
WITH {PROMPTS_LM_SQL},
t AS (SELECT item_id, {tok_list("prompt_without")} AS tw, {tok_list("prompt_with")} AS t FROM lm)
SELECT item_id, CAST(len(tw) AS BIGINT) AS start, CAST(len(t) AS BIGINT) AS "end",
       len(tw) < len(t) AND t[1:len(tw)] = tw AS prefix_ok
FROM t""")
def spans_lm_q(spark, sf):
    return lm_spans(spark, sf).select("item_id", "start", "end", "prefix_ok")


@register("evl06_left_crop", sql=f"""
WITH {spans_sql(PROMPTS_MC_SQL, "left")}, {crop_sql(CROP_DEMO)}
SELECT item_id, CAST(choice AS BIGINT) AS choice, CAST(len(t) AS BIGINT) AS n_tokens,
       CAST(s_start AS BIGINT) AS start, CAST(s_end AS BIGINT) AS "end", md5(array_to_string(t, ',')) AS tokens_md5
FROM crop""")
def left_crop_q(spark, sf):
    c = EV.left_crop(spans(spark, sf, "mc"), CROP_DEMO)
    return c.select("item_id", "choice", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
                    F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("tokens_md5"))


@register("evl08_decide_mc", sql=f"WITH {decide_choice_sql(PROMPTS_MC_SQL, 'left')} SELECT * FROM decided")
def decide_mc_q(spark, sf):
    return decide(spark, sf, "mc").select("item_id", "pred", "gold", "correct")


@register("evl08_decide_schema", sql=f"WITH {decide_choice_sql(PROMPTS_SCHEMA_SQL, 'right')} SELECT * FROM decided")
def decide_schema_q(spark, sf):
    return decide(spark, sf, "schema").select("item_id", "pred", "gold", "correct")


@register("evl09_decide_lm", sql=f"WITH {LM_DECIDE_SQL} SELECT item_id, correct FROM lm_decided")
def decide_lm_q(spark, sf):
    return decide(spark, sf, "lm").select("item_id", "correct")


@register("agg02_accuracy", sql=results_sql() + " SELECT task, n, round(accuracy, 6) AS accuracy FROM results")
def accuracy_q(spark, sf):
    return results(spark, sf).select("task", F.col("n").cast("bigint").alias("n"),
                                     F.round("accuracy", 6).alias("accuracy"))


@register("jn01_join_baselines", sql=results_sql() + " SELECT task, round(accuracy, 6) AS accuracy, baseline FROM centered")
def join_baselines_q(spark, sf):
    j = EV.join_baselines(results(spark, sf), baselines(spark, sf))
    return j.select("task", F.round("accuracy", 6).alias("accuracy"), "baseline")


@register("agg03_centered", sql=results_sql() + " SELECT task, round(centered, 6) AS centered FROM centered")
def centered_q(spark, sf):
    j = EV.join_baselines(results(spark, sf), baselines(spark, sf))
    return j.select("task", F.round(EV.centered(F.col("accuracy"), F.col("baseline")), 6).alias("centered"))


@register("agg04_core_metric", sql=results_sql() + " SELECT round(avg(centered), 6) AS core FROM centered")
def core_q(spark, sf):
    j = EV.join_baselines(results(spark, sf), baselines(spark, sf))
    c = j.withColumn("centered", EV.centered(F.col("accuracy"), F.col("baseline")))
    return EV.core_metric(c).select(F.round("core", 6).alias("core"))
