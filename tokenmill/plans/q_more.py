"""Remaining inventory: token scores and bpb on conversations, decisions, sampling, joins, run audit,
shard ETA, batch padding, top-k, eval bundle, run catalog, task registry, tokenizer protocol, UDTF."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_sql
from tokenmill.operators import conversation as CV
from tokenmill.operators import evaluation as EV
from tokenmill.operators import joins as JN
from tokenmill.operators import packing as P
from tokenmill.operators import scoring
from tokenmill.operators import tasks as TS
from tokenmill.operators import tokenizer as TK
from tokenmill.operators.ordering import topk
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import RUN_STEPS_SQL, eval_items, eval_items_sql, run_steps
from tokenmill.plans.q_conversation import MSG_SQL, chat_ok
from tokenmill.plans.q_eval import MODEL_SQL, model
from tokenmill.plans.q_io import WHOLE_RESHARD_SQL, _plan
from tokenmill.plans.q_logs import CLASSIFY_SQL, RUN_LOG_SQL, TAG_SQL, run_log, tags
from tokenmill.plans.q_packing import PLAN_SQL
from tokenmill.plans.q_tasks import ANSWER_SQL, MATH_SQL, PARTS_SQL, math_rows
from tokenmill.plans.q_tokenizer import BPE_SQL
from tokenmill.session import table
from tokenmill.streaming.jobs import scratch

RENDER_SQL = f"""{MSG_SQL},
r AS (SELECT conv_id, list_concat([256], flatten(list(ids ORDER BY i))) AS ids,
             list_concat([0], flatten(list(mask ORDER BY i))) AS mask
      FROM mids GROUP BY conv_id)"""


# ----------------------------------------------------------------------------- token scores


@register("evl07_align_next", sql=f"""
WITH {RENDER_SQL}, t AS (SELECT conv_id, CAST(unnest(range(0, len(ids))) AS BIGINT) AS pos, unnest(ids) AS token FROM r)
SELECT conv_id AS seq_id, pos, token, lead(token) OVER (PARTITION BY conv_id ORDER BY pos) AS target FROM t""")
def align_next_q(spark, sf):
    r = CV.render(chat_ok(spark, sf), max_tokens=None).select(F.col("conv_id").alias("seq_id"), F.posexplode("ids").alias("pos", "token"))
    return scoring.align_next(r.withColumn("pos", F.col("pos").cast("bigint"))).select("seq_id", "pos", "token", "target")


@register("agg01_bpb_conversations", sql=f"""
WITH {RENDER_SQL}, {MODEL_SQL},
pr AS (SELECT ids[p] AS a, ids[p + 1] AS b, mask[p + 1] AS m FROM (SELECT ids, mask, unnest(range(1, len(ids))) AS p FROM r)),
v AS (SELECT a, b FROM pr WHERE m = 1 AND b < 256),
s AS (SELECT -ln((coalesce(c_ab.c_ab, 0) + 1.0) / (coalesce(c_a.c_a, 0) + 256.0)) AS loss
      FROM v LEFT JOIN c_ab USING (a, b) LEFT JOIN c_a USING (a))
SELECT CAST(count(*) AS BIGINT) AS n_targets, CAST(count(*) AS BIGINT) AS n_bytes, round(sum(loss) / (ln(2) * count(*)), 6) AS bpb
FROM s""")
def bpb_conversations_q(spark, sf):
    """SFT-style validation bpb: masked targets ignored (FLT-14), token bytes joined (JN-03), AGG-01."""
    r = CV.render(chat_ok(spark, sf), max_tokens=None).withColumn("tg", CV.targets_from_mask("ids", "mask"))
    e = r.select(F.posexplode("tg").alias("p", "target"), "ids")
    e = e.select(F.element_at("ids", F.col("p") + 1).alias("a"), "target")
    tb = TK.token_bytes_table(TK.byte_vocab(spark), mode="raw")
    v = scoring.valid_targets(e, tb).withColumnRenamed("target", "b")
    (m, _) = model(spark, sf)
    return scoring.bits_per_byte(scoring.score_pairs(v, m), [])


LETTER_IDS = {l: ord(l) for l in CV.LETTERS}


@register("evl10_decide_letter", sql=f"""
WITH {eval_items_sql()}, {MODEL_SQL},
last AS (SELECT item_id, gold, CAST(('0x' || right(hex(encode(query)), 2)) AS INTEGER) AS a FROM eval_items),
sc AS (SELECT l.item_id, l.gold, x.letter, x.token,
              ln((coalesce(c_ab.c_ab, 0) + 1.0) / (coalesce(c_a.c_a, 0) + 256.0)) AS logit
       FROM last l CROSS JOIN (VALUES ('A', 65), ('B', 66), ('C', 67), ('D', 68)) x(letter, token)
       LEFT JOIN c_ab ON c_ab.a = l.a AND c_ab.b = x.token LEFT JOIN c_a ON c_a.a = l.a)
SELECT item_id, first(letter ORDER BY round(logit, 9) DESC, token) AS pred,
       first(letter ORDER BY round(logit, 9) DESC, token) = ['A', 'B', 'C', 'D'][any_value(gold) + 1] AS correct
FROM sc GROUP BY item_id""")
def decide_letter_q(spark, sf):
    """Letter scores at the answer position (context = last byte of the question)."""
    it = eval_items(spark, sf)
    last = it.select("item_id", "gold", F.element_at(TK.byte_ids("query"), -1).alias("a"))
    letters = last.select("item_id", F.explode(F.array(*[F.struct(F.lit(l).alias("letter"), F.lit(t).alias("token"))
                                                         for l, t in LETTER_IDS.items()])).alias("x"), "a")
    pairs = letters.select("item_id", "x.letter", F.col("x.token").alias("b"), "a")
    (m, _) = model(spark, sf)
    sc = scoring.score_pairs(pairs, m).select("item_id", "letter", F.col("b").alias("token"),
                                              F.round(-F.col("loss"), 9).alias("logit"))
    pred = EV.decide_letter(sc, sc.select("item_id", "token"))
    gold = it.select("item_id", F.element_at(F.array(*[F.lit(l) for l in CV.LETTERS]), F.col("gold") + 1).alias("gold"))
    g = JN.grade_choice(pred, gold, domain=None)
    return g.select("item_id", "pred", "correct")


@register("jn04_grade_choice", sql=f"""
WITH {eval_items_sql()}
SELECT item_id, ['A', 'B', 'C', 'D'][(gold + item_id % 2) % 4 + 1] AS pred, ['A', 'B', 'C', 'D'][gold + 1] AS gold,
       item_id % 2 = 0 AND item_id % 5 <> 0 AS correct
FROM eval_items""")
def grade_choice_q(spark, sf):
    """Predictions (derived) joined with gold; items with id % 5 = 0 carry a reduced answer domain."""
    it = eval_items(spark, sf)
    letters = F.array(*[F.lit(l) for l in CV.LETTERS])
    pred = it.select("item_id", F.element_at(letters, ((F.col("gold") + F.col("item_id") % 2) % 4 + 1).cast("int")).alias("pred"))
    gold = it.select("item_id", F.element_at(letters, F.col("gold") + 1).alias("gold"),
                     F.when(F.col("item_id") % 5 == 0, F.array(F.lit("E"))).otherwise(letters).alias("domain"))
    return JN.grade_choice(pred, gold, domain="domain").select("item_id", "pred", "gold", "correct")


@register("evl12_topk_softmax", sql=f"""
WITH {MODEL_SQL},
lg AS (SELECT c_ab.a, b AS token, ln((c_ab.c_ab + 1.0) / (c_a.c_a + 256.0)) AS logit FROM c_ab JOIN c_a USING (a)),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY logit DESC, token) AS rk FROM lg),
k AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY a)) / 0.8) AS e FROM r WHERE rk <= 5),
k2 AS (SELECT *, e / sum(e) OVER (PARTITION BY a) AS pr FROM k),
p AS (SELECT *, sum(pr) OVER (PARTITION BY a ORDER BY logit DESC, token
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
             ({hash_sql(7, "a")}) / {float(1 << 60)} AS u
      FROM k2)
SELECT a, first(token ORDER BY rk) AS sampled FROM p WHERE c >= u GROUP BY a""")
def topk_softmax_q(spark, sf):
    c_ab, c_a = model(spark, sf)[0]
    lg = c_ab.join(c_a, "a").select("a", F.col("b").alias("token"),
                                    F.log((F.col("c_ab") + 1.0) / (F.col("c_a") + 256.0)).alias("logit"))
    return EV.topk_softmax(lg, ["a"], k=5, temperature=0.8, seed=7)


@register("evl13_trim_completions", sql=f"""
WITH {RENDER_SQL},
c AS (SELECT conv_id, ids[list_position(ids, 259) + 1:] AS gen FROM r WHERE list_position(ids, 259) IS NOT NULL),
t AS (SELECT conv_id, gen, list_position(list_transform(gen, lambda x: x IN (260, 256)), true) AS stop FROM c)
SELECT conv_id, CAST(len(CASE WHEN stop IS NULL THEN gen ELSE gen[1:stop - 1] END) AS BIGINT) AS n_completion
FROM t""")
def trim_completions_q(spark, sf):
    r = CV.render(chat_ok(spark, sf), max_tokens=None)
    start = F.array_position("ids", 259)
    c = r.where(start > 0).select("conv_id", F.slice("ids", (start + 1).cast("int"), F.size("ids")).alias("gen"))
    t = EV.trim_completions(c, "gen", [260, 256])
    return t.select("conv_id", F.size("completion").cast("bigint").alias("n_completion"))


# ----------------------------------------------------------------------------- joins and run audit


def patterns(spark, sf):
    p = table(spark, sf, "part").select(F.split("p_type", " ").alias("w"), "p_retailprice").where(F.size("w") >= 3)
    pairs = p.groupBy(F.array(F.element_at("w", 1), F.element_at("w", 3)).alias("substrings")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("value"))
    singles = p.groupBy(F.array(F.element_at("w", 3)).alias("substrings")).agg(F.round(F.max("p_retailprice"), 4).alias("value"))
    rules = pairs.withColumn("g", F.lit(0)).unionByName(singles.withColumn("g", F.lit(1)))
    return rules.withColumn("priority", F.dense_rank().over(Window.orderBy("g", F.array_join("substrings", " "))))


@register("jn05_first_match", sql="""
WITH p AS (SELECT string_split(p_type, ' ') AS w, p_retailprice FROM part WHERE len(string_split(p_type, ' ')) >= 3),
rules AS (SELECT [w[1], w[3]] AS subs, round(avg(p_retailprice), 4) AS value, 0 AS g FROM p GROUP BY 1
          UNION ALL SELECT [w[3]], round(max(p_retailprice), 4), 1 FROM p GROUP BY 1),
pr AS (SELECT *, dense_rank() OVER (ORDER BY g, array_to_string(subs, ' ')) AS priority FROM rules),
t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS txt FROM part),
hits AS (SELECT id, arg_min(value, priority) AS value FROM t, pr
         WHERE len(list_filter(subs, lambda s: NOT contains(txt, lower(s)))) = 0 GROUP BY id)
SELECT t.id, coalesce(hits.value, 'inf'::DOUBLE) AS value FROM t LEFT JOIN hits USING (id)""")
def first_match_q(spark, sf):
    """Ordered substring rules (derived from part types) applied to part descriptions; default = infinity."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("txt"))
    rules = patterns(spark, sf)
    return JN.first_match(t, "txt", rules, float("inf")).select("id", "value")


ARTIFACTS = ["model_*.pt", "meta_*.json", "report.md"]


def present_files(spark, sf):
    s = run_steps(spark, sf)
    name = (F.when(F.col("event_type") == "purchase", F.format_string("model_%06d.pt", "step"))
             .when(F.col("event_type") == "signup", F.format_string("meta_%06d.json", "step")))
    return s.select("run", name.alias("name")).where(F.col("name").isNotNull())


def expected_files(spark, sf):
    runs = run_steps(spark, sf).select("run").distinct()
    return runs.select("run", F.explode(F.array(*[F.lit(a) for a in ARTIFACTS])).alias("pattern"))


PRESENT_SQL = f"""{RUN_STEPS_SQL},
present AS (SELECT run, CASE event_type WHEN 'purchase' THEN printf('model_%06d.pt', step)
                                        WHEN 'signup' THEN printf('meta_%06d.json', step) END AS name
            FROM run_steps WHERE event_type IN ('purchase', 'signup')),
expected AS (SELECT DISTINCT run, unnest({ARTIFACTS!r}) AS pattern FROM run_steps),
missing AS (SELECT e.run, e.pattern FROM expected e
            WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.run = e.run
              AND regexp_matches(p.name, '^' || replace(replace(replace(e.pattern, '.', '\\.'), '*', '.*'), '?', '.') || '$')))"""


@register("jn07_missing_artifacts", sql=f"WITH {PRESENT_SQL} SELECT run, pattern FROM missing")
def missing_artifacts_q(spark, sf):
    return JN.missing_artifacts(expected_files(spark, sf), present_files(spark, sf)).select("run", "pattern")


@register("log12_verify_runs", sql=f"""
WITH {PRESENT_SQL}, {RUN_LOG_SQL.replace(RUN_STEPS_SQL + ",", "")}, {CLASSIFY_SQL},
stops AS (SELECT run, arg_min(kind, line_no) AS kind FROM classified WHERE kind IS NOT NULL AND run % 3 = 0 GROUP BY run),
mis AS (SELECT run, array_to_string(list_sort(list(pattern)), ',') AS m FROM missing WHERE run % 5 = 0 GROUP BY run),
runs AS (SELECT run, max(step) AS final_step, arg_max(event_type, step) AS last_event FROM run_steps GROUP BY run),
logs AS (SELECT run, count(*) AS n FROM run_log WHERE run % 13 <> 5 GROUP BY run),
j AS (SELECT runs.run,
        CASE WHEN last_event = 'view' AND runs.run % 2 = 0 THEN 'state:running' WHEN mis.m IS NOT NULL THEN 'missing:' || mis.m WHEN logs.n IS NULL THEN 'no_log'
             WHEN stops.kind IS NOT NULL THEN 'stop:' || stops.kind WHEN runs.run % 17 = 2 THEN 'critical:meta,optim' WHEN final_step % 23 = 6 THEN 'nonfinite_metadata'
             WHEN final_step % 19 = 4 THEN 'metadata_step' WHEN runs.run % 7 = 1 THEN 'no_cursor' END AS reason
      FROM runs LEFT JOIN stops USING (run) LEFT JOIN mis USING (run) LEFT JOIN logs USING (run))
SELECT run, CASE WHEN reason IS NULL THEN 'pass' ELSE 'fail' END AS status, reason FROM j""")
def verify_runs_q(spark, sf):
    """Runs of the event log with launcher, artefact and metadata facts derived from their steps and ids."""
    from tokenmill.operators import runlogs as RL
    steps, log = run_steps(spark, sf), run_log(spark, sf)
    runs = steps.groupBy("run").agg(F.max("step").alias("final_step"), F.max_by("event_type", "step").alias("_event"))
    lines = log.where(F.col("run") % 13 != 5).groupBy("run").agg(F.count(F.lit(1)).alias("log_lines"))
    running = (F.col("_event") == "view") & (F.col("run") % 2 == 0)
    facts = runs.join(lines, "run", "left").select(
        "run", "final_step", "log_lines", F.when(running, "running").otherwise("complete").alias("state"),
        F.when(F.col("run") % 17 == 2, F.array(F.lit("model"))).otherwise(F.array(F.lit("model"), F.lit("meta"), F.lit("optim"))).alias("critical"),
        (F.col("final_step") % 23 == 6).alias("meta_nonfinite"), (F.col("final_step") - (F.col("final_step") % 19 == 4).cast("int")).alias("meta_step"),
        (F.col("run") % 7 != 1).alias("has_cursor"))
    missing = JN.missing_artifacts(expected_files(spark, sf), present_files(spark, sf)).where(F.col("run") % 5 == 0)
    return JN.verify_runs(facts, RL.first_stop(log.where(F.col("run") % 3 == 0)), missing)


@register("win11_shard_eta", sql=f"""{WHOLE_RESHARD_SQL},
s AS (SELECT shard_idx, sum(n) AS chars FROM plan GROUP BY shard_idx),
tt AS (SELECT shard_idx, sum(chars) OVER (ORDER BY shard_idx) / 100000.0 AS ts FROM s),
ee AS (SELECT shard_idx, ts - lag(ts) OVER (ORDER BY shard_idx) AS elapsed FROM tt),
aa AS (SELECT shard_idx, elapsed, avg(elapsed) OVER (ORDER BY shard_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av
       FROM ee)
SELECT shard_idx, round(elapsed, 6) AS elapsed, round(av * ((SELECT count(*) FROM s) - shard_idx - 1), 6) AS eta FROM aa""")
def shard_eta_q(spark, sf):
    """Per-shard write time modelled as chars / 1e5 s; running-mean ETA over the remaining shards."""
    from tokenmill.operators.ordering import prefix_sum
    from tokenmill.operators.stats import shard_eta
    plan = _plan(spark, sf, drop_tail=False).join(table(spark, sf, "documents").select("doc_id", F.char_length("text").alias("n")), "doc_id")
    s = plan.groupBy("shard_idx").agg(F.sum("n").alias("chars"))
    n = s.agg(F.count(F.lit(1))).first()[0]
    s = prefix_sum(s, "chars", ["shard_idx"], name="so_far", bucket=F.floor(F.col("shard_idx") / 4096))
    t = s.withColumn("ts", F.col("so_far") / 100000.0)
    e = shard_eta(t, total_shards=n)
    return e.select("shard_idx", F.round("elapsed", 6).alias("elapsed"), F.round("eta", 6).alias("eta"))


PARTS_RENDER_SQL = f"""{MATH_SQL}, {PARTS_SQL},
pt AS (SELECT problem, sample, i, parts[i].type AS type, hex(encode(parts[i].text)) AS h FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parts)),
pb AS (SELECT *, list_transform(range(1, length(h) // 2 + 1), lambda k: CAST(('0x' || substr(h, 2 * k - 1, 2)) AS INTEGER)) AS b FROM pt),
pe AS (SELECT problem, sample, i,
         CASE type WHEN 'python' THEN list_concat(list_concat([261], b), [262]) WHEN 'python_output' THEN list_concat(list_concat([263], b), [264]) ELSE b END AS ids,
         CASE type WHEN 'python_output' THEN list_transform(range(len(b) + 2), lambda x: 0) WHEN 'python' THEN list_transform(range(len(b) + 2), lambda x: 1)
                   ELSE list_transform(b, lambda x: 1) END AS mask FROM pb),
rp AS (SELECT problem, sample, list_concat(list_concat([256, 257, 63, 258, 259], flatten(list(ids ORDER BY i))), [260]) AS ids,
              list_concat(list_concat([0, 0, 0, 0, 0], flatten(list(mask ORDER BY i))), [1]) AS mask FROM pe GROUP BY problem, sample)"""


@register("cnv03_render_parts", sql=f"""
WITH {PARTS_RENDER_SQL}
SELECT problem, sample, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(mask, ',')) AS mask_md5 FROM rp""")
def render_parts_q(spark, sf):
    """Worked answers with their calculator calls as assistant parts: special tokens and loss mask of each kind of part."""
    none = F.lit(None).cast("array<struct<type:string,text:string>>")

    def msg(turn, role, text, parts):
        return F.struct(F.lit(turn).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"), parts.alias("parts"))

    m = math_rows(spark, sf).select("problem", "sample", F.array(msg(0, "user", "?", none), msg(1, "assistant", "", CV.parse_tool_calls("answer"))).alias("messages"))
    r = CV.render(m, max_tokens=None)
    md5 = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return r.select("problem", "sample", md5("ids").alias("ids_md5"), md5("mask").alias("mask_md5"))


@register("pck09_pad_batch", sql=f"""
WITH {RENDER_SQL}
SELECT conv_id, CAST(max(len(ids)) OVER (PARTITION BY conv_id // 8) AS BIGINT) AS batch_len,
       CAST(max(len(ids)) OVER (PARTITION BY conv_id // 8) - len(ids) AS BIGINT) AS n_pad FROM r""")
def pad_batch_q(spark, sf):
    r = CV.render(chat_ok(spark, sf), max_tokens=None).withColumn("batch", (F.col("conv_id") / 8).cast("bigint"))
    p = P.pad_batch(r, ["batch"], pad_id=256)
    return p.select("conv_id", F.col("batch_len").cast("bigint").alias("batch_len"),
                    (F.size("padded") - F.size("ids")).cast("bigint").alias("n_pad"))


@register("srt04_topk_per_group", sql="""
SELECT p_brand, p_partkey, CAST(rk AS BIGINT) AS rank FROM (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part)
WHERE rk <= 3""")
def topk_q(spark, sf):
    p = table(spark, sf, "part")
    return topk(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


# ----------------------------------------------------------------------------- eval bundle, run catalog


@register("src09_read_eval_bundle", sql=f"""
WITH {eval_items_sql()}
SELECT t.label, t.icl_task_type, CAST(t.num_fewshot AS BIGINT) AS num_fewshot, CAST(t.n AS BIGINT) AS n_items,
       t.baseline
FROM (SELECT 'bench_mc' AS label, 'multiple_choice' AS icl_task_type, 2 AS num_fewshot, count(*) AS n,
             100.0 / max(len(choices)) AS baseline FROM eval_items
      UNION ALL SELECT 'bench_lm', 'language_modeling', 0, count(*), 0.0 FROM eval_items) t""")
def eval_bundle_q(spark, sf):
    """Write a bundle (YAML task list, JSONL items, baseline CSV) derived from `benchmark`, read it back."""
    from tokenmill.sources.bundle import read_eval_bundle, write_eval_bundle
    root = scratch(spark, "src09")
    write_eval_bundle(spark, eval_items(spark, sf), root)
    tasks, items, baselines = read_eval_bundle(spark, root)
    n = items.groupBy("label").agg(F.count(F.lit(1)).alias("n_items"))
    return tasks.join(n, "label").join(baselines, "label").select(
        "label", "icl_task_type", F.col("num_fewshot").cast("bigint").alias("num_fewshot"),
        F.col("n_items").cast("bigint").alias("n_items"), "baseline")


@register("src16_checkpoint_names", sql=f"""
WITH {RUN_STEPS_SQL}, t AS (SELECT run, step, {TAG_SQL} AS tag FROM run_steps WHERE step % 100 = 0)
SELECT tag, CAST(regexp_extract(tag, '^d(\\d+)', 1) AS INTEGER) AS depth, max(step) AS last_step, count(*) AS n_checkpoints FROM t GROUP BY tag""")
def checkpoint_names_q(spark, sf):
    """A listing of checkpoint files (every 100 steps of a run; model files beside them) read by their names."""
    from tokenmill.sources.io import latest_checkpoints
    t = run_steps(spark, sf).where(F.col("step") % 100 == 0).join(tags(spark, sf).select("run", "tag"), "run")
    name = F.explode(F.array(F.format_string("runs/%s/meta_%06d.json", "tag", "step"), F.format_string("runs/%s/model_%06d.pt", "tag", "step")))
    return latest_checkpoints(t.select(name.alias("path")))


@register("src16_scan_runs", sql=f"""
WITH {RUN_STEPS_SQL}, t AS (SELECT run, {TAG_SQL} AS tag, max(step) AS step FROM run_steps GROUP BY run)
SELECT tag, CAST(max(step) AS BIGINT) AS last_step, CAST(count(*) AS BIGINT) AS n_runs FROM t GROUP BY tag""")
def scan_runs_q(spark, sf):
    """Checkpoint metadata written as a tag-partitioned JSON catalog and scanned back."""
    from tokenmill.sources.io import scan_runs
    root = scratch(spark, "src16")
    meta = tags(spark, sf).select("tag", F.col("last_step").alias("step"), "run",
                                  F.struct((F.col("run") % 20 + 4).alias("depth")).alias("model_config"))
    meta.write.partitionBy("tag").json(root)
    cat = scan_runs(spark, root)
    return cat.groupBy("tag").agg(F.max("step").cast("bigint").alias("last_step"), F.count(F.lit(1)).alias("n_runs"))


# ----------------------------------------------------------------------------- user-defined surface


@TS.register_task("math")
def math_task(spark, sf):
    m = math_rows(spark, sf).withColumn("key", F.concat_ws("-", "problem", "sample"))
    return TS.Task("math", m, "key", grade=lambda ref, resp: EV.grade_numeric(CV.extract_answer(ref), CV.extract_answer(resp)))


@register("udf01_task_registry", sql=f"""
WITH {MATH_SQL}
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN ({ANSWER_SQL.format(x="answer")})
            IS NOT DISTINCT FROM ({ANSWER_SQL.format(x="response")}) THEN 1.0 ELSE 0.0 END), 6) AS mean_reward
FROM math""")
def task_registry_q(spark, sf):
    task = TS.TASKS["math"](spark, sf)
    r = task.reward(task.df, "answer", "response")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"))


@register("udf03_tokenizer_protocol", sql=f"""{BPE_SQL}
SELECT lang, 'byte' AS tokenizer, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_failures FROM documents GROUP BY lang
UNION ALL SELECT lang, 'bpe', CAST(sum(n_ids) AS BIGINT), CAST(0 AS BIGINT) FROM encoded GROUP BY lang""")
def tokenizer_protocol_q(spark, sf):
    """Both tokenizers through one protocol: tokens per language and round-trip success."""
    from tokenmill.plans.q_tokenizer import train_corpus_bpe
    docs = table(spark, sf, "documents")
    out = None
    for name, tok in (("byte", TK.ByteTokenizer(spark)), ("bpe", TK.BPETokenizer(spark, train_corpus_bpe(spark, sf)))):
        d = tok.decode(tok.encode(docs), out="decoded")
        r = d.groupBy("lang").agg(F.sum(F.size("ids")).alias("n_tokens"),
                                  F.count(F.when(F.col("decoded") != F.col("text"), 1)).alias("n_failures")) \
             .withColumn("tokenizer", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@register("udf05_pack_udtf", sql=PLAN_SQL["bestfit_crop"])
def pack_udtf_q(spark, sf):
    """Best-fit crop as an Arrow table function over ``TABLE(t) PARTITION BY grp ORDER BY pos``."""
    from tokenmill.plans.q_packing import BUFFER, CAP, lengths
    spark.udtf.register("tm_pack_bestfit", P.make_pack_udtf(CAP, BUFFER, crop=True))
    src = lengths(spark, sf).select("grp", F.col("pos").cast("bigint").alias("pos"), "doc_id", F.col("n_tokens").alias("n"),
                                    F.col("batch").cast("bigint").alias("bkey"))
    src.createOrReplaceTempView("tm_pack_input")
    return spark.sql("SELECT * FROM tm_pack_bestfit(TABLE(tm_pack_input) PARTITION BY grp ORDER BY pos)")


# ----------------------------------------------------------------------------- explicit IDs


@register("flt14_valid_targets", sql=f"""
WITH {RENDER_SQL},
pr AS (SELECT CASE WHEN mask[p + 1] = 1 THEN ids[p + 1] ELSE -1 END AS target
       FROM (SELECT ids, mask, unnest(range(1, len(ids))) AS p FROM r))
SELECT CAST(count(*) AS BIGINT) AS n_targets, CAST(count(*) FILTER (WHERE target >= 0 AND target < 256) AS BIGINT) AS n_valid,
       CAST(count(*) FILTER (WHERE target >= 256) AS BIGINT) AS n_special
FROM pr""")
def valid_targets_q(spark, sf):
    r = CV.render(chat_ok(spark, sf), max_tokens=None).withColumn("tg", CV.targets_from_mask("ids", "mask"))
    e = r.select(F.explode("tg").alias("target"))
    tb = TK.token_bytes_table(TK.byte_vocab(spark), mode="raw")
    v = scoring.valid_targets(e, tb)
    n_valid = v.agg(F.count(F.lit(1))).scalar()
    return e.agg(F.count(F.lit(1)).alias("n_targets"), F.count(F.when(F.col("target") >= 256, 1)).alias("n_special")) \
            .withColumn("n_valid", n_valid)


@register("tok06_roundtrip_failures", sql="SELECT doc_id FROM documents WHERE octet_length(encode(text)) < 0")
def roundtrip_failures_q(spark, sf):
    d = TK.byte_decode(TK.byte_encode(table(spark, sf, "documents")), out="decoded")
    return TK.roundtrip_failures(d).select("doc_id")


@register("tok06_roundtrip_failures_fault", sql="SELECT doc_id FROM documents WHERE contains(text, 'z')")
def roundtrip_failures_fault_q(spark, sf):
    """What the check finds if the decoder has lost a byte: z comes back as a question mark."""
    ids = F.transform("ids", lambda i: F.when(i == ord("z"), ord("?")).otherwise(i))
    d = TK.byte_decode(TK.byte_encode(table(spark, sf, "documents")).withColumn("ids", ids), out="decoded")
    return TK.roundtrip_failures(d).select("doc_id")


@register("src13_shuffled_scan", sql=f"""
SELECT conv_id, CAST(row_number() OVER (ORDER BY {hash_sql(42, "conv_id")}, conv_id) - 1 AS BIGINT) AS pos
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def shuffled_scan_q(spark, sf):
    from tokenmill.operators.ordering import permute
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    return permute(c, "conv_id", seed=42, name="pos", n_buckets=64)


@register("gen04_diversity_prompts", sql=f"""
WITH cats AS (SELECT source AS cat, row_number() OVER (ORDER BY source) - 1 AS ci FROM (SELECT DISTINCT source FROM documents)),
personas AS (SELECT c_mktsegment AS persona, row_number() OVER (ORDER BY c_mktsegment) - 1 AS pi FROM (SELECT DISTINCT c_mktsegment FROM customer)),
dyn AS (SELECT o_orderpriority AS dynamic, row_number() OVER (ORDER BY o_orderpriority) - 1 AS di FROM (SELECT DISTINCT o_orderpriority FROM orders)),
mcat AS (SELECT event_type AS mc FROM (SELECT DISTINCT event_type FROM events)),
ex AS (SELECT event_type AS mc, arg_min(props, event_id) AS example FROM events GROUP BY 1),
rows AS (SELECT doc_id AS i FROM documents),
pick AS (SELECT i, c.cat, p.persona, d.dynamic FROM rows
         JOIN cats c ON c.ci = {hash_sql("dc", "i")} % (SELECT count(*) FROM cats)
         JOIN personas p ON p.pi = {hash_sql("dp", "i")} % (SELECT count(*) FROM personas)
         JOIN dyn d ON d.di = {hash_sql("dd", "i")} % (SELECT count(*) FROM dyn)),
pos AS (SELECT mc, row_number() OVER (ORDER BY mc) - 1 AS pos, (SELECT count(*) FROM mcat) AS n FROM mcat),
d2 AS (SELECT i, n, {hash_sql("m1", "i")} % n AS a, ({hash_sql("m1", "i")} % n + 1 + {hash_sql("m2", "i")} % (n - 1)) % n AS b,
              {hash_sql("m3", "i")} % (n - 2) AS r FROM rows, (SELECT count(*) AS n FROM mcat)),
d3 AS (SELECT *, r + CAST(r >= least(a, b) AS INTEGER) AS r1 FROM d2),
d4 AS (SELECT i, unnest([a, b, r1 + CAST(r1 >= greatest(a, b) AS INTEGER)]) AS pos, unnest([0, 1, 2]) AS rk FROM d3),
three AS (SELECT i, string_agg(mc || ': ' || ex.example, ' | ' ORDER BY rk) AS examples
          FROM d4 JOIN pos USING (pos) JOIN ex USING (mc) GROUP BY i)
SELECT pick.i, printf('Write a conversation about %s for a %s user, %s priority. Examples: %s', cat, persona, dynamic, examples)
       AS prompt
FROM pick JOIN three USING (i)""")
def diversity_prompts_q(spark, sf):
    """GEN-04: stratified picks from dimension tables derived from the given tables, and three distinct
    message categories per row, drawn by position, with one example each."""
    from tokenmill.functions.hashing import hash_key

    def dim(df, col, idx):
        # a dimension is a set of distinct labels (a handful of rows): rank it directly
        d = df.select(F.col(col).alias("v")).distinct()
        return d.withColumn(idx, (F.dense_rank().over(Window.orderBy("v")) - 1).cast("bigint"))

    cats = dim(table(spark, sf, "documents"), "source", "ci").withColumnRenamed("v", "cat")
    pers = dim(table(spark, sf, "customer"), "c_mktsegment", "pi").withColumnRenamed("v", "persona")
    dyn = dim(table(spark, sf, "orders"), "o_orderpriority", "di").withColumnRenamed("v", "dynamic")
    ev = table(spark, sf, "events")
    ex = ev.groupBy(F.col("event_type").alias("mc")).agg(F.min_by("props", "event_id").alias("example"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("i"))
    n = lambda d: d.agg(F.count(F.lit(1))).scalar()
    pick = (rows.withColumn("ci", hash_key("dc", "i") % n(cats)).join(cats, "ci")
                .withColumn("pi", hash_key("dp", "i") % n(pers)).join(pers, "pi")
                .withColumn("di", hash_key("dd", "i") % n(dyn)).join(dyn, "di"))
    ex = ex.withColumn("pos", (F.dense_rank().over(Window.orderBy("mc")) - 1).cast("bigint"))
    drawn = TS.three_positions("i", n(ex))
    r = rows.select("i", F.posexplode(drawn).alias("rank", "pos")).join(ex, "pos")
    three = r.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(
        "mc", F.lit(": "), "example").alias("t")))), lambda x: x["t"]), " | ").alias("examples"))
    out = pick.join(three, "i")
    return out.select("i", F.format_string("Write a conversation about %s for a %s user, %s priority. Examples: %s",
                                           "cat", "persona", "dynamic", "examples").alias("prompt"))
