"""Task-shaping queries: MC / math / code rows, request audit, slices, mixtures, generators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.hashing import HASH_BITS, hash_sql
from tokenmill.functions.text import strip_sql
from tokenmill.operators import conversation as CV
from tokenmill.operators import evaluation as EV
from tokenmill.operators import filters as FL
from tokenmill.operators import runlogs as RL
from tokenmill.operators import tasks as TS
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import BENCH_ITEMS_SQL, LINE_ORDER, eval_items, eval_items_sql, rollouts
from tokenmill.plans.q_conversation import assembled
from tokenmill.plans.q_logs import RUN_LOG_SQL, run_log
from tokenmill.sources.corpus import words_from_text
from tokenmill.session import cut_lineage, spread, table

NL = "chr(10)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(sql_str(x) for x in xs) + "]"


# ----------------------------------------------------------------------------- multiple choice


@register("cnv06_render_mc", sql=f"""
WITH {eval_items_sql()}
SELECT item_id, md5('Multiple Choice question: ' || query || {NL}
       || array_to_string(list_transform(range(len(choices)),
            lambda i: '- ' || choices[i + 1] || '=' || ['A', 'B', 'C', 'D'][i + 1] || {NL}), '')
       || {NL} || 'Respond only with the letter of the correct answer.') AS prompt_md5
FROM eval_items""")
def render_mc_q(spark, sf):
    it = eval_items(spark, sf)
    letters = F.array(*[F.lit(x) for x in CV.LETTERS])
    return it.select("item_id", F.md5(CV.render_mc(F.col("query"), letters, F.col("choices"))).alias("prompt_md5"))


@register("cnv07_mc_to_conversation", sql=f"""
WITH {eval_items_sql()}
SELECT item_id, ['A', 'B', 'C', 'D'][gold + 1] AS answer_letter, CAST(2 AS BIGINT) AS n_messages,
       CASE WHEN len(choices) <> 4 THEN 'need_4_choices' END AS reason
FROM eval_items""")
def mc_conv_q(spark, sf):
    c = CV.mc_to_conversation(eval_items(spark, sf))
    return c.select("item_id", "answer_letter", F.size("messages").cast("bigint").alias("n_messages"), "reason")


# ----------------------------------------------------------------------------- math rows (tool calls)


def math_rows(spark, sf):
    """Worked answers with calculator calls, derived from `lineitem` (key: problem, sample)."""
    li = spread(table(spark, sf, "lineitem"))
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = li.withColumn("sample", (F.row_number().over(w) - 1).cast("bigint"))
    a, b, c = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey")
    rab = a * b + F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0)
    total = rab * c
    answer = F.format_string(
        "Each crate holds <<%d*%d=%d>>%d items. Over %d crates that is <<%d*%d=%d>>%d items, checked by <<%d+0>>.\n#### %s",
        a, b, rab, rab, c, rab, c, total, total, total, F.format_number(total, 0))
    truth = a * b * c
    resp = F.when(F.col("l_tax") == 0, F.lit("I am not sure.")).otherwise(
        F.format_string("The answer is #### %s", F.format_number(F.when(F.col("l_tax") > 0.04, truth + 1).otherwise(truth), 0)))
    return li.select(F.col("l_orderkey").alias("problem"), "sample", answer.alias("answer"), resp.alias("response"))


MATH_SQL = f"""math AS (
  SELECT problem, sample,
    printf('Each crate holds <<%d*%d=%d>>%d items. Over %d crates that is <<%d*%d=%d>>%d items, checked by <<%d+0>>.'
           || {NL} || '#### %s', a, b, rab, rab, c, rab, c, rab * c, rab * c, rab * c, format('{{:,}}', rab * c)) AS answer,
    CASE WHEN l_tax = 0 THEN 'I am not sure.'
         ELSE 'The answer is #### ' || format('{{:,}}', CASE WHEN l_tax > 0.04 THEN a * b * c + 1 ELSE a * b * c END) END
      AS response
  FROM (SELECT l_orderkey AS problem,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS BIGINT) AS sample,
               CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_partkey AS c, l_tax,
               CAST(l_quantity AS BIGINT) * l_linenumber + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS rab
        FROM lineitem))"""

PARTS_SQL = """parts AS (
  SELECT problem, sample, answer, response,
    flatten(list_transform(range(0, len(inn) + 1), lambda i: CASE WHEN i < len(inn) THEN [
        {'type': 'text', 'text': txt[i + 1]},
        {'type': 'python', 'text': CASE WHEN contains(inn[i + 1], '=') THEN regexp_extract(inn[i + 1], '^(.*)=', 1)
                                        ELSE inn[i + 1] END},
        {'type': 'python_output', 'text': CASE WHEN contains(inn[i + 1], '=') THEN regexp_extract(inn[i + 1], '=([^=]*)$', 1)
                                               ELSE '' END}]
      ELSE [{'type': 'text', 'text': txt[i + 1]}] END)) AS parts
  FROM (SELECT *, string_split_regex(answer, '<<[^>]+>>') AS txt, regexp_extract_all(answer, '<<([^>]+)>>', 1) AS inn
        FROM math))"""

ANSWER_SQL = r"""CASE WHEN regexp_matches({x}, '#### (\-?[0-9\.\,]+)')
     THEN replace(trim(regexp_extract({x}, '#### (\-?[0-9\.\,]+)', 1)), ',', '') END"""


def _parts_text(c):
    return F.array_join(F.transform(c, lambda p: F.concat(p["type"], F.lit(":"), p["text"])), "|")


@register("cnv08_parse_tool_calls", sql=f"""
WITH {MATH_SQL}, {PARTS_SQL}
SELECT problem, sample, CAST(len(parts) AS BIGINT) AS n_parts,
       md5(array_to_string(list_transform(parts, lambda p: p.type || ':' || p.text), '|')) AS parts_md5
FROM parts""")
def parse_tool_calls_q(spark, sf):
    m = math_rows(spark, sf).withColumn("parts", CV.parse_tool_calls("answer"))
    return m.select("problem", "sample", F.size("parts").cast("bigint").alias("n_parts"),
                    F.md5(_parts_text(F.col("parts"))).alias("parts_md5"))


@register("cnv09_extract_answer", sql=f"""
WITH {MATH_SQL}
SELECT problem, sample, {ANSWER_SQL.format(x="answer")} AS ref_answer, {ANSWER_SQL.format(x="response")} AS resp_answer
FROM math""")
def extract_answer_q(spark, sf):
    m = math_rows(spark, sf)
    return m.select("problem", "sample", CV.extract_answer("answer").alias("ref_answer"),
                    CV.extract_answer("response").alias("resp_answer"))


@register("evl11_grade_numeric", sql=f"""
WITH {MATH_SQL}
SELECT problem, sample, ({ANSWER_SQL.format(x="answer")}) IS NOT DISTINCT FROM ({ANSWER_SQL.format(x="response")}) AS correct
FROM math""")
def grade_numeric_q(spark, sf):
    m = math_rows(spark, sf)
    return m.select("problem", "sample",
                    EV.grade_numeric(CV.extract_answer("answer"), CV.extract_answer("response")).alias("correct"))


@register("cnv14_parts_to_text", sql=f"""
WITH {MATH_SQL}, {PARTS_SQL}
SELECT problem, sample,
       array_to_string(list_transform(range(1, len(parts) + 1), lambda i:
         CASE WHEN parts[i].type = 'python' THEN '<<' || parts[i].text || '=' || parts[least(i + 1, len(parts))].text || '>>'
              WHEN parts[i].type = 'python_output' THEN '' ELSE parts[i].text END), '') = answer AS roundtrip_ok
FROM parts""")
def parts_to_text_q(spark, sf):
    m = math_rows(spark, sf).withColumn("parts", CV.parse_tool_calls("answer"))
    return m.select("problem", "sample", (CV.parts_to_text("parts") == F.col("answer")).alias("roundtrip_ok"))


@register("cnv13_audit_tool_calls", sql=f"""
WITH {MATH_SQL}, {PARTS_SQL},
calls AS (SELECT problem, sample, parts[i].text AS e, parts[i + 1].text AS o
          FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parts) WHERE parts[i].type = 'python'),
c AS (SELECT problem, sample, o, CAST(CASE WHEN contains(e, '*') THEN CAST(split_part(e, '*', 1) AS BIGINT) * CAST(split_part(e, '*', 2) AS BIGINT)
                                          ELSE CAST(split_part(e, '+', 1) AS BIGINT) + CAST(split_part(e, '+', 2) AS BIGINT) END AS VARCHAR) AS v FROM calls)
SELECT problem, sample, count(*) AS n_calls, count(*) FILTER (WHERE o <> '' AND o <> v) AS n_mismatch, count(*) FILTER (WHERE v IS NULL) AS n_unsupported
FROM c GROUP BY problem, sample""")
def audit_tool_calls_q(spark, sf):
    m = math_rows(spark, sf).withColumn("parts", CV.parse_tool_calls("answer"))
    return CV.audit_tool_calls(m, ["problem", "sample"])


# ----------------------------------------------------------------------------- code rows


def code_rows(spark, sf):
    p = table(spark, sf, "part")
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    even = k % 2 == 0
    prompt = F.when(even, F.format_string("import math\nfrom typing import List\n# helper for %s\n\ndef f_%d(x):\n", name, k)) \
              .otherwise(F.format_string("# %s\ndef f_%d(x):\n    import os\n", name, k))
    completion = F.when(even, F.format_string("Sure:\n```python\ndef f_%d(x):\n    return x * %d\n```\nDone.", k, size)) \
                  .otherwise(F.format_string("def f_%d(x):\n    return x + %d\n", k, size))
    test = F.format_string("def check(f):\n    assert f(1) == %d", size)
    return p.select("p_partkey", prompt.alias("prompt"), completion.alias("completion"), test.alias("test"),
                    F.format_string("f_%d", k).alias("entry_point"))


PROGRAM_SQL = r"regexp_extract(completion, '(?s)```(?:python)?\s*\n(.*?)\n```', 1)"
CODE_SQL = f"""code AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 2 = 0
         THEN 'import math' || {NL} || 'from typing import List' || {NL} || '# helper for ' || p_name || {NL} || {NL}
              || 'def f_' || p_partkey || '(x):' || {NL}
         ELSE '# ' || p_name || {NL} || 'def f_' || p_partkey || '(x):' || {NL} || '    import os' || {NL} END AS prompt,
    CASE WHEN p_partkey % 2 = 0
         THEN 'Sure:' || {NL} || '```python' || {NL} || 'def f_' || p_partkey || '(x):' || {NL} || '    return x * ' || p_size
              || {NL} || '```' || {NL} || 'Done.'
         ELSE 'def f_' || p_partkey || '(x):' || {NL} || '    return x + ' || p_size || {NL} END AS completion,
    'def check(f):' || {NL} || '    assert f(1) == ' || p_size AS test, 'f_' || p_partkey AS entry_point
  FROM part),
code2 AS (
  SELECT *,
    list_transform(string_split(prompt, {NL}), lambda s: {strip_sql('s')}) AS lines,
    CASE WHEN regexp_matches(completion, '(?s)```(?:python)?\\s*\\n(.*?)\\n```')
         THEN {strip_sql(PROGRAM_SQL)}
         ELSE {strip_sql('completion')} END AS program
  FROM code),
code3 AS (
  SELECT *, coalesce(list_position(list_transform(lines, lambda s: NOT (starts_with(s, 'import ') OR starts_with(s, 'from '))
                                                  AND s <> '' AND NOT starts_with(s, '#')), true), len(lines) + 1) AS stop
  FROM code2),
code4 AS (
  SELECT *, array_to_string(list_filter(lines[1:stop - 1], lambda s: starts_with(s, 'import ') OR starts_with(s, 'from ')),
                            {NL}) AS imports
  FROM code3)"""


@register("cnv10_extract_imports", sql=f"WITH {CODE_SQL} SELECT p_partkey, imports FROM code4")
def imports_q(spark, sf):
    return code_rows(spark, sf).select("p_partkey", CV.extract_imports("prompt").alias("imports"))


@register("cnv11_extract_program", sql=f"WITH {CODE_SQL} SELECT p_partkey, md5(program) AS program_md5 FROM code4")
def program_q(spark, sf):
    return code_rows(spark, sf).select("p_partkey", F.md5(CV.extract_program("completion")).alias("program_md5"))


@register("cnv12_assemble_program", sql=f"""
WITH {CODE_SQL}
SELECT p_partkey, md5(imports || {NL} || {NL} || program || {NL} || {NL} || test || {NL} || 'check(' || entry_point || ')')
       AS program_md5
FROM code4""")
def assemble_program_q(spark, sf):
    c = code_rows(spark, sf)
    prog = CV.assemble_program(CV.extract_imports("prompt"), CV.extract_program("completion"), F.col("test"),
                               F.col("entry_point"))
    return c.select("p_partkey", F.md5(prog).alias("program_md5"))


# ----------------------------------------------------------------------------- request audit / non-finite


@register("flt10_audit_requests", sql="""
WITH c AS (
  SELECT conv_id, count(*) AS n, sum(length(text)) AS total,
         arg_min(CASE WHEN text IS NULL OR text = '' THEN 'empty_content' WHEN length(text) > 8000 THEN 'message_too_long' END,
                 turn) FILTER (WHERE text IS NULL OR text = '' OR length(text) > 8000) AS first_bad,
         bool_or(role NOT IN ('user', 'assistant')) AS bad_role,
         (conv_id % 25) / 10.0 AS temperature, conv_id * 7 % 250 AS top_k, conv_id * 97 % 5000 AS max_tokens
  FROM conversations GROUP BY conv_id)
SELECT conv_id,
  CASE WHEN n = 0 THEN 'no_messages' WHEN n > 500 THEN 'too_many_messages' WHEN first_bad IS NOT NULL THEN first_bad
       WHEN total > 32000 THEN 'conversation_too_long' WHEN bad_role THEN 'invalid_role'
       WHEN NOT (temperature BETWEEN 0.0 AND 2.0) THEN 'bad_temperature' WHEN NOT (top_k BETWEEN 0 AND 200) THEN 'bad_top_k'
       WHEN NOT (max_tokens BETWEEN 1 AND 4096) THEN 'bad_max_tokens' END AS reject_reason
FROM c""")
def audit_q(spark, sf):
    a = assembled(spark, sf).withColumn("temperature", (F.col("conv_id") % 25) / 10.0) \
        .withColumn("top_k", F.col("conv_id") * 7 % 250).withColumn("max_tokens", F.col("conv_id") * 97 % 5000)
    return TS.audit_requests(a).select("conv_id", "reject_reason")


NF_COLS = ["pct", "raw_loss", "loss"]


@register("flt12_nonfinite_columns", sql=f"""
WITH {RUN_LOG_SQL},
p AS (SELECT run, line_no,
        {", ".join(f"TRY_CAST(nullif(replace(regexp_extract(line, '{RL.STEP_FIELDS[c][0]}', 1), ',', ''), '') AS DOUBLE) AS {c}" for c in NF_COLS)}
      FROM run_log WHERE line LIKE 'step %'),
f AS (SELECT run, line_no, list_filter([{", ".join(f"CASE WHEN isnan({c}) OR isinf({c}) THEN '{c}' END" for c in NF_COLS)}],
                                       lambda x: x IS NOT NULL) AS l FROM p)
SELECT run, line_no, array_to_string(l, ',') AS nonfinite FROM f WHERE len(l) > 0""")
def nonfinite_q(spark, sf):
    p = RL.parse_step_line(run_log(spark, sf).where(F.col("line").like("step %")).select("run", "line_no", "line"))
    n = TS.nonfinite_columns(p, NF_COLS)
    return n.where(F.col("nonfinite").isNotNull()).select("run", "line_no", "nonfinite")


# ----------------------------------------------------------------------------- slices and limits


@register("flt03_slice_task", sql=f"""
WITH {BENCH_ITEMS_SQL}
SELECT item_id, CAST((perm - 5) // 3 AS BIGINT) AS idx FROM bench_items WHERE perm >= 5 AND perm < 30 AND (perm - 5) % 3 = 0""")
def slice_q(spark, sf):
    it = eval_items(spark, sf).select("item_id", F.col("perm").alias("idx"))
    return FL.slice_task(it, start=5, stop=30, step=3)


@register("flt04_limit_per_task", sql=f"""
WITH r AS (SELECT *, {hash_sql(1337, "k")} AS h FROM (SELECT *, problem || '-' || sample AS k FROM (
  SELECT ['ARC-Easy', 'ARC-Challenge', 'MMLU', 'GSM8K', 'HumanEval', 'SpellingBee'][l_orderkey % 6 + 1] AS task,
         l_orderkey AS problem, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS sample
  FROM lineitem)))
SELECT task, k FROM (SELECT task, k, row_number() OVER (PARTITION BY task ORDER BY h, k) AS rn FROM r) WHERE rn <= 50""")
def limit_per_task_q(spark, sf):
    r = rollouts(spark, sf).select("task", F.concat_ws("-", "problem", "sample").alias("k"))
    return FL.limit_per_task(r, 50, task="task", key="k", seed=1337).select("task", "k")


@register("flt05_limit_problems", sql=f"WITH {BENCH_ITEMS_SQL} SELECT item_id FROM bench_items WHERE perm < 25")
def limit_problems_q(spark, sf):
    return FL.limit_problems(eval_items(spark, sf).select("item_id", F.col("perm").alias("idx")), 25).select("item_id")


@register("flt06_complete_runs", sql="SELECT p_partkey FROM part WHERE p_retailprice - 1000 > 0")
def complete_runs_q(spark, sf):
    p = table(spark, sf, "part").withColumn("metric", F.col("p_retailprice") - 1000)
    return FL.complete_runs(p, "metric").select("p_partkey")


# ----------------------------------------------------------------------------- mixtures


def mixture_members(spark, sf):
    from tokenmill.operators.ordering import with_index
    conv = CV.split_valid(CV.validate_chat(assembled(spark, sf)))[0].select("conv_id")
    conv = with_index(conv, ["conv_id"], name="local_idx").select("local_idx")
    items = eval_items(spark, sf).select(F.col("perm").alias("local_idx"))
    return [(conv, 2), (items, 3)]


def _conv_valid_sql():
    from tokenmill.plans.q_conversation import MSG_SQL
    return MSG_SQL + ", conv_valid AS (SELECT conv_id FROM chat_reason WHERE reason IS NULL)"


MIX_SQL = f"""{_conv_valid_sql()}, {BENCH_ITEMS_SQL},
members AS (
  SELECT CAST(0 AS BIGINT) AS task_idx, CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS local_idx, 2 AS epochs
  FROM conv_valid
  UNION ALL SELECT CAST(1 AS BIGINT), perm, 3 FROM bench_items),
rep AS (SELECT task_idx, local_idx, CAST(unnest(range(0, epochs)) AS BIGINT) AS epoch FROM members),
mix AS (SELECT *, CAST(row_number() OVER (ORDER BY {hash_sql(42, "task_idx || ':' || local_idx || ':' || epoch")},
                                          task_idx || ':' || local_idx || ':' || epoch) - 1 AS BIGINT) AS pos FROM rep)"""


@register("set01_mixture", sql=f"WITH {MIX_SQL} SELECT task_idx, local_idx, epoch, pos FROM mix")
def mixture_q(spark, sf):
    return TS.mixture(mixture_members(spark, sf), seed=42, n_buckets=64)


@register("set02_curriculum", sql=f"""
WITH {MIX_SQL},
sz AS (SELECT task_idx, count(*) AS n FROM members GROUP BY task_idx),
off AS (SELECT task_idx, sum(n) OVER (ORDER BY task_idx) - n AS o FROM sz)
SELECT m.task_idx, m.local_idx, CAST(o + m.local_idx AS BIGINT) AS idx FROM members m JOIN off USING (task_idx)""")
def curriculum_q(spark, sf):
    return TS.curriculum([m for m, _ in mixture_members(spark, sf)]).select("task_idx", "local_idx", "idx")


@register("set03_mixture_shares", sql=f"""
WITH {MIX_SQL}
SELECT task_idx, CAST(count(*) AS BIGINT) AS rows, round(count(*) / (SELECT count(*) FROM mix), 6) AS share
FROM mix GROUP BY task_idx""")
def shares_q(spark, sf):
    s = TS.mixture_shares(TS.mixture(mixture_members(spark, sf), seed=42, n_buckets=64))
    return s.select("task_idx", "rows", F.round("share", 6).alias("share"))


@register("set04_union_with_source", sql="""
WITH m AS (SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY p_brand),
e AS (SELECT p_brand, regr_intercept(p_retailprice, p_size) + regr_slope(p_retailprice, p_size) * avg(p_size) AS v
      FROM part GROUP BY p_brand)
SELECT p_brand, round(v, 4) AS v, 'measured' AS source FROM m UNION ALL SELECT p_brand, round(v, 4), 'estimated' FROM e""")
def union_source_q(spark, sf):
    from tokenmill.operators import fits as FT
    p = table(spark, sf, "part")
    measured = p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("v"))
    fit = FT.linreg(p, "p_size", "p_retailprice", ["p_brand"]).join(p.groupBy("p_brand").agg(F.avg("p_size").alias("ms")), "p_brand")
    est = fit.select("p_brand", F.round(F.col("intercept") + F.col("slope") * F.col("ms"), 4).alias("v"))
    return TS.union_with_source([(measured, "measured"), (est, "estimated")])


# ----------------------------------------------------------------------------- generators


_WORDS: dict = {}


def corpus_words(spark, sf):
    """The corpus's distinct words, stored once for each session and path: the generators read them several times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WORDS:
        _WORDS[key] = cut_lineage(words_from_text(spread(table(spark, sf, "documents").select("text"))))
    return _WORDS[key]


WORDS_SQL = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)"""


def _words_idx_sql(seed: int, name: str) -> str:
    return f"""{name} AS (SELECT word, CAST(row_number() OVER (ORDER BY {hash_sql(seed, "word")}, word) - 1 AS BIGINT) AS widx
  FROM words)"""


def _below_sql(seed, x, p):
    return f"{hash_sql(seed, x)} < {int(p * (1 << HASH_BITS))}"


def _pick_sql(options, seed, x):
    return f"{sql_list(options)}[{hash_sql(seed, x)} % {len(options)} + 1]"


GEN_SQL = f"""{WORDS_SQL}, {_words_idx_sql(0, "w")},
r AS (SELECT widx AS i, widx AS seed FROM w),
g AS (SELECT r.i, r.seed, w.word FROM r JOIN w ON w.widx = {hash_sql("gw", "r.seed")} % (SELECT count(*) FROM w)),
g2 AS (SELECT *, CASE WHEN {_below_sql("gp", "seed", 0.9)}
                      THEN substring(word, CAST({hash_sql("gl", "seed")} % length(word) + 1 AS INTEGER), 1)
                      ELSE {_pick_sql(list(TS.LETTERS), "gr", "seed")} END AS letter,
             {_pick_sql(TS.USER_MSG_TEMPLATES, "gt", "seed")} AS tmpl0,
             {_pick_sql(TS.QUOTES, "gq1", "seed")} AS lq, {_pick_sql(TS.QUOTES, "gq2", "seed")} AS wq FROM g),
g3 AS (SELECT *, CASE WHEN {_below_sql("gc", "seed", 0.3)} THEN lower(tmpl0) ELSE tmpl0 END AS tmpl FROM g2),
gen AS (SELECT i, word, letter, CAST(length(word) - length(replace(word, letter, '')) AS BIGINT) AS count,
               replace(replace(tmpl, '{{letter}}', lq || letter || lq), '{{word}}', wq || word || wq)
               || CASE WHEN {_below_sql("gm", "seed", 0.5)} THEN '?' ELSE '' END AS user_msg FROM g3)"""


def letter_rows(spark, sf):
    w = TS.indexed_words(corpus_words(spark, sf))
    return TS.letter_count_rows(corpus_words(spark, sf), w.select(F.col("widx").alias("id")))


@register("gen01_letter_count_rows", sql=f"WITH {GEN_SQL} SELECT i, word, letter, count, user_msg FROM gen")
def letter_count_q(spark, sf):
    return letter_rows(spark, sf)


@register("gen02_worked_solution", sql=f"""
WITH {GEN_SQL},
s AS (SELECT i, word, letter, CAST(count AS VARCHAR) AS c,
        'We are asked to find the number ''' || letter || ''' in the word ''' || word
        || '''. Let me try a manual approach first.' || {NL} || {NL} || 'First spell the word out:' || {NL}
        || word || ':' || array_to_string(string_split(word, ''), ',') || {NL} || {NL}
        || 'Then count the occurrences of ''' || letter || ''':' || {NL}
        || array_to_string(list_transform(range(1, length(word) + 1), lambda k:
             CASE WHEN substring(word, k, 1) = letter
                  THEN CAST(k AS VARCHAR) || ':' || substring(word, k, 1) || ' hit! count='
                       || CAST(k - length(replace(substring(word, 1, k), letter, '')) AS VARCHAR) || {NL}
                  ELSE CAST(k AS VARCHAR) || ':' || substring(word, k, 1) || {NL} END), '')
        || {NL} || 'This gives us ' || CAST(count AS VARCHAR) || '.' AS manual
      FROM gen)
SELECT i, md5(manual || {NL} || {NL} || 'Let me double check this using Python:' || {NL} || {NL}
              || '<<''' || word || '''.count(''' || letter || ''')=' || c || '>>'
              || {NL} || {NL} || 'Python gives us ' || c || '.' || {NL} || {NL} || 'My final answer is:' || {NL} || {NL}
              || '#### ' || c) AS solution_md5
FROM s""")
def worked_solution_q(spark, sf):
    r = letter_rows(spark, sf).withColumn("parts", TS.worked_solution(F.col("word"), F.col("letter")))
    return r.select("i", F.md5(CV.parts_to_text("parts")).alias("solution_md5"))


@register("gen03_spelling_rows", sql=f"""
WITH {WORDS_SQL}, {_words_idx_sql(42, "w")}, {_words_idx_sql(0, "w0")},
r AS (SELECT widx AS i FROM w0)
SELECT r.i, w.word, 'Spell the word: ' || w.word AS user, w.word || ':' || array_to_string(string_split(w.word, ''), ',') AS assistant
FROM r JOIN w ON w.widx = {hash_sql("sw", "r.i")} % (SELECT count(*) FROM w)""")
def spelling_q(spark, sf):
    words = corpus_words(spark, sf)
    n = words.count()  # one scalar: rows = one per word
    return TS.spelling_rows(words, n)


@register("gen05_generation_summary", sql="""
WITH m AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text,
         count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
f AS (SELECT conv_id, max(n) AS n,
             arg_min(CASE WHEN role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'bad_role'
                          WHEN regexp_matches(text, '^\\s*$') THEN 'blank_content' END, i)
               FILTER (WHERE role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END OR regexp_matches(text, '^\\s*$'))
               AS code
      FROM m GROUP BY conv_id),
s AS (SELECT CASE WHEN n < 2 THEN 'error' WHEN code IS NOT NULL THEN 'error' ELSE 'ok' END AS status FROM f)
SELECT status, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY status""")
def generation_summary_q(spark, sf):
    v = CV.validate_strict(assembled(spark, sf)).withColumn(
        "status", F.when(F.col("reason").isNull(), "ok").otherwise("error"))
    g = TS.generation_summary(v)
    return g.select("status", "n", F.round("share", 6).alias("share"))
