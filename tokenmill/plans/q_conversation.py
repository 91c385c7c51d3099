"""Conversation queries (CNV-*, FLT-08/09) on the `conversations` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.operators import conversation as CV
from tokenmill.plans.catalog import register
from tokenmill.session import spread, table


def assembled(spark, sf):
    return CV.assemble(spread(table(spark, sf, "conversations")))


def chat_ok(spark, sf):
    ok, _ = CV.split_valid(CV.validate_chat(assembled(spark, sf)))
    return ok


def md5_ids(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


# per-message SQL pieces shared by the oracles
MSG_SQL = """m0 AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i0,
         count(*) OVER (PARTITION BY conv_id) AS n0,
         first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r0,
         first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t0
  FROM conversations),
m1 AS (
  SELECT *, CASE WHEN r0 = 'system' THEN 1 ELSE 0 END AS has_sys,
         i0 - CASE WHEN r0 = 'system' THEN 1 ELSE 0 END AS i
  FROM m0),
chat_reason AS (
  SELECT conv_id,
         CASE WHEN max(n0) - max(has_sys) < 2 THEN 'too_few_messages'
              ELSE arg_min(code, i) FILTER (WHERE code IS NOT NULL) END AS reason
  FROM (SELECT *, CASE WHEN i >= 0 AND role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END
                       THEN 'bad_role' END AS code FROM m1)
  GROUP BY conv_id),
merged AS (
  SELECT conv_id, i, role,
         CASE WHEN has_sys = 1 AND i0 = 1 THEN t0 || chr(10) || chr(10) || text ELSE text END AS text
  FROM m1 WHERE i >= 0 AND conv_id IN (SELECT conv_id FROM chat_reason WHERE reason IS NULL)),
mb AS (
  SELECT conv_id, i, role, n_msgs,
         list_transform(range(1, length(h) // 2 + 1), lambda k: CAST(('0x' || substr(h, 2 * k - 1, 2)) AS INTEGER)) AS b
  FROM (SELECT *, hex(encode(text)) AS h, count(*) OVER (PARTITION BY conv_id) AS n_msgs FROM merged)),
mids AS (
  SELECT conv_id, i, role, n_msgs,
         CASE WHEN role = 'user' THEN list_concat(list_concat([257], b), [258])
              ELSE list_concat(list_concat([259], b), [260]) END AS ids,
         CASE WHEN role = 'user' THEN list_transform(range(len(b) + 2), lambda x: 0)
              ELSE list_concat(list_concat([0], list_transform(b, lambda x: 1)), [1]) END AS mask
  FROM mb)"""


@register("cnv01_assemble", sql="""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
       md5(string_agg(text, '|' ORDER BY turn)) AS text_md5
FROM conversations GROUP BY conv_id
""")
def assemble_q(spark, sf):
    a = assembled(spark, sf)
    return a.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "|")).alias("text_md5"))


@register("flt08_validate_strict", sql="""
WITH m AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
f AS (
  SELECT conv_id, n, i,
         CASE WHEN role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'bad_role'
              WHEN regexp_matches(text, '^\\s*$') THEN 'blank_content' END AS code
  FROM m)
SELECT conv_id, CASE WHEN max(n) < 2 THEN 'too_few_messages'
                     ELSE arg_min(code, i) FILTER (WHERE code IS NOT NULL) END AS reason
FROM f GROUP BY conv_id
""")
def validate_strict_q(spark, sf):
    return CV.validate_strict(assembled(spark, sf)).select("conv_id", "reason")


@register("flt09_validate_chat", sql=f"""
WITH {MSG_SQL}
SELECT conv_id, reason FROM chat_reason
""")
def validate_chat_q(spark, sf):
    return CV.validate_chat(assembled(spark, sf)).select("conv_id", "reason")


@register("cnv02_merge_system", sql="""
WITH m AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
         count(*) OVER (PARTITION BY conv_id) AS n,
         first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r0,
         first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t0
  FROM conversations),
c AS (
  SELECT conv_id, max(n) AS n, max(r0) AS r0, max(t0) AS t0,
         max(CASE WHEN i = 1 THEN role END) AS role1, max(CASE WHEN i = 1 THEN text END) AS text1
  FROM m GROUP BY conv_id),
b AS (SELECT *, r0 = 'system' AND (n < 2 OR coalesce(role1, '') <> 'user') AS bad FROM c)
SELECT conv_id,
       CAST(CASE WHEN r0 = 'system' AND NOT bad THEN n - 1 ELSE n END AS BIGINT) AS n_messages,
       CASE WHEN r0 = 'system' AND NOT bad THEN role1 ELSE r0 END AS first_role,
       md5(CASE WHEN r0 = 'system' AND NOT bad THEN t0 || chr(10) || chr(10) || text1 ELSE t0 END) AS first_md5,
       CASE WHEN bad THEN 'system_not_followed_by_user' END AS merge_error
FROM b
""")
def merge_system_q(spark, sf):
    m = CV.merge_system(assembled(spark, sf))
    first = F.element_at("messages", 1)
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    first["role"].alias("first_role"), F.md5(first["text"]).alias("first_md5"), "merge_error")


@register("cnv03_render", sql=f"""
WITH {MSG_SQL},
r AS (
  SELECT conv_id,
         list_concat([256], flatten(list(ids ORDER BY i)))[1:2048] AS ids,
         list_concat([0], flatten(list(mask ORDER BY i)))[1:2048] AS mask
  FROM mids GROUP BY conv_id)
SELECT conv_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(mask) AS BIGINT) AS n_mask,
       md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(mask, ',')) AS mask_md5
FROM r
""")
def render_q(spark, sf):
    r = CV.render(chat_ok(spark, sf))
    return r.select("conv_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_mask"),
                    md5_ids("ids").alias("ids_md5"), md5_ids("mask").alias("mask_md5"))


@register("cnv04_render_for_completion", sql=f"""
WITH {MSG_SQL},
last AS (SELECT conv_id FROM mids WHERE i = n_msgs - 1 AND role = 'assistant'),
r AS (
  SELECT conv_id, list_concat(list_concat([256], flatten(list(ids ORDER BY i)))[1:2048], [259]) AS ids
  FROM mids WHERE conv_id IN (SELECT conv_id FROM last) AND i < n_msgs - 1 GROUP BY conv_id)
SELECT conv_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM r
""")
def render_completion_q(spark, sf):
    r = CV.render_for_completion(chat_ok(spark, sf))
    return r.select("conv_id", F.size("ids").cast("bigint").alias("n_tokens"), md5_ids("ids").alias("ids_md5"))


@register("cnv05_targets_from_mask", sql=f"""
WITH {MSG_SQL},
r AS (
  SELECT conv_id,
         list_concat([256], flatten(list(ids ORDER BY i)))[1:2048] AS ids,
         list_concat([0], flatten(list(mask ORDER BY i)))[1:2048] AS mask
  FROM mids GROUP BY conv_id),
t AS (SELECT conv_id, list_transform(range(2, len(ids) + 1), lambda k: CASE WHEN mask[k] = 1 THEN ids[k] ELSE -1 END) AS tg
      FROM r)
SELECT conv_id, CAST(len(tg) AS BIGINT) AS n_targets,
       CAST(len(list_filter(tg, lambda x: x = -1)) AS BIGINT) AS n_ignored, md5(array_to_string(tg, ',')) AS targets_md5
FROM t
""")
def targets_q(spark, sf):
    r = CV.render(chat_ok(spark, sf)).withColumn("tg", CV.targets_from_mask("ids", "mask"))
    return r.select("conv_id", F.size("tg").cast("bigint").alias("n_targets"),
                    F.size(F.filter("tg", lambda x: x == -1)).cast("bigint").alias("n_ignored"),
                    md5_ids("tg").alias("targets_md5"))
