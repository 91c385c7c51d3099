"""Packing queries (PCK-*) on byte-tokenised documents (BOS + UTF-8 bytes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tokenmill.functions.text import byte_ids
from tokenmill.operators import packing as P
from tokenmill.operators.tokenizer import BYTE_BOS
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import CORPUS_SQL, RG_ROWS, corpus_split
from tokenmill.sources import corpus as C

T = 2048
CAP = T + 1          # row capacity (inputs and targets share one extra token)
BUFFER = 1000        # docs kept in the best-fit buffer
WORLD = 2            # data-parallel ranks
GROUP_SHARDS = 8     # shards whose row groups a rank packs together


def lengths(spark, sf):
    """Documents with their token count (BOS + bytes), pack group (split, rank, stretch of shards) and refill batch."""
    d = C.assign_rank(corpus_split(spark, sf), WORLD)
    stretch = F.floor(F.col("shard_idx") / GROUP_SHARDS)
    grp = (stretch * WORLD + F.col("rank")) * 2 + (F.col("split") == "val").cast("int")
    return d.select("doc_id", "pos", grp.cast("bigint").alias("grp"), F.floor(F.col("pos") / RG_ROWS).cast("bigint").alias("batch"),
                    (F.octet_length("text") + 1).cast("bigint").alias("n_tokens"))


LENGTHS_SQL = f"""{CORPUS_SQL},
lengths AS (SELECT doc_id, pos, CAST(((shard_idx // {GROUP_SHARDS}) * {WORLD} + rg_idx % {WORLD}) * 2 + CAST(split = 'val' AS INTEGER) AS BIGINT) AS grp,
                   CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_tokens FROM corpus_split)"""


def plan(spark, sf, algo):
    return P.pack(lengths(spark, sf), algo, CAP, BUFFER, group="grp", batch="batch")


def _plan_q(algo):
    def q(spark, sf):
        return plan(spark, sf, algo)
    return q


def _greedy_sql(crop: bool) -> str:
    """One step per document of a group: where it starts, what it takes, and where the next one starts."""
    over = f"t.pos > 0 AND g.n_tokens > {CAP} - t.pos"
    if crop:  # what overflows fills the row
        row, pos, slot = "t.row", "t.pos", "t.slot"
    else:     # what overflows starts a row
        row, pos, slot = (f"CASE WHEN {over} THEN {x} END" for x in ("t.row + 1 ELSE t.row", "0 ELSE t.pos", "0 ELSE t.slot"))
    return f"""WITH RECURSIVE {LENGTHS_SQL},
g AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS rn FROM lengths),
t(grp, rn, doc_id, n_tokens, at_row, at_slot, take, row, pos, slot) AS (
  SELECT grp, CAST(0 AS BIGINT), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM (SELECT DISTINCT grp FROM lengths)
  UNION ALL
  SELECT grp, rn, doc_id, n_tokens, r, s, k, CASE WHEN p + k >= {CAP} THEN r + 1 ELSE r END,
         CASE WHEN p + k >= {CAP} THEN 0 ELSE p + k END, CASE WHEN p + k >= {CAP} THEN 0 ELSE s + 1 END
  FROM (SELECT g.grp, g.rn, g.doc_id, g.n_tokens, {row} AS r, {slot} AS s, {pos} AS p,
               least(g.n_tokens, {CAP} - ({pos})) AS k
        FROM t JOIN g ON g.grp = t.grp AND g.rn = t.rn + 1))
SELECT grp, at_row AS row_id, CAST(at_slot AS INTEGER) AS slot, doc_id, take, n_tokens FROM t WHERE rn > 0"""


def _bestfit_sql(crop: bool) -> str:
    """One step per placement. A group has at most RG_ROWS * 4 * GROUP_SHARDS / WORLD documents, fewer than BUFFER, so that all are
    waiting when the first is placed: they are a list, shortest first, of equal ones the earliest last."""
    at = f"""SELECT *, CASE WHEN k > 0 THEN k ELSE {"len(list_filter(ns, lambda x: x = ns[1]))" if crop else "0"} END AS i,
              CASE WHEN k > 0 THEN ns[k] ELSE {CAP} - pos END AS use
       FROM (SELECT *, len(list_filter(ns, lambda x: x <= {CAP} - pos)) AS k FROM t WHERE len(ns) > 0)"""
    return f"""WITH RECURSIVE {LENGTHS_SQL},
g AS (SELECT grp, list(n_tokens ORDER BY n_tokens, pos DESC) AS ns, list(doc_id ORDER BY n_tokens, pos DESC) AS ds
      FROM lengths {"" if crop else f"WHERE n_tokens <= {CAP}"} GROUP BY grp),
t(grp, ns, ds, row, slot, pos, at_row, at_slot, doc_id, take, n_tokens) AS (
  SELECT grp, ns, ds, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM g
  UNION ALL
  SELECT grp, CASE WHEN i = 0 THEN ns ELSE list_concat(ns[1:i - 1], ns[i + 1:]) END, CASE WHEN i = 0 THEN ds ELSE list_concat(ds[1:i - 1], ds[i + 1:]) END,
         CASE WHEN i = 0 OR pos + use >= {CAP} THEN row + 1 ELSE row END, CASE WHEN i = 0 OR pos + use >= {CAP} THEN 0 ELSE slot + 1 END,
         CASE WHEN i = 0 OR pos + use >= {CAP} THEN 0 ELSE pos + use END, row, slot, CASE WHEN i > 0 THEN ds[i] END, use, CASE WHEN i > 0 THEN ns[i] END
  FROM ({at}))
SELECT grp, at_row AS row_id, CAST(at_slot AS INTEGER) AS slot, doc_id, take, n_tokens FROM t WHERE doc_id IS NOT NULL"""


FFD_SQL = f"""WITH RECURSIVE {LENGTHS_SQL},
g AS (SELECT *, least(n_tokens, {CAP}) AS take, row_number() OVER (PARTITION BY grp ORDER BY least(n_tokens, {CAP}) DESC, pos) AS rn FROM lengths),
t(grp, rn, free, used, r, slot, doc_id, take, n_tokens) AS (
  SELECT DISTINCT grp, CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM g
  UNION ALL
  SELECT grp, rn, CASE WHEN r > len(free) THEN list_append(free, {CAP} - take) ELSE list_concat(list_append(free[1:r - 1], free[r] - take), free[r + 1:]) END,
         CASE WHEN r > len(free) THEN list_append(used, 1) ELSE list_concat(list_append(used[1:r - 1], used[r] + 1), used[r + 1:]) END,
         r, CASE WHEN r > len(free) THEN 0 ELSE used[r] END, doc_id, take, n_tokens
  FROM (SELECT t.grp, g.rn, free, used, g.doc_id, g.take, g.n_tokens,
               coalesce(nullif(list_position(list_transform(free, lambda x: x >= g.take), true), 0), len(free) + 1) AS r
        FROM t JOIN g ON g.grp = t.grp AND g.rn = t.rn + 1))
SELECT grp, CAST(r - 1 AS BIGINT) AS row_id, CAST(slot AS INTEGER) AS slot, doc_id, take, n_tokens FROM t WHERE rn > 0"""

PLAN_SQL = {"bestfit_crop": _bestfit_sql(True), "bestfit_pad": _bestfit_sql(False), "greedy_crop": _greedy_sql(True), "greedy_pad": _greedy_sql(False), "ffd": FFD_SQL}

for _id, _algo in (("pck01", "bestfit_crop"), ("pck02", "bestfit_pad"), ("pck03", "greedy_crop"), ("pck04", "greedy_pad"), ("pck05", "ffd")):
    register(f"{_id}_{_algo}", sql=PLAN_SQL[_algo])(_plan_q(_algo))


@register("pck_invariants", sql=f"""
WITH {LENGTHS_SQL},
a AS (SELECT unnest({list(P.ALGOS)!r}) AS algo),
d AS (SELECT algo, n_tokens FROM lengths, a WHERE algo <> 'bestfit_pad' OR n_tokens <= {CAP})
SELECT algo, count(*) AS n_docs, count(*) AS n_placed, CAST(sum(n_tokens) AS BIGINT) AS consumed, CAST(0 AS BIGINT) AS rows_over,
       CAST(0 AS BIGINT) AS cropped_though_fitting, CAST(0 AS BIGINT) AS slots_missing
FROM d GROUP BY algo""")
def pack_invariants_q(spark, sf):
    """What any plan must satisfy: each document once, no row over its capacity, only the last document of a row cropped,
    or one longer than a row, slots without gaps."""
    plans = reduce(lambda a, b: a.unionByName(b), [plan(spark, sf, x).withColumn("algo", F.lit(x)) for x in P.ALGOS])
    rows = plans.groupBy("algo", "grp", "row_id").agg(
        F.sum("take").alias("taken"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.sum("n_tokens").alias("consumed"),
        F.count(F.when((F.col("take") < F.col("n_tokens")) & (F.col("n_tokens") <= CAP), 1)).alias("cropped"))
    bad = (F.col("cropped") > 1) | ((F.col("cropped") == 1) & (F.col("taken") < CAP))
    out = rows.groupBy("algo").agg(F.sum("n").alias("n_placed"), F.sum("consumed").alias("consumed"), F.count(F.when(F.col("taken") > CAP, 1)).alias("rows_over"),
                                   F.count(F.when(bad, 1)).alias("cropped_though_fitting"), F.sum(F.col("last") + 1 - F.col("n")).alias("slots_missing"))
    docs = plans.select("algo", "doc_id").distinct().groupBy("algo").agg(F.count(F.lit(1)).alias("n_docs"))
    return out.join(docs, "algo").select("algo", "n_docs", "n_placed", "consumed", "rows_over", "cropped_though_fitting", "slots_missing")


@register("pck02_bestfit_pad_rejects", sql=f"""
WITH {CORPUS_SQL}
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_tokens
FROM corpus_split WHERE octet_length(encode(text)) + 1 > {CAP}
""")
def pad_rejects(spark, sf):
    return P.pack_rejects(lengths(spark, sf), CAP).select("doc_id", "n_tokens")


@register("pck07_pack_report", sql="WITH plans AS (" + " UNION ALL ".join(f"SELECT '{a}' AS algo, * FROM ({PLAN_SQL[a]})" for a in P.ALGOS) + f"""),
a AS (SELECT algo, sum(take) AS kept, sum(n_tokens) AS consumed, count(*) AS n_docs, count(DISTINCT (grp, row_id)) AS n_rows FROM plans GROUP BY algo)
SELECT algo, n_rows, n_docs, round(kept * 100.0 / (n_rows * {CAP}), 6) AS util_pct, round((consumed - kept) * 100.0 / consumed, 6) AS crop_pct,
       round((n_rows * {CAP} - kept) * 100.0 / (n_rows * {CAP}), 6) AS pad_pct FROM a""")
def pack_report_q(spark, sf):
    plans = [plan(spark, sf, a).withColumn("algo", F.lit(a)) for a in P.ALGOS]
    return P.pack_report(reduce(lambda a, b: a.unionByName(b), plans), CAP, ["algo"])


@register("pck07_min_crop", sql=f"""
WITH {CORPUS_SQL}, d AS (SELECT octet_length(encode(text)) + 1 AS n FROM corpus_split)
SELECT CAST(sum(greatest(n - {CAP}, 0)) AS BIGINT) AS beyond, CAST(sum(n) AS BIGINT) AS total,
       round(sum(greatest(n - {CAP}, 0)) * 100.0 / sum(n), 6) AS min_crop_pct
FROM d
""")
def min_crop_q(spark, sf):
    return P.min_crop(lengths(spark, sf), CAP)


CONCAT_SQL = f"""{CORPUS_SQL},
d AS (SELECT doc_id, pos, text, octet_length(encode(text)) + 1 AS n FROM corpus_split),
p AS (SELECT *, CAST(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS off
       FROM d),
e AS (SELECT doc_id, text, n, off, unnest(range(off // {CAP}, (off + n - 1) // {CAP} + 1)) AS row_id FROM p),
plan AS (
  SELECT row_id, doc_id, text, off, greatest(off, row_id * {CAP}) - off AS start,
         least(off + n, (row_id + 1) * {CAP}) - greatest(off, row_id * {CAP}) AS take
  FROM e)"""


@register("pck06_concat_chunk", sql=f"""
WITH {CONCAT_SQL}
SELECT CAST(row_id AS BIGINT) AS row_id, doc_id, CAST(start AS BIGINT) AS start, CAST(take AS BIGINT) AS take FROM plan
""")
def concat_q(spark, sf):
    p = P.pack_concat(lengths(spark, sf), CAP, bucket=(F.col("pos") / 4096).cast("bigint"))
    return p.select("row_id", "doc_id", F.col("start").cast("bigint").alias("start"),
                    F.col("take").cast("bigint").alias("take"))


def concat_rows(spark, sf):
    """Packed rows with their tokens: plan joined back to token arrays (text never enters the plan)."""
    docs = corpus_split(spark, sf).select(
        "doc_id", "pos", F.concat(F.array(F.lit(BYTE_BOS)), byte_ids("text")).alias("ids"),
        (F.octet_length("text") + 1).cast("bigint").alias("n_tokens"))
    p = P.pack_concat(docs.select("doc_id", "pos", "n_tokens"), CAP, bucket=(F.col("pos") / 4096).cast("bigint"))
    j = p.join(docs.select("doc_id", "ids"), "doc_id")
    seg = F.slice("ids", (F.col("start") + 1).cast("int"), F.col("take").cast("int"))
    g = j.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("off", seg.alias("seg")))).alias("_s"))
    return g.select("row_id", F.flatten(F.transform("_s", lambda x: x["seg"])).alias("tokens"))


ROWS_SQL = f"""{CONCAT_SQL},
b AS (SELECT row_id, off, start, take, hex(encode(text)) AS h FROM plan),
seg AS (
  SELECT row_id, off,
         list_transform(range(start + 1, start + take + 1),
                        lambda k: CASE WHEN k = 1 THEN 256 ELSE CAST(('0x' || substr(h, 2 * (k - 1) - 1, 2)) AS INTEGER) END) AS s
  FROM b),
rows AS (SELECT row_id, flatten(list(s ORDER BY off)) AS t FROM seg GROUP BY row_id)"""


def _md5(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


@register("pck08_shift_targets", sql=f"""
WITH {ROWS_SQL}
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(len(t) AS BIGINT) AS n_tokens,
       md5(array_to_string(t[1:len(t) - 1], ',')) AS inputs_md5, md5(array_to_string(t[2:], ',')) AS targets_md5
FROM rows
""")
def shift_q(spark, sf):
    r = P.shift_targets(concat_rows(spark, sf))
    return r.select("row_id", F.size("tokens").cast("bigint").alias("n_tokens"), _md5("inputs").alias("inputs_md5"),
                    _md5("targets").alias("targets_md5"))


@register("pck10_doc_boundaries", sql=f"""
WITH {ROWS_SQL}
SELECT CAST(row_id AS BIGINT) AS row_id,
       array_to_string(list_filter(range(0, len(t)), lambda i: t[i + 1] = 256), ',') AS bos_positions
FROM rows
""")
def boundaries_q(spark, sf):
    r = P.doc_boundaries(concat_rows(spark, sf), bos=BYTE_BOS)
    return r.select("row_id", F.array_join(F.col("bos_positions").cast("array<string>"), ",").alias("bos_positions"))


@register("pck11_progress", sql=f"""
WITH {CONCAT_SQL},
r AS (SELECT row_id, count(*) FILTER (WHERE start = 0) AS docs FROM plan GROUP BY row_id),
c AS (SELECT row_id, sum(docs) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS consumed,
             (SELECT count(*) FROM d) AS size FROM r)
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(consumed AS BIGINT) AS consumed,
       round(least(1.0, consumed / size), 6) AS progress, consumed >= size AS last_step
FROM c
""")
def progress_q(spark, sf):
    ln = lengths(spark, sf)
    size = ln.agg(F.count(F.lit(1))).scalar()
    p = P.pack_concat(ln, CAP, bucket=(F.col("pos") / 4096).cast("bigint"))
    per_row = p.groupBy("row_id").agg(F.count(F.when(F.col("start") == 0, 1)).alias("new_docs"))
    pr = P.pack_progress(per_row, size, rows_per_task=4096)
    return pr.select("row_id", F.col("consumed").cast("bigint").alias("consumed"),
                     F.round("progress", 6).alias("progress"), "last_step")
