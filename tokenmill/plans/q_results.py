"""Rollout metrics (AGG-05..12) on `lineitem` and fits over result tables (FIT-*, JN-08/09/11, AGG-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.operators import evaluation as EV
from tokenmill.operators import fits as FT
from tokenmill.operators import results as RS
from tokenmill.operators.ordering import rank_by
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import CHAT_TASKS, ROLLOUTS_SQL, rollouts
from tokenmill.session import table

# fixed values of the ChatCORE definition: random-guess accuracy per task
CHAT_BASELINES = {"ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0,
                  "SpellingBee": 0.0}
CATEGORICAL = ["ARC-Easy", "ARC-Challenge", "MMLU"]
BASE_SQL = "CASE task " + " ".join(f"WHEN '{t}' THEN {b}" for t, b in CHAT_BASELINES.items()) + " END"


@register("agg07_any_pass_rate", sql=f"""
WITH {ROLLOUTS_SQL}, p AS (SELECT problem, bool_or(correct) AS passed FROM rollouts GROUP BY problem)
SELECT CAST(count(*) AS BIGINT) AS n_problems, round(avg(CAST(passed AS DOUBLE)), 6) AS pass_rate FROM p""")
def any_pass_q(spark, sf):
    r = EV.any_pass_rate(rollouts(spark, sf))
    return r.select("n_problems", F.round("pass_rate", 6).alias("pass_rate"))


@register("agg08_pass_at_k", sql=f"""
WITH {ROLLOUTS_SQL}, f AS (SELECT problem, min(sample) FILTER (WHERE correct) AS first_ok FROM rollouts GROUP BY problem),
k AS (SELECT unnest(range(1, (SELECT CAST(max(sample) AS BIGINT) FROM rollouts) + 2)) AS k)
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN first_ok < k THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k FROM f, k GROUP BY k""")
def pass_at_k_q(spark, sf):
    r = EV.pass_at_k(rollouts(spark, sf))
    return r.select(F.col("k").cast("bigint").alias("k"), F.round("pass_at_k", 6).alias("pass_at_k"))


@register("agg09_advantages", sql=f"""
WITH {ROLLOUTS_SQL}
SELECT problem, sample, round(reward - avg(reward) OVER (PARTITION BY problem), 6) AS advantage FROM rollouts""")
def advantages_q(spark, sf):
    a = EV.advantages(rollouts(spark, sf))
    return a.select("problem", "sample", F.round("advantage", 6).alias("advantage"))


@register("agg10_pg_objective", sql=f"""
WITH {ROLLOUTS_SQL}, a AS (SELECT *, reward - avg(reward) OVER (PARTITION BY problem) AS adv FROM rollouts)
SELECT step, round(sum(CASE WHEN target >= 0 THEN logp * adv ELSE 0.0 END)
                   / greatest(count(*) FILTER (WHERE target >= 0), 1), 6) AS pg_obj
FROM a GROUP BY step""")
def pg_objective_q(spark, sf):
    a = EV.advantages(rollouts(spark, sf))
    return EV.pg_objective(a, ["step"]).select("step", F.round("pg_obj", 6).alias("pg_obj"))


@register("agg11_rollout_stats", sql=f"""
WITH {ROLLOUTS_SQL}
SELECT step, round(avg(reward), 6) AS mean_reward, round(avg(seq_len), 6) AS mean_seq_len FROM rollouts GROUP BY step""")
def rollout_stats_q(spark, sf):
    r = EV.rollout_stats(rollouts(spark, sf))
    return r.select("step", F.round("mean_reward", 6).alias("mean_reward"), F.round("mean_seq_len", 6).alias("mean_seq_len"))


@register("agg12_accuracy_by_subject", sql=f"""
WITH {ROLLOUTS_SQL}
SELECT task, subject, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy
FROM rollouts GROUP BY ROLLUP (task, subject)""")
def accuracy_by_subject_q(spark, sf):
    r = rollouts(spark, sf)
    g = r.rollup("task", "subject").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("a"))
    return g.select("task", "subject", "n", F.round("a", 6).alias("accuracy"))


def chat_results(spark, sf):
    return EV.accuracy(rollouts(spark, sf), ["task"])


@register("agg05_chatcore", sql=f"""
WITH {ROLLOUTS_SQL}, r AS (SELECT task, avg(CAST(correct AS DOUBLE)) AS acc FROM rollouts GROUP BY task),
c AS (SELECT task, (acc - {BASE_SQL}) / (1.0 - {BASE_SQL}) AS centered FROM r WHERE task IN {tuple(CHAT_TASKS)!r})
SELECT round(CASE WHEN count(DISTINCT task) = 6 THEN avg(centered) END, 6) AS chatcore FROM c""")
def chatcore_q(spark, sf):
    return EV.chatcore(chat_results(spark, sf), CHAT_TASKS, CHAT_BASELINES).select(F.round("chatcore", 6).alias("chatcore"))


@register("agg06_chatcore_categorical", sql=f"""
WITH {ROLLOUTS_SQL}, r AS (SELECT task, avg(CAST(correct AS DOUBLE)) AS acc FROM rollouts GROUP BY task),
c AS (SELECT task, (acc - {BASE_SQL}) / (1.0 - {BASE_SQL}) AS centered FROM r WHERE task IN {tuple(CATEGORICAL)!r})
SELECT round(CASE WHEN count(DISTINCT task) = 3 THEN avg(centered) END, 6) AS chatcore_cat FROM c""")
def chatcore_cat_q(spark, sf):
    c = EV.chatcore(chat_results(spark, sf), CATEGORICAL, CHAT_BASELINES)
    return c.select(F.round("chatcore", 6).alias("chatcore_cat"))


# ----------------------------------------------------------------------------- fits on `part` / `orders`


def _r(c, d=6):
    return F.round(c, d).alias(c)


@register("fit01_linreg", sql="""
SELECT p_brand, CAST(count(*) AS BIGINT) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope,
       round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2
FROM part GROUP BY p_brand""")
def linreg_q(spark, sf):
    r = FT.linreg(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"])
    return r.select("p_brand", "n", _r("slope"), _r("intercept"), _r("r2"))


FEATURES = ["p_size", "p_partkey", "name_len"]


@register("fit02_linreg_each", sql="""
WITH d AS (SELECT p_retailprice AS y, p_size AS f1, p_partkey AS f2, length(p_name) AS f3 FROM part),
l AS (SELECT 'p_size' AS feature, f1 AS x, y FROM d UNION ALL SELECT 'p_partkey', f2, y FROM d
      UNION ALL SELECT 'name_len', f3, y FROM d),
r AS (SELECT feature, regr_r2(y, x) AS r2, regr_slope(y, x) AS slope FROM l GROUP BY feature)
SELECT feature, round(r2, 6) AS r2, round(slope, 6) AS slope, CAST(rank() OVER (ORDER BY r2 DESC) AS BIGINT) AS rank FROM r""")
def linreg_each_q(spark, sf):
    p = table(spark, sf, "part").withColumn("name_len", F.char_length("p_name"))
    r = FT.linreg_each(p, FEATURES, "p_retailprice")
    return r.select("feature", _r("r2"), _r("slope"), "rank")


@register("fit03_ridge", sql="""
WITH p AS (SELECT CAST(p_size AS DOUBLE) AS u, CAST(length(p_name) AS DOUBLE) AS v, p_retailprice AS y FROM part),
s AS (SELECT count(*) * 1.0 AS n, sum(u) AS u, sum(v) AS v, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(y) AS y, sum(u * y) AS uy,
             sum(v * y) AS vy, sum(y * y) AS yy FROM p),
g AS (SELECT s.*, a AS alpha, uu + a AS pu, vv + a AS pv FROM s, (SELECT unnest([0.0, 1.0, 100.0]::DOUBLE[]) AS a)),
d AS (SELECT *, n * (pu * pv - uv * uv) - u * (u * pv - uv * v) + v * (u * uv - pu * v) AS det FROM g),
w AS (SELECT *, (y * (pu * pv - uv * uv) - u * (uy * pv - uv * vy) + v * (uy * uv - pu * vy)) / det AS w0,
             (n * (uy * pv - uv * vy) - y * (u * pv - uv * v) + v * (u * vy - uy * v)) / det AS w1,
             (n * (pu * vy - uy * uv) - u * (u * vy - uy * v) + y * (u * uv - pu * v)) / det AS w2 FROM d)
SELECT alpha, round(w0, 6) AS intercept, round(w1, 6) AS coef_p_size, round(w2, 6) AS coef_name_len, round(sqrt(w1 * w1 + w2 * w2), 6) AS weight_norm,
       round(1 - (yy - 2 * (w0 * y + w1 * uy + w2 * vy)
                  + w0 * (n * w0 + u * w1 + v * w2) + w1 * (u * w0 + uu * w1 + uv * w2) + w2 * (v * w0 + uv * w1 + vv * w2)) / (yy - y * y / n), 6) AS r2
FROM w""")
def ridge_q(spark, sf):
    p = table(spark, sf, "part").withColumn("name_len", F.char_length("p_name"))
    r = FT.ridge_df(spark, FT.ridge(p, ["p_size", "name_len"], "p_retailprice", [0.0, 1.0, 100.0]),
                    ["p_size", "name_len"])
    return r.select("alpha", *[_r(c) for c in r.columns[1:]])


@register("fit04_isoflop_fit", sql="""
WITH d AS (SELECT p_brand, p_size AS x, p_retailprice AS y, log10(p_size) AS u FROM part),
m AS (SELECT p_brand, avg(u) AS m FROM d GROUP BY p_brand),
z AS (SELECT d.*, u - m.m AS z, m.m FROM d JOIN m USING (p_brand)),
s AS (SELECT p_brand, count(*) * 1.0 AS s0, sum(z) AS s1, sum(z ^ 2) AS s2, sum(z ^ 3) AS s3, sum(z ^ 4) AS s4,
             sum(y) AS t0, sum(z * y) AS t1, sum(z ^ 2 * y) AS t2, any_value(m) AS m,
             arg_min(x, (y, x)) AS raw_opt
      FROM z GROUP BY p_brand),
det AS (SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS dd FROM s),
abc AS (SELECT p_brand, m, raw_opt,
               (t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / dd AS a,
               (s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / dd AS bz,
               (s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / dd AS cz
        FROM det),
f AS (SELECT p_brand, a, bz - 2 * a * m AS b, a * m * m - bz * m + cz AS c, raw_opt FROM abc)
SELECT p_brand, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c,
       round(CASE WHEN a > 0 THEN pow(10.0, -b / (2 * a)) ELSE raw_opt END, 4) AS opt_x
FROM f""")
def isoflop_q(spark, sf):
    f = FT.isoflop_fit(table(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice")
    return f.select("p_brand", _r("a", 4), _r("b", 4), _r("c", 4), F.round(F.col("opt_x").cast("double"), 4).alias("opt_x"))


@register("fit05_power_law", sql="""
SELECT o_orderpriority, round(regr_slope(log10(o_totalprice), log10(o_custkey)), 6) AS exponent,
       round(regr_intercept(log10(o_totalprice), log10(o_custkey)), 6) AS log_coef
FROM orders WHERE o_totalprice > 0 AND o_custkey > 0 GROUP BY o_orderpriority""")
def power_law_q(spark, sf):
    p = FT.power_law(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderpriority"])
    return p.select("o_orderpriority", _r("exponent"), _r("log_coef"))


@register("fit06_ratio_at_reference", sql="""
WITH p AS (SELECT o_orderpriority, regr_slope(log10(o_totalprice), log10(o_custkey)) AS e,
                  regr_intercept(log10(o_totalprice), log10(o_custkey)) AS c, min(o_custkey) AS lo, max(o_custkey) AS hi
           FROM orders WHERE o_totalprice > 0 AND o_custkey > 0 GROUP BY o_orderpriority)
SELECT o_orderpriority, round(sqrt(lo * hi), 4) AS x_ref, round(pow(10.0, c + e * log10(sqrt(lo * hi))), 4) AS y_ref FROM p""")
def ratio_q(spark, sf):
    p = FT.ratio_at_reference(FT.power_law(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderpriority"]))
    return p.select("o_orderpriority", _r("x_ref", 4), _r("y_ref", 4))


@register("fit07_apply_models", sql="""
WITH m AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS s1, regr_intercept(p_retailprice, p_size) AS i1 FROM part
           GROUP BY p_brand),
g AS (SELECT regr_slope(p_retailprice, p_size) AS s2, regr_intercept(p_retailprice, p_size) AS i2 FROM part)
SELECT p_partkey, round(i1 + s1 * p_size, 4) AS pred_brand, round(i2 + s2 * p_size, 4) AS pred_global,
       round(((i1 + s1 * p_size) + (i2 + s2 * p_size)) / 2, 4) AS ensemble
FROM part JOIN m USING (p_brand), g""")
def apply_models_q(spark, sf):
    part = table(spark, sf, "part")
    brand = FT.linreg(part, "p_size", "p_retailprice", ["p_brand"]).select("p_brand", "slope", "intercept")
    whole = FT.linreg(part, "p_size", "p_retailprice", [])
    slope, intercept = whole.select("slope").scalar(), whole.select("intercept").scalar()
    j = FT.apply_models(part, brand, "p_size", "p_brand").withColumn("pred_global", intercept + slope * F.col("p_size"))
    return j.select("p_partkey", F.round("pred", 4).alias("pred_brand"), _r("pred_global", 4),
                    F.round((F.col("pred") + F.col("pred_global")) / 2, 4).alias("ensemble"))


@register("fit08_row_mean", sql="""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding), 6) AS mean
FROM embeddings""")
def row_mean_q(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(FT.row_mean("embedding"), 6).alias("mean"))


@register("srt02_rank_by", sql="""
WITH r AS (SELECT p_brand, regr_r2(p_retailprice, p_size) AS r2 FROM part GROUP BY p_brand)
SELECT p_brand, round(r2, 6) AS r2, CAST(rank() OVER (ORDER BY r2 DESC) AS BIGINT) AS rank FROM r""")
def rank_by_q(spark, sf):
    r = FT.linreg(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"])
    return rank_by(r, "r2").select("p_brand", _r("r2"), "rank")


@register("win08_argmin_row", sql="""
SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS min_price
FROM part GROUP BY p_brand""")
def argmin_row_q(spark, sf):
    p = table(spark, sf, "part")
    return RS.argmin_row(p, ["p_brand"], "p_retailprice", "p_partkey").withColumnRenamed("least", "min_price")


def _priority_tables(spark, sf):
    o = table(spark, sf, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("task"),
                  F.when(F.col("o_orderstatus") == "F", 0).otherwise(5).alias("shots")).agg(F.avg("o_totalprice").alias("acc"))
    b = o.groupBy(F.col("o_orderpriority").alias("task"),
                  F.when(F.month("o_orderdate") <= 6, 0).otherwise(10).alias("shots")).agg(F.avg("o_totalprice").alias("acc"))
    return a, b


@register("jn08_comparable_tasks", sql="""
WITH a AS (SELECT o_orderpriority AS task, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 5 END AS shots, avg(o_totalprice) AS acc
           FROM orders GROUP BY 1, 2),
b AS (SELECT o_orderpriority AS task, CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 10 END AS shots, avg(o_totalprice) AS acc
      FROM orders GROUP BY 1, 2)
SELECT a.task, a.shots AS shots_a, b.shots AS shots_b, round(a.acc, 4) AS acc_a, round(b.acc, 4) AS acc_b
FROM a JOIN b ON a.task = b.task AND (a.shots = 0) = (b.shots = 0)""")
def comparable_q(spark, sf):
    a, b = _priority_tables(spark, sf)
    j = RS.comparable_tasks(a, b)
    return j.select("task", "shots_a", "shots_b", _r("acc_a", 4), _r("acc_b", 4))


@register("jn09_head_to_head", sql="""
WITH a AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS va FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS vb FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, round(vb - va, 4) AS delta, round((vb - va) / va * 100, 4) AS improvement_pct FROM a JOIN b USING (k)""")
def head_to_head_q(spark, sf):
    o = table(spark, sf, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("v"))
    return RS.head_to_head(of("F"), of("O"), "k", "v").select("k", _r("delta", 4), _r("improvement_pct", 4))


@register("jn11_interp", sql="""
WITH pts AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1, 2),
q AS (SELECT DISTINCT p_brand, p_size + 0.5 AS x FROM part UNION SELECT DISTINCT p_brand, 0.0 FROM part),
lo AS (SELECT q.p_brand, q.x, p.x AS lx, p.y AS ly FROM q ASOF LEFT JOIN pts p ON q.p_brand = p.p_brand AND q.x >= p.x),
hi AS (SELECT q.p_brand, q.x, p.x AS hx, p.y AS hy FROM q ASOF LEFT JOIN pts p ON q.p_brand = p.p_brand AND q.x <= p.x)
SELECT p_brand, x, round(CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly WHEN hx = lx THEN ly
                              ELSE ly + (x - lx) / (hx - lx) * (hy - ly) END, 6) AS y_interp
FROM lo JOIN hi USING (p_brand, x)""")
def interp_q(spark, sf):
    p = table(spark, sf, "part")
    pts = p.groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    xs = p.select("p_brand", (F.col("p_size") + 0.5).alias("x")).unionByName(
        p.select("p_brand", F.lit(0.0).alias("x"))).distinct()
    r = FT.interp(pts, xs, ["p_brand"])
    return r.select("p_brand", "x", F.round("y_interp", 6).alias("y_interp"))


@register("agg21_effective_params", sql="""
WITH s AS (SELECT p_partkey, p_size * 1000 AS params_transformer, p_partkey * 10 AS params_lm_head,
                  CAST(round(p_retailprice * 100) AS BIGINT) * 1000 AS tokens_trained FROM part)
SELECT p_partkey, CAST(params_transformer + params_lm_head AS BIGINT) AS effective_params,
       round(tokens_trained / (params_transformer + params_lm_head), 6) AS tokens_per_param FROM s""")
def effective_params_q(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 1000).cast("bigint").alias("params_transformer"),
        (F.col("p_partkey") * 10).cast("bigint").alias("params_lm_head"),
        (F.round(F.col("p_retailprice") * 100).cast("bigint") * 1000).alias("tokens_trained"))
    e = FT.effective_params(p, FT.default_effective)
    return e.select("p_partkey", F.col("effective_params").cast("bigint").alias("effective_params"),
                    F.round("tokens_per_param", 6).alias("tokens_per_param"))
