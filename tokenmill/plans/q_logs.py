"""Run-log queries (LOG-*, WIN-04..10, AGG-13..18, STR-03/04 batch twins) on logs derived from `events`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenmill.functions.timefns import epoch_seconds
from tokenmill.operators import runlogs as RL
from tokenmill.operators.ordering import distinct_sorted, first_per_group
from tokenmill.operators.results import largest_run, mean_std
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import RUN_STEPS_SQL, run_steps
from tokenmill.session import cut_lineage, table

BETA = 0.9
MAX_VALUE = 45.0          # metric ceiling (LOG-13)
BUDGET_MIN = 40000.0      # runtime budget in minutes (LOG-13, STR-04)
HEARTBEAT_MIN = 1440.0    # silence that counts as a missing heartbeat (STR-03)
TAIL_BYTES = 2048         # LOG-08
COUNT_KEYS = ["wte", "lm_head", "total"]
METRIC_KEYS = ["Validation bpb", "tok/sec"]
STATE_OF = {"signup": "launched", "view": "running", "click": "recovering", "purchase": "stopped", "error": "failed"}


# ----------------------------------------------------------------------------- derived training log


_RUN_LOGS: dict = {}


def run_log(spark, sf):
    """One log line per event (stored once per session: every log query reads it)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUN_LOGS:
        _RUN_LOGS[key] = cut_lineage(_build_run_log(spark, sf))
    return _RUN_LOGS[key]


def _build_run_log(spark, sf):
    """Step lines, validation lines, parameter counts and stop lines derived from `events`."""
    s = run_steps(spark, sf)
    s = s.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("run")))
    v, step, total, eid = F.col("metric"), F.col("step"), F.col("total"), F.col("event_id")
    err = (F.when(v < 10, F.format_string("step %05d/%05d | loss: nan | lrm: 1.00", step, total))
            .when(v < 20, F.format_string("Step %05d | Validation bpb: inf", step))
            .when(v < 30, F.lit("RuntimeError: CUDA error: device-side assert triggered"))
            .when(v < 40, F.lit("Traceback (most recent call last):"))
            .otherwise(F.format_string('RUNPOD_GUARD_FAIL reason=nonfinite_loss step=%d micro_step=3 model_tag="d12"',
                                       step)))
    key = F.when(eid % 3 == 0, "wte").when(eid % 3 == 1, "lm_head").otherwise("total")
    count = F.format_string("%-24s: %s", key, F.format_number(F.round(v * 100).cast("bigint") * 1000, 0))
    val = F.format_string("Step %05d | Validation bpb: %.6f", step, v / 10)
    dt = eid % 900 + 100
    stepline = F.format_string(
        "step %05d/%05d (%d.00%%) | raw_loss: %.6f | loss: %.6f | lrm: 1.00 | dt: %d.00ms | tok/sec: %s | "
        "bf16_mfu: %d.00 | epoch: 1 pq: %d rg: %d | total time: %d.00m",
        step, total, F.expr("100 * step div total"), v, v, dt, F.format_number(F.expr("524288000 div (event_id % 900 + 100)"), 0),
        eid % 50, F.expr("step div 100"), step % 100, F.expr("step div 10"))
    line = (F.when(F.col("event_type") == "error", err).when(F.col("event_type") == "signup", count)
             .when(F.col("event_type") == "purchase", val).otherwise(stepline))
    return s.select("run", F.col("step").alias("line_no"), "step", "total", "ts", "event_type", "metric",
                    "event_id", line.alias("line"))


RUN_LOG_SQL = f"""{RUN_STEPS_SQL},
st AS (SELECT *, count(*) OVER (PARTITION BY run) AS total FROM run_steps),
run_log AS (
  SELECT run, step AS line_no, step, total, ts, event_type, metric, event_id,
    CASE
      WHEN event_type = 'error' THEN CASE
        WHEN metric < 10 THEN printf('step %05d/%05d | loss: nan | lrm: 1.00', step, total)
        WHEN metric < 20 THEN printf('Step %05d | Validation bpb: inf', step)
        WHEN metric < 30 THEN 'RuntimeError: CUDA error: device-side assert triggered'
        WHEN metric < 40 THEN 'Traceback (most recent call last):'
        ELSE printf('RUNPOD_GUARD_FAIL reason=nonfinite_loss step=%d micro_step=3 model_tag="d12"', step) END
      WHEN event_type = 'signup' THEN printf('%-24s: %s',
        CASE event_id % 3 WHEN 0 THEN 'wte' WHEN 1 THEN 'lm_head' ELSE 'total' END,
        format('{{:,}}', CAST(round(metric * 100) AS BIGINT) * 1000))
      WHEN event_type = 'purchase' THEN printf('Step %05d | Validation bpb: %.6f', step, metric / 10)
      ELSE printf('step %05d/%05d (%d.00%%) | raw_loss: %.6f | loss: %.6f | lrm: 1.00 | dt: %d.00ms | tok/sec: %s | '
                  || 'bf16_mfu: %d.00 | epoch: 1 pq: %d rg: %d | total time: %d.00m',
                  step, total, 100 * step // total, metric, metric, event_id % 900 + 100,
                  format('{{:,}}', 524288000 // (event_id % 900 + 100)), event_id % 50, step // 100, step % 100,
                  step // 10)
    END AS line
  FROM st)"""

LOSS_RE_SQL = RL.LOSS_RE.replace("'", "''")
VAL_RE_SQL = RL.VAL_BPB_RE.replace("'", "''")
CLASSIFY_SQL = f"""classified AS (
  SELECT *,
    CASE WHEN regexp_matches(line, '{RL.GUARD_RE}') THEN 'guard_fail'
         WHEN lower(regexp_extract(line, '{LOSS_RE_SQL}', 1)) IN ('nan', 'inf', '+inf', '-inf') THEN 'nonfinite_loss'
         WHEN lower(regexp_extract(line, '{VAL_RE_SQL}', 1)) IN ('nan', 'inf', '+inf', '-inf') THEN 'nonfinite_validation'
         WHEN regexp_matches(line, '{RL.CUDA_ERROR_RE}') THEN 'cuda_error'
         WHEN regexp_matches(line, '{RL.TRACEBACK_RE}') THEN 'traceback' END AS kind,
    CASE WHEN regexp_matches(line, '{RL.GUARD_RE}')
           THEN coalesce(nullif(regexp_replace(regexp_extract(line, '(?:^|\\s)reason=(\\S*)', 1), '^"+|"+$', '', 'g'), ''),
                         'guard_fail')
         WHEN lower(regexp_extract(line, '{LOSS_RE_SQL}', 1)) IN ('nan', 'inf', '+inf', '-inf')
           THEN 'loss_' || lower(regexp_extract(line, '{LOSS_RE_SQL}', 1))
         WHEN lower(regexp_extract(line, '{VAL_RE_SQL}', 1)) IN ('nan', 'inf', '+inf', '-inf')
           THEN 'validation_' || lower(regexp_extract(line, '{VAL_RE_SQL}', 1))
         WHEN regexp_matches(line, '{RL.CUDA_ERROR_RE}') THEN 'cuda_error'
         WHEN regexp_matches(line, '{RL.TRACEBACK_RE}') THEN 'traceback' END AS reason
  FROM run_log)"""


@register("log01_classify_lines", sql=f"""
WITH {RUN_LOG_SQL}, {CLASSIFY_SQL}
SELECT run, line_no, kind, reason FROM classified WHERE kind IS NOT NULL""")
def classify_q(spark, sf):
    c = run_log(spark, sf).withColumn("c", RL.classify_line("line"))
    return c.where(F.col("c.kind").isNotNull()).select("run", "line_no", "c.kind", "c.reason")


@register("log02_parse_fields", sql=f"""
WITH {RUN_LOG_SQL},
g AS (SELECT run, line_no, list_filter(string_split_regex(trim(regexp_extract(line, '{RL.GUARD_RE}', 1)), '\\s+'),
                                       lambda t: contains(t, '=')) AS toks
      FROM run_log WHERE regexp_matches(line, '{RL.GUARD_RE}')),
kv AS (SELECT run, line_no,
              list_transform(toks, lambda t: {{'k': split_part(t, '=', 1),
                 'v': regexp_replace(trim(regexp_extract(t, '^[^=]*=(.*)$', 1)), '^"+|"+$', '', 'g')}}) AS kv
       FROM g),
dd AS (SELECT run, line_no,
              list_filter(kv, lambda e, i: NOT list_contains(list_transform(kv[i + 1:], lambda y: y.k), e.k)) AS kv
       FROM kv)
SELECT run, line_no, array_to_string(list_sort(list_transform(kv, lambda e: e.k || '=' || e.v)), ' ') AS fields
FROM dd""")
def parse_fields_q(spark, sf):
    g = run_log(spark, sf).where(F.col("line").rlike(RL.GUARD_RE))
    m = RL.parse_fields(F.regexp_extract("line", RL.GUARD_RE, 1))
    return g.select("run", "line_no", RL.fields_text(m).alias("fields"))


STEP_COLS = ["step", "total", "pct", "raw_loss", "loss", "dt_ms", "tok_per_sec", "mfu", "pq_idx", "rg_idx",
             "total_time_min"]


@register("log03_parse_step_line", sql=f"""
WITH {RUN_LOG_SQL}
SELECT run, line_no,
  {", ".join(f"TRY_CAST(nullif(replace(regexp_extract(line, '{RL.STEP_FIELDS[c][0]}', 1), ',', ''), '') AS {RL.STEP_FIELDS[c][1].upper()}) AS {c}" for c in STEP_COLS)}
FROM run_log WHERE line LIKE 'step %(%'""")
def parse_step_q(spark, sf):
    lg = run_log(spark, sf).where(F.col("line").like("step %(%"))
    p = RL.parse_step_line(lg.select("run", "line_no", "line"))
    return p.select("run", "line_no", *STEP_COLS)


@register("log04_first_stop", sql=f"""
WITH {RUN_LOG_SQL}, {CLASSIFY_SQL}
SELECT run, min(line_no) AS line_no, arg_min(kind, line_no) AS kind, arg_min(reason, line_no) AS reason
FROM classified WHERE kind IS NOT NULL GROUP BY run""")
def first_stop_q(spark, sf):
    return RL.first_stop(run_log(spark, sf))


@register("log05_parse_counts", sql=f"""
WITH {RUN_LOG_SQL},
k AS (SELECT unnest(['wte', 'lm_head', 'total']) AS key),
hits AS (SELECT run, key, line_no, replace(regexp_extract(line, '^' || key || '\\s+:\\s*([\\d,]+)', 1), ',', '') AS v
         FROM run_log, k),
last AS (SELECT run, key, CAST(arg_max(v, line_no) AS BIGINT) AS value FROM hits WHERE v <> '' GROUP BY run, key)
SELECT r.run, k.key, CAST(coalesce(l.value, 0) AS BIGINT) AS value
FROM (SELECT DISTINCT run FROM run_log) r, k LEFT JOIN last l ON l.run = r.run AND l.key = k.key""")
def parse_counts_q(spark, sf):
    return RL.parse_counts(run_log(spark, sf), COUNT_KEYS)


@register("log06_extract_metrics", sql=f"""
WITH {RUN_LOG_SQL},
k AS (SELECT unnest(['Validation bpb', 'tok/sec']) AS key),
hits AS (SELECT run, key, line_no, trim(coalesce(string_split(line, ':')[2], '')) AS value
         FROM run_log, k WHERE contains(line, key))
SELECT run, key, arg_max(value, line_no) AS value FROM hits GROUP BY run, key""")
def extract_metrics_q(spark, sf):
    return RL.extract_metrics(run_log(spark, sf), METRIC_KEYS)


@register("log07_extract_timestamp", sql=f"""
WITH {RUN_STEPS_SQL},
l AS (SELECT run, step AS line_no,
             CASE WHEN event_type = 'error' THEN 'timestamp: n/a'
                  ELSE 'timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') END AS line
      FROM run_steps)
SELECT run, line_no,
       CAST(epoch(try_strptime(trim(regexp_extract(line, '^[^:]*:(.*)$', 1)), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS epoch_s
FROM l""")
def extract_timestamp_q(spark, sf):
    s = run_steps(spark, sf)
    line = F.when(F.col("event_type") == "error", F.lit("timestamp: n/a")).otherwise(
        F.concat(F.lit("timestamp: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    t = RL.extract_timestamp(line, "timestamp:")
    return s.select("run", F.col("step").alias("line_no"), epoch_seconds(t).alias("epoch_s"))


@register("log08_log_tail", sql=f"""
WITH {RUN_LOG_SQL},
t AS (SELECT run, line_no,
             sum(octet_length(encode(line)) + 1) OVER (PARTITION BY run ORDER BY line_no DESC
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b
      FROM run_log)
SELECT run, line_no FROM t WHERE b <= {TAIL_BYTES}""")
def log_tail_q(spark, sf):
    return RL.log_tail(run_log(spark, sf), TAIL_BYTES).select("run", "line_no")


TAG_SQL = """CASE run % 3 WHEN 0 THEN 'd' || (run % 20 + 4) || '-grkan-g' || (run % 5 * 4 + 4)
                        WHEN 1 THEN 'd' || (run % 20 + 4) || '-grkan' ELSE 'd' || (run % 20 + 4) || '-mlp' END"""


def tags(spark, sf):
    r = run_steps(spark, sf).groupBy("run").agg(F.max("ts").alias("mtime"), F.max("step").alias("last_step"))
    d = (F.col("run") % 20 + 4).cast("string")
    tag = (F.when(F.col("run") % 3 == 0, F.concat(F.lit("d"), d, F.lit("-grkan-g"), (F.col("run") % 5 * 4 + 4).cast("string")))
            .when(F.col("run") % 3 == 1, F.concat(F.lit("d"), d, F.lit("-grkan")))
            .otherwise(F.concat(F.lit("d"), d, F.lit("-mlp"))))
    return r.withColumn("tag", tag)


@register("log11_parse_model_tag", sql=f"""
WITH {RUN_STEPS_SQL}, t AS (SELECT DISTINCT run, {TAG_SQL} AS tag FROM run_steps)
SELECT run, tag, CAST(regexp_extract(tag, '^d(\\d+)-', 1) AS INTEGER) AS depth,
       CASE WHEN contains(tag, '-grkan') THEN 'grkan' WHEN contains(tag, '-mlp') THEN 'mlp' END AS type,
       CASE WHEN contains(tag, '-grkan') THEN coalesce(TRY_CAST(nullif(regexp_extract(tag, '-g(\\d+)$', 1), '') AS INTEGER), 8) END
         AS groups
FROM t""")
def model_tag_q(spark, sf):
    t = tags(spark, sf)
    return t.select("run", "tag", RL.parse_model_tag("tag").alias("m")).select("run", "tag", "m.depth", "m.type",
                                                                               "m.groups")


@register("win10_largest_run", sql=f"""
WITH {RUN_STEPS_SQL},
t AS (SELECT run, {TAG_SQL} AS tag, max(ts) AS mtime, max(step) AS last_step FROM run_steps GROUP BY run)
SELECT run, tag, last_step FROM t
ORDER BY CAST(regexp_extract(tag, '^d(\\d+)', 1) AS INTEGER) DESC, mtime DESC, run LIMIT 1""")
def largest_run_q(spark, sf):
    best = largest_run(tags(spark, sf), F.regexp_extract("tag", r"^d(\d+)", 1).cast("int"))
    return best.select("run", "tag", "last_step")


@register("log13_metric_guards", sql=f"""
WITH {RUN_STEPS_SQL},
g AS (SELECT run, step,
             CASE WHEN isnan(metric) OR isinf(metric) THEN 'nonfinite'
                  WHEN metric > {MAX_VALUE} THEN 'value_ceiling'
                  WHEN (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run)) / 6e7 > {BUDGET_MIN}
                    THEN 'runtime_budget' END AS reason
      FROM run_steps)
SELECT run, min(step) AS step, arg_min(reason, step) AS reason FROM g WHERE reason IS NOT NULL GROUP BY run""")
def metric_guards_q(spark, sf):
    return RL.metric_guards(run_steps(spark, sf), "metric", MAX_VALUE, BUDGET_MIN)


@register("win04_ema", sql=f"""
WITH {RUN_STEPS_SQL}
SELECT a.run, a.step,
       round(sum((1 - {BETA}) * pow({BETA}, a.step - b.step) * b.metric) / (1 - pow({BETA}, a.step + 1)), 6) AS ema
FROM run_steps a JOIN run_steps b ON a.run = b.run AND b.step <= a.step
GROUP BY a.run, a.step""")
def ema_q(spark, sf):
    e = RL.ema(run_steps(spark, sf), "metric", BETA)
    return e.select("run", "step", F.round("ema", 6).alias("ema"))


SLOW_BETA = 0.999


@register("win04_ema_slow", sql=f"""
WITH {RUN_STEPS_SQL}
SELECT a.run, a.step,
       round(sum((1 - {SLOW_BETA}) * pow({SLOW_BETA}, a.step - b.step) * b.metric) / (1 - pow({SLOW_BETA}, a.step + 1)), 6) AS ema
FROM run_steps a JOIN run_steps b ON a.run = b.run AND b.step <= a.step
GROUP BY a.run, a.step""")
def ema_slow_q(spark, sf):
    """A slow average: nearly all of the history counts."""
    e = RL.ema(run_steps(spark, sf), "metric", SLOW_BETA)
    return e.select("run", "step", F.round("ema", 6).alias("ema"))


@register("win05_running_min", sql=f"""
WITH {RUN_STEPS_SQL}
SELECT run, step, min(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS running_min
FROM run_steps""")
def running_min_q(spark, sf):
    return RL.running_min(run_steps(spark, sf), "metric").select("run", "step", "running_min")


@register("win06_throughput", sql=f"""
WITH {RUN_STEPS_SQL},
d AS (SELECT run, step, count(*) OVER (PARTITION BY run) AS total,
             epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY run ORDER BY step) AS dt
      FROM run_steps),
c AS (SELECT *, sum(CASE WHEN step > 10 THEN coalesce(dt, 0.0) ELSE 0.0 END)
                  OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS train_time
      FROM d)
SELECT run, step, round(dt, 6) AS dt, round(CASE WHEN dt > 0 THEN 524288 / dt END, 6) AS tok_per_sec,
       round(CASE WHEN dt > 0 THEN 100.0 * 6.0e8 * 524288 / dt / 1.0e15 END, 6) AS mfu,
       round(train_time, 6) AS train_time,
       round((total - step) * CASE WHEN step > 10 THEN train_time / (step - 10) END, 6) AS eta
FROM c""")
def throughput_q(spark, sf):
    s = run_steps(spark, sf).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("run")))
    t = RL.throughput(s, 524288, 6.0e8, 1.0e15)
    return t.select("run", "step", F.round("dt", 6).alias("dt"), F.round("tok_per_sec", 6).alias("tok_per_sec"), F.round("mfu", 6).alias("mfu"),
                    F.round("train_time", 6).alias("train_time"), F.round("eta", 6).alias("eta"))


@register("win07_every_n", sql=f"""
WITH {RUN_STEPS_SQL}
SELECT run, step FROM (SELECT run, step, max(step) OVER (PARTITION BY run) AS last FROM run_steps)
WHERE step % 10 = 0 OR step = last""")
def every_n_q(spark, sf):
    return RL.every_n(run_steps(spark, sf), 10).select("run", "step")


STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items()) + " END"


@register("win09_state_violations", sql=f"""
WITH {RUN_STEPS_SQL},
s AS (SELECT run, step, {STATE_SQL} AS state FROM run_steps),
i AS (SELECT *, list_position({RL.VALID_STATES!r}, state) AS idx,
             lag(list_position({RL.VALID_STATES!r}, state)) OVER (PARTITION BY run ORDER BY step) AS pidx,
             lag(state) OVER (PARTITION BY run ORDER BY step) AS prev_state
      FROM s)
SELECT run, step, state, prev_state FROM i WHERE idx < pidx AND state NOT IN ('failed', 'stopping', 'stopped')""")
def state_violations_q(spark, sf):
    m = F.create_map(*[x for k, v in STATE_OF.items() for x in (F.lit(k), F.lit(v))])
    s = run_steps(spark, sf).withColumn("state", m[F.col("event_type")])
    v = RL.state_violations(s, order=["step"])
    return v.where("violation").select("run", "step", "state", "prev_state")


@register("agg13_first_per_group", sql="""
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY user_id""")
def first_per_group_q(spark, sf):
    ev = table(spark, sf, "events")
    return first_per_group(ev, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@register("agg14_mean_std", sql="""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(max(value) - min(value), 6) AS spread
FROM events GROUP BY event_type""")
def mean_std_q(spark, sf):
    ev = table(spark, sf, "events")
    m = mean_std(ev, ["event_type"], "value")
    return m.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "spread")])


@register("agg15_distinct_sorted", sql="""
SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT user_id FROM events)""")
def distinct_sorted_q(spark, sf):
    return distinct_sorted(table(spark, sf, "events"), "user_id")


@register("agg16_last_match", sql=f"""
WITH {RUN_STEPS_SQL}
SELECT run, event_type, arg_max(metric, step) AS last_value FROM run_steps GROUP BY run, event_type""")
def last_match_q(spark, sf):
    s = run_steps(spark, sf)
    return s.groupBy("run", "event_type").agg(F.max_by("metric", "step").alias("last_value"))


@register("agg17_wall_clock", sql=f"""
WITH {RUN_STEPS_SQL},
b AS (SELECT run, min(ts) AS t0, max(ts) FILTER (WHERE event_type <> 'error') AS t1 FROM run_steps GROUP BY run),
s AS (SELECT run, t0, t1, CAST((epoch_us(t1) - epoch_us(t0)) // 1000000 AS BIGINT) AS secs FROM b)
SELECT run, CASE WHEN t0 IS NULL OR t1 IS NULL THEN 'unknown'
                 ELSE CAST(secs // 3600 AS VARCHAR) || 'h' || CAST((secs % 3600) // 60 AS VARCHAR) || 'm' END AS wall_clock
FROM s""")
def wall_clock_q(spark, sf):
    s = run_steps(spark, sf)
    b = s.groupBy("run").agg(F.min("ts").alias("t0"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("t1"))
    return b.select("run", RL.wall_clock(F.col("t0"), F.col("t1")).alias("wall_clock"))


STAGES = ["base", "sft", "rl"]


@register("agg18_summary", sql=f"""
WITH m AS (
  SELECT CASE event_type WHEN 'purchase' THEN 'CORE' WHEN 'signup' THEN 'ChatCORE' ELSE event_type END AS metric,
         CASE WHEN day(ts) <= 10 THEN 'base' WHEN day(ts) <= 20 THEN 'sft' ELSE 'rl' END AS stage,
         CAST(round(avg(value), 2) AS VARCHAR) AS value
  FROM events WHERE NOT (event_type = 'view' AND day(ts) > 20) GROUP BY 1, 2),
p AS (SELECT metric,
             coalesce(max(value) FILTER (WHERE stage = 'base'), '-') AS base,
             coalesce(max(value) FILTER (WHERE stage = 'sft'), '-') AS sft,
             coalesce(max(value) FILTER (WHERE stage = 'rl'), '-') AS rl
      FROM m GROUP BY metric)
SELECT *, CASE WHEN metric = 'CORE' THEN 0 WHEN metric = 'ChatCORE' THEN 2 ELSE 1 END AS sort_key FROM p""")
def summary_q(spark, sf):
    ev = table(spark, sf, "events").where(~((F.col("event_type") == "view") & (F.dayofmonth("ts") > 20)))
    metric = F.when(F.col("event_type") == "purchase", "CORE").when(F.col("event_type") == "signup", "ChatCORE") \
              .otherwise(F.col("event_type"))
    stage = F.when(F.dayofmonth("ts") <= 10, "base").when(F.dayofmonth("ts") <= 20, "sft").otherwise("rl")
    m = ev.groupBy(metric.alias("metric"), stage.alias("stage")).agg(
        F.round(F.avg("value"), 2).cast("string").alias("value"))
    return RL.summary(m, STAGES).select("metric", *STAGES, F.col("sort_key").cast("int").alias("sort_key"))


@register("str03_heartbeat_gaps_batch", sql=f"""
WITH {RUN_STEPS_SQL},
g AS (SELECT run, step, epoch_us(lead(ts) OVER (PARTITION BY run ORDER BY ts)) - epoch_us(ts) AS gap_us FROM run_steps)
SELECT run, step, CAST(gap_us // 1000000 AS BIGINT) AS gap_sec FROM g WHERE gap_us > {int(HEARTBEAT_MIN * 60_000_000)}""")
def heartbeat_q(spark, sf):
    return RL.heartbeat_gaps(run_steps(spark, sf), HEARTBEAT_MIN).select("run", "step", "gap_sec")


@register("str04_budget_exceeded_batch", sql=f"""
WITH {RUN_STEPS_SQL},
e AS (SELECT run, step, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run) AS el FROM run_steps)
SELECT run, min(step) AS step, CAST(arg_min(el, step) // 1000000 AS BIGINT) AS elapsed_sec
FROM e WHERE el > {int(BUDGET_MIN * 60_000_000)} GROUP BY run""")
def budget_q(spark, sf):
    return RL.budget_exceeded(run_steps(spark, sf), BUDGET_MIN).select("run", "step", "elapsed_sec")
