"""Training-log analytics: line classification, field parsing, per-run metrics.

Per-run ordered metrics (EMA, running min, throughput) use windows partitioned
by run. A run's log has one row per training step, so a partition is bounded
by the run length, not by the corpus size; the EMA uses a bounded frame
(beta^400 < 1e-18, far below double precision) so it never needs the whole
history of a step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import col
from tokenmill.functions.timefns import epoch_micros

# --- fixed values that must equal the reference ----------------------------------
GUARD_MARKER = "RUNPOD_GUARD_FAIL"
GUARD_RE = r"\bRUNPOD_GUARD_FAIL\b(.*)$"
LOSS_RE = r"(?i)\bloss:\s*([-+]?(?:nan|inf)\b|[-+0-9.eE]+)"
VAL_BPB_RE = r"(?i)\bValidation bpb:\s*([-+]?(?:nan|inf)\b|[-+0-9.eE]+)"
TRACEBACK_RE = r"(?i)Traceback \(most recent call last\)|ChildFailedError|RuntimeError:"
CUDA_ERROR_RE = r"(?i)CUDA error|device-side assert|out of memory|CUBLAS_STATUS|NCCL"
VALID_STATES = ["planned", "launched", "ssh_wait", "running", "recovering", "stopping", "stopped",
                "downloading", "downloaded", "terminating", "terminated", "failed"]
BACKWARD_OK = ["failed", "stopping", "stopped"]
# ---------------------------------------------------------------------------------

NONFINITE = ["nan", "inf", "+inf", "-inf"]
STOP_KINDS = ["guard_fail", "nonfinite_loss", "nonfinite_validation", "cuda_error", "traceback"]


def parse_fields(text: str | Column) -> Column:
    """LOG-02: ``k=v`` tokens -> MAP; tokens without '=' ignored, quotes stripped, last duplicate wins."""
    toks = F.filter(F.split(F.trim(col(text)), r"\s+"), lambda t: t.contains("="))
    kv = F.transform(toks, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"),
                                              F.regexp_replace(F.trim(F.regexp_extract(t, "^[^=]*=(.*)$", 1)),
                                                               '^"+|"+$', "").alias("v")))
    n = F.size(kv)
    later = lambda i: F.slice(kv, i + 2, F.greatest(n - i - 1, F.lit(0)))
    last = F.filter(kv, lambda e, i: ~F.exists(later(i), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def fields_text(m: Column) -> Column:
    """Canonical ``k=v`` text of a map (sorted by key) for display and comparison."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")


def classify_line(line: str | Column) -> Column:
    """LOG-01: (kind, reason) of a log line; null for normal lines.

    guard_fail > nonfinite_loss > nonfinite_validation > cuda_error > traceback.
    Deviation: ``-inf`` is detected as non-finite.
    """
    l_ = col(line)
    guard = l_.rlike(GUARD_RE)
    reason = F.coalesce(parse_fields(F.regexp_extract(l_, GUARD_RE, 1))["reason"], F.lit("guard_fail"))
    loss = F.lower(F.regexp_extract(l_, LOSS_RE, 1))
    val = F.lower(F.regexp_extract(l_, VAL_BPB_RE, 1))
    nf = [F.lit(x) for x in NONFINITE]
    kind = (F.when(guard, F.lit("guard_fail"))
             .when(loss.isin(*nf), F.lit("nonfinite_loss"))
             .when(val.isin(*nf), F.lit("nonfinite_validation"))
             .when(l_.rlike(CUDA_ERROR_RE), F.lit("cuda_error"))
             .when(l_.rlike(TRACEBACK_RE), F.lit("traceback")))
    why = (F.when(guard, reason)
            .when(loss.isin(*nf), F.concat(F.lit("loss_"), loss))
            .when(val.isin(*nf), F.concat(F.lit("validation_"), val))
            .when(l_.rlike(CUDA_ERROR_RE), F.lit("cuda_error"))
            .when(l_.rlike(TRACEBACK_RE), F.lit("traceback")))
    return F.struct(kind.alias("kind"), why.alias("reason"))


STEP_FIELDS = {
    "step": (r"^step (\d+)/", "bigint"),
    "total": (r"^step \d+/(\d+)", "bigint"),
    "pct": (r"\(([\d.]+)%\)", "double"),
    "raw_loss": (r"raw_loss: ([-\d.eE]+|nan|inf)", "double"),
    "loss": (r"\| loss: ([-\d.eE]+|nan|inf)", "double"),
    "lrm": (r"lrm: ([\d.]+)", "double"),
    "dt_ms": (r"dt: ([\d.]+)ms", "double"),
    "tok_per_sec": (r"tok/sec: ([\d,]+)", "bigint"),
    "mfu": (r"mfu: ([\d.]+)", "double"),
    "epoch": (r"epoch: (\d+)", "bigint"),
    "pq_idx": (r"pq: (\d+)", "bigint"),
    "rg_idx": (r"rg: (\d+)", "bigint"),
    "total_time_min": (r"total time: ([\d.]+)m", "double"),
    "eta_min": (r"eta: ([\d.]+)m", "double"),
}


def parse_step_line(df: DataFrame, line: str = "line") -> DataFrame:
    """LOG-03: typed columns from a training step line (null where a field is absent)."""
    out = df
    for name, (pat, typ) in STEP_FIELDS.items():
        raw = F.replace(F.regexp_extract(F.col(line), pat, 1), F.lit(","), F.lit(""))
        out = out.withColumn(name, F.when(raw == "", None).otherwise(raw).try_cast(typ))
    return out


def first_stop(df: DataFrame, run: str = "run", order: str = "line_no", line: str = "line") -> DataFrame:
    """LOG-04: first stop signal per run."""
    c = df.withColumn("_c", classify_line(line)).where(F.col("_c.kind").isin(*STOP_KINDS))
    return c.groupBy(run).agg(F.min_by(F.struct(F.col(order).alias("line_no"), F.col("_c.kind").alias("kind"),
                                                F.col("_c.reason").alias("reason")), F.col(order)).alias("s")) \
            .select(run, "s.line_no", "s.kind", "s.reason")


def parse_counts(df: DataFrame, keys: Sequence[str], run: str = "run", order: str = "line_no",
                 line: str = "line") -> DataFrame:
    """LOG-05 + AGG-16: last padded ``key : 1,234`` value per run and key; 0 when absent."""
    k = F.array(*[F.lit(x) for x in keys])
    e = df.select(run, order, line, F.explode(k).alias("key"))
    v = F.coalesce(*[F.when(F.col("key") == k, F.regexp_extract(F.col(line), "^" + k + r"\s+:\s*([\d,]+)", 1))
                     for k in keys])
    hits = e.withColumn("v", F.replace(v, F.lit(","), F.lit(""))).where(F.col("v") != "")
    last = hits.groupBy(run, "key").agg(F.max_by("v", order).cast("bigint").alias("value"))
    runs = df.select(run).distinct().select(run, F.explode(k).alias("key"))
    return runs.join(last, [run, "key"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("bigint"))


def extract_metrics(df: DataFrame, keys: Sequence[str], run: str = "run", order: str = "line_no",
                    line: str = "line") -> DataFrame:
    """LOG-06: substring key match; value = text between the first and second ':' (stripped); last wins."""
    k = F.array(*[F.lit(x) for x in keys])
    e = df.select(run, order, line, F.explode(k).alias("key")).where(F.col(line).contains(F.col("key")))
    e = e.withColumn("value", F.trim(F.coalesce(F.try_element_at(F.split(F.col(line), ":"), F.lit(2)), F.lit(""))))
    return e.groupBy(run, "key").agg(F.max_by("value", order).alias("value"))


def extract_timestamp(line: str | Column, prefix: str) -> Column:
    """LOG-07: timestamp after the first ':' of a line with ``prefix``; invalid -> null."""
    l_ = col(line)
    body = F.trim(F.regexp_extract(l_, "^[^:]*:(.*)$", 1))
    parsed = F.try_to_timestamp(body, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")  # wall clock as written
    return F.when(l_.startswith(prefix), parsed)


def log_tail(df: DataFrame, max_bytes: int, run: str = "run", order: str = "line_no", line: str = "line") -> DataFrame:
    """LOG-08: last lines of each run whose bytes (with newline) fit in ``max_bytes``.

    A tail of ``max_bytes`` bytes never has more than ``max_bytes`` lines, so a
    per-run top-``max_bytes`` (applied map side by Spark's group limit) bounds
    the work before the cumulative byte count.
    """
    w = Window.partitionBy(run).orderBy(F.desc(order))
    t = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_bytes)
    t = t.withColumn("_b", F.sum(F.octet_length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where(F.col("_b") <= max_bytes).drop("_rn", "_b")


def parse_model_tag(tag: str | Column) -> Column:
    """LOG-11: ``d12-grkan-g4`` -> (depth, type, groups); grkan defaults to 8 groups; mlp has none."""
    t = col(tag)
    depth = F.regexp_extract(t, r"^d(\d+)-", 1)
    typ = F.when(t.contains("-grkan"), F.lit("grkan")).when(t.contains("-mlp"), F.lit("mlp"))
    g = F.regexp_extract_all(t, F.lit(r"(?:^|-)g(\d+)(?=-|$)"), 1)
    groups = F.when(typ == "grkan", F.coalesce(F.try_element_at(g, F.lit(-1)).cast("int"), F.lit(8)))
    return F.struct(F.when(depth != "", depth.cast("int")).alias("depth"), typ.alias("type"), groups.alias("groups"))


def ema(df: DataFrame, value: str, beta: float = 0.9, run: str = "run", step: str = "step", extra: int = 0) -> DataFrame:
    """WIN-04: debiased EMA ``s = beta*s + (1-beta)*x``, ``/(1 - beta^(t+1+extra))``, over the whole history.

    Blocked prefix sums: inside a block of steps the recurrence is a running sum of ``beta^-offset * x``, whose
    factors stay below e^200; a block takes over the smoothed value at the end of the one before it. Of earlier
    blocks, the one four back weighs e^-800, which is 0 in double precision, so four terms are the whole carry.
    ``step`` must be 0-based dense and ``0 < beta < 1``.
    """
    size = max(1, int(200 / -math.log(beta)))
    at = F.col(step) % size
    b = df.withColumn("_b", F.floor(F.col(step) / size)).withColumn("_w", F.pow(F.lit(beta), -at) * F.col(value))
    w = Window.partitionBy(run, "_b").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_p", F.sum("_w").over(w))
    ends = b.groupBy(run, "_b").agg((F.sum("_w") * (1 - beta) * beta ** (size - 1)).alias("_e"))
    wb = Window.partitionBy(run).orderBy("_b")
    carry = sum((F.coalesce(F.lag("_e", k).over(wb), F.lit(0.0)) * (beta ** size) ** (k - 1) for k in (1, 2, 3, 4)), F.lit(0.0))
    out = b.join(ends.select(run, "_b", carry.alias("_c")), [run, "_b"])
    s = (1 - beta) * F.pow(F.lit(beta), at) * F.col("_p") + F.pow(F.lit(beta), at + 1) * F.col("_c")
    return out.withColumn("ema", s / (1 - F.pow(F.lit(beta), F.col(step) + 1 + extra))).drop("_b", "_w", "_p", "_c")


def running_min(df: DataFrame, value: str, run: str = "run", step: str = "step") -> DataFrame:
    """WIN-05: best (minimum) value so far per run."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_min", F.min(value).over(w))


def throughput(df: DataFrame, tokens_per_step: int, flops_per_token: float, peak_flops: float, skip: int = 10,
               run: str = "run", step: str = "step", ts: str = "ts", total: str = "total") -> DataFrame:
    """WIN-06: dt, tok/s, MFU, accumulated time (steps > skip), average step time and ETA."""
    w = Window.partitionBy(run).orderBy(step)
    secs = epoch_micros(F.col(ts)) / 1e6
    out = df.withColumn("dt", secs - F.lag(secs).over(w))
    out = out.withColumn("tok_per_sec", F.when(F.col("dt") > 0, F.lit(tokens_per_step) / F.col("dt")))
    out = out.withColumn("mfu", F.when(F.col("dt") > 0, 100.0 * flops_per_token * tokens_per_step
                                       / F.col("dt") / peak_flops))
    counted = F.when(F.col(step) > skip, F.coalesce(F.col("dt"), F.lit(0.0))).otherwise(0.0)
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("train_time", F.sum(counted).over(wr))
    n = F.greatest(F.col(step) - skip, F.lit(0))
    out = out.withColumn("avg_step", F.when(n > 0, F.col("train_time") / n))
    return out.withColumn("eta", (F.col(total) - F.col(step)) * F.col("avg_step"))


def every_n(df: DataFrame, n: int, run: str = "run", step: str = "step") -> DataFrame:
    """WIN-07: every n-th step plus the last one of each run."""
    last = F.max(step).over(Window.partitionBy(run))
    d = df.withColumn("_last", last)
    return d.where((F.col(step) % n == 0) | (F.col(step) == F.col("_last"))).drop("_last")


def state_violations(df: DataFrame, run: str = "run", order: Sequence[str] = ("ts",), state: str = "state") -> DataFrame:
    """WIN-09: transitions that move a run backwards (except into failed/stopping/stopped)."""
    idx = F.array_position(F.array(*[F.lit(s) for s in VALID_STATES]), F.col(state))
    w = Window.partitionBy(run).orderBy(*order)
    d = df.withColumn("_i", idx).withColumn("_p", F.lag("_i").over(w)).withColumn("prev_state", F.lag(state).over(w))
    bad = (F.col("_i") < F.col("_p")) & ~F.col(state).isin(*BACKWARD_OK)
    return d.withColumn("violation", F.coalesce(bad, F.lit(False))).drop("_i", "_p")


def metric_guards(df: DataFrame, value: str, max_value: float, max_minutes: float, run: str = "run",
                  step: str = "step", ts: str = "ts") -> DataFrame:
    """LOG-13: first guard violation per run (non-finite, value ceiling, runtime budget)."""
    start = F.min(ts).over(Window.partitionBy(run))
    mins = (epoch_micros(F.col(ts)) - epoch_micros(start)) / 6e7
    v = F.col(value)
    why = (F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit("nonfinite"))
            .when(v > max_value, F.lit("value_ceiling"))
            .when(mins > max_minutes, F.lit("runtime_budget")))
    g = df.withColumn("_why", why).where(F.col("_why").isNotNull())
    return g.groupBy(run).agg(F.min_by(F.struct(F.col(step).alias("step"), F.col("_why").alias("reason")), step)
                              .alias("g")).select(run, "g.step", "g.reason")


def heartbeat_gaps(df: DataFrame, minutes: float, run: str = "run", ts: str = "ts") -> DataFrame:
    """STR-03 (batch twin): lines followed by silence longer than ``minutes``."""
    w = Window.partitionBy(run).orderBy(ts)
    gap_us = epoch_micros(F.lead(ts).over(w)) - epoch_micros(F.col(ts))
    out = df.withColumn("_gap_us", gap_us).where(F.col("_gap_us") > int(minutes * 60_000_000))
    return out.withColumn("gap_sec", F.floor(F.col("_gap_us") / 1_000_000).cast("bigint")).drop("_gap_us")


def budget_exceeded(df: DataFrame, minutes: float, run: str = "run", ts: str = "ts", step: str = "step") -> DataFrame:
    """STR-04 (batch twin): first line of each run past the runtime budget."""
    start = F.min(ts).over(Window.partitionBy(run))
    el_us = epoch_micros(F.col(ts)) - epoch_micros(start)
    over = df.withColumn("_el_us", el_us).where(F.col("_el_us") > int(minutes * 60_000_000))
    over = over.withColumn("elapsed_sec", F.floor(F.col("_el_us") / 1_000_000).cast("bigint"))
    return over.groupBy(run).agg(F.min_by(F.struct(step, "elapsed_sec"), step).alias("f")) \
               .select(run, "f.*")


def wall_clock(start: Column, end: Column) -> Column:
    """AGG-17: ``XhYm`` between two timestamps, ``unknown`` when either is missing."""
    secs = ((epoch_micros(end) - epoch_micros(start)) / 1000000).cast("bigint")
    return F.when(start.isNull() | end.isNull(), F.lit("unknown")).otherwise(
        F.concat((secs / 3600).cast("bigint").cast("string"), F.lit("h"),
                 ((secs % 3600) / 60).cast("bigint").cast("string"), F.lit("m")))


def summary(metrics: DataFrame, stages: Sequence[str], metric: str = "metric", stage: str = "stage",
            value: str = "value", order: str = "value") -> DataFrame:
    """AGG-18: metric x stage table, missing -> '-', CORE first, ChatCORE last, others by name.

    Of several values of a cell the one with the largest ``order`` counts.
    """
    p = metrics.groupBy(metric).pivot(stage, list(stages)).agg(F.max_by(value, order))
    for s in stages:
        p = p.withColumn(s, F.coalesce(F.col(s).cast("string"), F.lit("-")))
    key = F.when(F.col(metric) == "CORE", 0).when(F.col(metric) == "ChatCORE", 2).otherwise(1)
    return p.withColumn("sort_key", key)
