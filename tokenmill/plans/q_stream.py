"""Streaming twins run to completion on files derived from the tables; oracles = their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.plans.catalog import ORACLES, register
from tokenmill.plans.derived import run_steps
from tokenmill.plans.q_conversation import assembled  # noqa: F401  (shared derivations)
from tokenmill.plans.q_logs import BUDGET_MIN, CLASSIFY_SQL, HEARTBEAT_MIN, RUN_LOG_SQL, RUN_STEPS_SQL, run_log
from tokenmill.plans.q_packing import PLAN_SQL
from tokenmill.session import cut_lineage, spread, table
from tokenmill.streaming import jobs as S

N_FILES = 4
LATE_HOURS = 24   # how late a line may come
FILES_A_BATCH = 4  # files of a micro-batch of the document stream


def _write_ranges(df, key: str, path: str, n: int = N_FILES, by: str | None = None) -> None:
    """Write ``n`` ranges of ``key`` one after another, each by as many tasks as it fills. The rows of a range that have the same ``by`` are in one
    file, so that they arrive in order of the ranges."""
    df = cut_lineage(df)  # read once for the limits and once for each range
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    width = (hi - lo) // n + 1
    for i in range(n):
        part = df.where((F.col(key) >= lo + i * width) & (F.col(key) < lo + (i + 1) * width))
        part.repartition(by or key).write.mode("append").parquet(path)


def _per_batch(spark, path: str, n: int = N_FILES) -> int:
    """Files of a micro-batch, so that there are about ``n`` of those however many files the ranges fill: a micro-batch costs a round of state
    commits, whatever it holds. Files come in the order of the ranges, so a run's lines still come in order."""
    return max(1, len(spark.read.parquet(path).inputFiles()) // n)


@register("str01_stream_corpus", sql="SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def stream_corpus_q(spark, sf):
    """Documents streamed file by file; a restart on the same checkpoint continues exactly (no dup, no loss)."""
    base = S.scratch(spark, "str01")
    src, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cut = lo + (hi - lo) * 3 // 4
    spread(docs).where(F.col("doc_id") <= cut).write.parquet(src)
    schema = docs.schema

    def run():
        st = S.stream_corpus(spark, src, schema, max_files=FILES_A_BATCH).select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"))
        S.run_to_completion(st.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck))

    run()                                                     # first session
    spread(docs).where(F.col("doc_id") > cut).write.mode("append").parquet(src)
    run()                                                     # restart: resumes from the checkpoint
    return spark.read.parquet(sink)


@register("str02_stream_stop_events")
def stream_stop_q(spark, sf):
    base = S.scratch(spark, "str02")
    _write_ranges(run_log(spark, sf).select("run", "line_no", "line"), "run", f"{base}/in")
    logs = spark.readStream.schema(S.LOG_SCHEMA).option("maxFilesPerTrigger", _per_batch(spark, f"{base}/in")).parquet(f"{base}/in")
    agg = S.stream_stop_events(logs)

    def snap(batch, epoch):  # complete mode: every batch carries the full result
        batch.write.mode("overwrite").parquet(f"{base}/out")
    S.run_to_completion(agg.writeStream.outputMode("complete").foreachBatch(snap)
                        .option("checkpointLocation", f"{base}/ck"))
    return spark.read.parquet(f"{base}/out").select("run", "s.line_no", "s.kind", "s.reason")


TAIL_BYTES = 8192


@register("str05_failure_records", sql=f"""
WITH {RUN_LOG_SQL}, {CLASSIFY_SQL},
stops AS (SELECT run, min(line_no) AS s FROM classified WHERE kind IS NOT NULL GROUP BY run),
t AS (SELECT c.run, c.line_no, c.line, s, sum(octet_length(encode(c.line)) + 1) OVER (PARTITION BY c.run ORDER BY c.line_no DESC ROWS UNBOUNDED PRECEDING) AS b
      FROM classified c JOIN stops ON c.run = stops.run AND c.line_no <= s),
tails AS (SELECT run, s, md5(string_agg(line, chr(10) ORDER BY line_no)) AS tail_md5 FROM t WHERE b <= {TAIL_BYTES} GROUP BY run, s)
SELECT c.run, c.line_no, c.kind, c.reason, tail_md5,
       CASE WHEN c.kind = 'guard_fail' THEN 'micro_step=' || regexp_extract(line, 'micro_step=(\\d+)', 1) || ' model_tag=' || regexp_extract(line, 'model_tag="(\\w+)"', 1)
            || ' reason=' || c.reason || ' step=' || regexp_extract(line, ' step=(\\d+)', 1) ELSE '' END AS fields
FROM classified c JOIN tails ON c.run = tails.run AND c.line_no = tails.s""")
def failure_records_q(spark, sf):
    base = S.scratch(spark, "str05")
    _write_ranges(run_log(spark, sf).select("run", "line_no", "line"), "line_no", f"{base}/in", by="run")  # a run's lines come in several batches
    logs = spark.readStream.schema(S.LOG_SCHEMA).option("maxFilesPerTrigger", _per_batch(spark, f"{base}/in")).parquet(f"{base}/in")
    S.run_to_completion(S.failure_records(logs, TAIL_BYTES).writeStream.format("json").option("path", f"{base}/out")
                        .option("checkpointLocation", f"{base}/ck"))
    r = spark.read.schema(S.FAILURE_OUT).json(f"{base}/out")
    return r.select("run", "line_no", "kind", "reason", F.md5("log_tail").alias("tail_md5"), F.coalesce("fields", F.lit("")).alias("fields"))


@register("str06_online_metrics", sql=f"""
WITH {RUN_STEPS_SQL}
SELECT a.run, a.step,
       round(sum(0.1 * pow(0.9, a.step - b.step) * b.metric) / (1 - pow(0.9, a.step + 1)), 6) AS ema,
       min(b.metric) AS running_min
FROM run_steps a JOIN run_steps b ON a.run = b.run AND b.step <= a.step
GROUP BY a.run, a.step""")
def online_metrics_q(spark, sf):
    base = S.scratch(spark, "str06")
    _write_ranges(run_steps(spark, sf).select("run", "step", "metric"), "step", f"{base}/in", by="run")
    m = spark.readStream.schema(S.METRIC_SCHEMA).option("maxFilesPerTrigger", _per_batch(spark, f"{base}/in")).parquet(f"{base}/in")
    out = S.online_metrics(m, beta=0.9)
    S.run_to_completion(out.writeStream.format("parquet").option("path", f"{base}/out")
                        .option("checkpointLocation", f"{base}/ck"))
    r = spark.read.parquet(f"{base}/out")
    return r.select("run", "step", F.round("ema", 6).alias("ema"), "running_min")


@register("str08_append_validated")
def append_validated_q(spark, sf):
    base = S.scratch(spark, "str08")
    _write_ranges(table(spark, sf, "conversations"), "conv_id", f"{base}/in")
    turns = spark.readStream.schema(S.CONV_SCHEMA).option("maxFilesPerTrigger", _per_batch(spark, f"{base}/in")).parquet(f"{base}/in")
    S.append_validated(turns, f"{base}/ok", f"{base}/bad", f"{base}/ck")
    ok = spark.read.parquet(f"{base}/ok").select("conv_id", F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(f"{base}/bad").select("conv_id", "reason")
    return ok.unionByName(bad)


# streaming twins share the oracle of their batch operator
def _share_oracles():
    from tokenmill.plans import q_conversation, q_logs  # noqa: F401
    ORACLES["str02_stream_stop_events"] = ORACLES["log04_first_stop"]
    ORACLES["str08_append_validated"] = ORACLES["flt08_validate_strict"]


_share_oracles()


@register("str07_stream_pack", sql=PLAN_SQL["bestfit_crop"])
def stream_pack_q(spark, sf):
    """Online best-fit crop per rank over a document-length stream (state = bounded buffer)."""
    from tokenmill.plans.q_packing import BUFFER, CAP, lengths
    base = S.scratch(spark, "str07")
    src = lengths(spark, sf).select("grp", F.col("pos").cast("bigint").alias("pos"), "doc_id", F.col("n_tokens").alias("n"),
                                    F.col("batch").cast("bigint").alias("bkey"))
    _write_ranges(src, "pos", f"{base}/in", by="grp")
    none = F.lit(None).cast("bigint")
    marks = src.groupBy("grp").agg((F.max("pos") + 1).alias("pos")).select("grp", "pos", none.alias("doc_id"), none.alias("n"), none.alias("bkey"))
    marks.write.mode("append").parquet(f"{base}/in")  # the end of each group
    docs = spark.readStream.schema(S.PACK_IN_SCHEMA).option("maxFilesPerTrigger", _per_batch(spark, f"{base}/in")).parquet(f"{base}/in")
    out = S.stream_pack(docs, CAP, BUFFER, crop=True)
    S.run_to_completion(out.writeStream.format("parquet").option("path", f"{base}/out")
                        .option("checkpointLocation", f"{base}/ck"))
    return spark.read.parquet(f"{base}/out")


def _watch(spark, sf):
    base = S.scratch(spark, "watch")
    from tokenmill.functions.timefns import epoch_micros
    lines = run_steps(spark, sf).select("run", "step", "ts").withColumn("_us", epoch_micros("ts"))
    _write_ranges(lines, "_us", f"{base}/in", by="run")  # a log arrives in time order
    schema = "run long, step long, ts timestamp_ntz, _us long"
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", _per_batch(spark, f"{base}/in")).parquet(f"{base}/in")
    out = S.watchdog(lines, HEARTBEAT_MIN, BUDGET_MIN, watermark=f"{LATE_HOURS} hours")
    S.run_to_completion(out.writeStream.format("parquet").option("path", f"{base}/out")
                        .option("checkpointLocation", f"{base}/ck"))
    return spark.read.parquet(f"{base}/out")


@register("str03_heartbeat_gaps_stream")
def heartbeat_stream_q(spark, sf):
    """Gaps between consecutive lines from the stateful watchdog (equals the batch twin)."""
    w = _watch(spark, sf)
    return w.where(F.col("kind") == "gap").select("run", "step", F.col("value_sec").alias("gap_sec"))


@register("str03_silent_runs", sql=f"""
WITH {RUN_STEPS_SQL},
last AS (SELECT run, max(step) AS step, max(ts) AS ts FROM run_steps GROUP BY run)
SELECT run, step FROM last WHERE epoch_ms(ts) + {int(HEARTBEAT_MIN * 60_000)} < (SELECT max(epoch_ms(ts)) FROM run_steps) - {LATE_HOURS * 3_600_000}""")
def silent_runs_q(spark, sf):
    """Runs that the timers of the watchdog report as silent and that no line has followed: those whose last line is older than the heartbeat
    limit when the watermark has passed all input. A timer that fired during a gap is undone by the gap's own row."""
    w = _watch(spark, sf)
    resumed = w.where(F.col("kind") == "gap").select("run", "step")
    return w.where(F.col("kind") == "silent").select("run", "step").join(resumed, ["run", "step"], "left_anti")


@register("str04_budget_exceeded_stream")
def budget_stream_q(spark, sf):
    w = _watch(spark, sf)
    return w.where(F.col("kind") == "budget").select("run", "step", F.col("value_sec").alias("elapsed_sec"))


def _share_watch_oracles():
    ORACLES["str03_heartbeat_gaps_stream"] = ORACLES["str03_heartbeat_gaps_batch"]
    ORACLES["str04_budget_exceeded_stream"] = ORACLES["str04_budget_exceeded_batch"]


_share_watch_oracles()
