"""Evaluation: few-shot prompts, scored spans, decisions and metrics.

Model outputs are inputs here (a score per token position); the count-based
scorer of :mod:`tokenmill.operators.scoring` supplies them. Groups that are
collected (the choices of one item, the shots of one item) are bounded by the
task definition (number of choices / shots), never by the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.hashing import hash_key, hash_unit
from tokenmill.functions.text import byte_ids, strip
from tokenmill.operators.ordering import checked_broadcast, hash_bucket, with_index
from tokenmill.operators.scoring import score_pairs
from tokenmill.operators.tokenizer import BYTE_BOS

# ----------------------------------------------------------------------------- few-shot selection


def fewshot(items: DataFrame, k: int, seed: int = 1234, key: str = "item_id", n_buckets: int = 64) -> DataFrame:
    """JN-02: for every item, ``k`` different other items (all others, if there are fewer), deterministic per seed.

    Items are laid out in a seeded permutation; every item draws its own distinct distances by hash, and the items that
    far ahead (cyclic) are its shots. O(n*k) rows via an equi-join on position.
    """
    it = with_index(items.select(key).withColumn("_h", hash_key(seed, key)), ["_h", key], name="_p",
                    bucket=hash_bucket("_h", n_buckets), n_buckets=n_buckets).drop("_h")
    d = it.withColumn("_n", it.agg(F.count(F.lit(1))).scalar())
    drawn = F.array().cast("array<bigint>")
    for j in range(k):  # a draw among what is left, moved past the distances that are taken
        d = d.withColumn(f"_r{j}", hash_key(f"{seed}/{j}", key) % F.greatest(F.col("_n") - 1 - j, F.lit(1)))
        free = F.aggregate(F.array_sort(drawn), F.col(f"_r{j}"), lambda acc, x: acc + (acc >= x).cast("bigint"))
        drawn = F.concat(drawn, F.array(free))
    drawn = F.slice(drawn, F.lit(1), F.greatest(F.least(F.col("_n") - 1, F.lit(k)), F.lit(0)).cast("int"))
    want = d.select(F.col(key).alias("item"), "_p", "_n", F.posexplode(drawn).alias("shot_rank", "_d"))
    want = want.withColumn("shot_rank", F.col("shot_rank") + 1).withColumn("_q", (F.col("_p") + 1 + F.col("_d")) % F.col("_n"))
    return want.join(it.select(F.col("_p").alias("_q"), F.col(key).alias("shot_id")), "_q") \
               .select(F.col("item").alias(key), F.col("shot_rank").cast("bigint").alias("shot_rank"), "shot_id")


def _shot_prefix(items: DataFrame, shots: DataFrame, shot_text: Column, key: str = "item_id") -> DataFrame:
    """Ordered concatenation of rendered shots per item: (key, prefix)."""
    s = items.select(F.col(key).alias("shot_id"), shot_text.alias("_t"))
    j = shots.join(s, "shot_id")
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("shot_rank", "_t"))).alias("_s"))
    g = g.select(key, F.array_join(F.transform("_s", lambda x: F.concat(x["_t"], F.lit("\n\n"))), "").alias("prefix"))
    return items.join(g, key, "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))


def prompts_mc(items: DataFrame, shots: DataFrame, delim: str = " ", key: str = "item_id") -> DataFrame:
    """EVL-01: one prompt per choice: shots ``query+delim+gold choice``, then ``query+delim+choice``."""
    shot_text = F.concat("query", F.lit(delim), F.element_at("choices", F.col("gold") + 1))
    p = _shot_prefix(items, shots, shot_text, key)
    e = p.select(key, "prefix", "query", "gold", F.posexplode("choices").alias("choice", "c"))
    return e.select(key, F.col("choice").cast("bigint").alias("choice"), "gold",
                    F.concat("prefix", "query", F.lit(delim), "c").alias("prompt"))


def prompts_schema(items: DataFrame, shots: DataFrame, delim: str = " ", key: str = "item_id") -> DataFrame:
    """EVL-02: one prompt per context option, shared continuation."""
    shot_text = F.concat(F.element_at("context_options", F.col("gold") + 1), F.lit(delim), "continuation")
    p = _shot_prefix(items, shots, shot_text, key)
    e = p.select(key, "prefix", "continuation", "gold", F.posexplode("context_options").alias("choice", "ctx"))
    return e.select(key, F.col("choice").cast("bigint").alias("choice"), "gold",
                    F.concat("prefix", "ctx", F.lit(delim), "continuation").alias("prompt"))


def prompts_lm(items: DataFrame, shots: DataFrame, delim: str = " ", key: str = "item_id") -> DataFrame:
    """EVL-03: prompt without (stripped) and with the continuation."""
    shot_text = F.concat(strip(F.col("context")), F.lit(delim), "continuation")
    p = _shot_prefix(items, shots, shot_text, key)
    base = F.concat("prefix", strip(F.col("context")), F.lit(delim))
    return p.select(key, strip(base).alias("prompt_without"), F.concat(base, "continuation").alias("prompt_with"))


# ----------------------------------------------------------------------------- spans


def with_tokens(df: DataFrame, prompt: str = "prompt", out: str = "tokens", bos: int = BYTE_BOS) -> DataFrame:
    """Byte tokens with BOS prepended."""
    return df.withColumn(out, F.concat(F.array(F.lit(bos)), byte_ids(prompt)))


def shared_ends(groups: pa.ListArray, reverse: bool) -> np.ndarray:
    """Length of the common prefix (or suffix) of the lists in each group; 0 for a group without lists.

    All lists of a batch are compared with the first of their group at once, on the flat values.
    """
    n = len(groups)
    count = pc.list_value_length(groups).to_numpy(zero_copy_only=False)
    lists = groups.flatten()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    low = np.cumsum(size) - size
    first = np.cumsum(count) - count
    group = np.repeat(np.arange(n), count)
    head = first[group] if len(group) else group
    length = np.minimum(size, size[head])
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)  # place from the left end, or from the right
    at = (lambda x: np.repeat((low + size - 1)[x], length) - step) if reverse else (lambda x: np.repeat(low[x], length) + step)
    differ = values[at(np.arange(len(size)))] != values[at(head)]
    same = length.copy()
    which = np.repeat(np.arange(len(size)), length)
    np.minimum.at(same, which[differ], step[differ])
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, group, same)
    out[count == 0] = 0
    return out


@F.arrow_udf(T.LongType())
def _common_prefix(groups: pa.Array) -> pa.Array:
    return pa.array(shared_ends(groups, False))


@F.arrow_udf(T.LongType())
def _common_suffix(groups: pa.Array) -> pa.Array:
    return pa.array(shared_ends(groups, True))


def common_length(df: DataFrame, by: Sequence[str], tokens: str = "tokens", side: str = "left") -> DataFrame:
    """EVL-04: common prefix (left) / suffix (right) length of the token arrays in a group (an item's few choices)."""
    g = df.groupBy(*by).agg(F.collect_list(tokens).alias("_a"))
    return g.select(*by, (_common_suffix if side == "right" else _common_prefix)("_a").alias("common_len"))


def scored_spans(tokens: DataFrame, kind: str, key: str = "item_id") -> DataFrame:
    """EVL-05: (start, end) of the scored span for mc / schema sequences.

    mc: after the common prefix; schema: the common suffix. The rows of an item are gathered once; its span is found on them and they are
    unfolded again, so the tokens are neither made nor shuffled twice.
    """
    cols = [c for c in tokens.columns if c != key]
    g = tokens.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("_r"))
    common = (_common_prefix if kind == "mc" else _common_suffix)(F.transform("_r", lambda r: r["tokens"]))
    j = g.withColumn("_c", common).select(key, "_c", F.inline("_r")).withColumn("end", F.size("tokens").cast("bigint"))
    start = F.col("_c") if kind == "mc" else F.col("end") - F.col("_c")
    return j.withColumn("start", start.cast("bigint")).select(key, *cols, "end", "start")


def spans_lm(lm: DataFrame) -> DataFrame:
    """EVL-05 (lm): span after the bare prompt, which must be a strict token prefix."""
    t = with_tokens(with_tokens(lm, "prompt_without", "t_without"), "prompt_with", "tokens")
    s = F.size("t_without")
    ok = (s < F.size("tokens")) & (F.slice("tokens", 1, s) == F.col("t_without"))
    return t.withColumn("start", s.cast("bigint")).withColumn("end", F.size("tokens").cast("bigint")) \
            .withColumn("prefix_ok", ok)


def left_crop(spans: DataFrame, max_tokens: int) -> DataFrame:
    """EVL-06: keep the last ``max_tokens`` tokens and shift the span; negative start is an error."""
    over = F.greatest(F.size("tokens") - max_tokens, F.lit(0))
    out = spans.withColumn("_c", over) \
               .withColumn("tokens", F.when(F.col("_c") > 0, F.slice("tokens", -max_tokens, max_tokens))
                           .otherwise(F.col("tokens"))) \
               .withColumn("start", F.col("start") - F.col("_c")).withColumn("end", F.col("end") - F.col("_c"))
    return out.withColumn("start", F.when(F.col("start") < 0, F.raise_error(F.lit("span cropped away")))
                          .otherwise(F.col("start"))).drop("_c")


# ----------------------------------------------------------------------------- scoring of spans


def span_losses(spans: DataFrame, model, argmax: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EVL-07: per target position i in [start, end): loss of tokens[i] given tokens[i-1] and argmax.

    The score at position i-1 belongs to token i (next-token alignment).
    """
    pos = F.sequence(F.col("start"), F.col("end") - 1)
    e = spans.where(F.col("end") > F.col("start")).select(*keys, F.explode(pos).alias("i"), "tokens")
    e = e.select(*keys, "i", F.element_at("tokens", F.col("i").cast("int")).alias("a"),
                 F.element_at("tokens", (F.col("i") + 1).cast("int")).alias("b"))
    sc = score_pairs(e, model)
    return sc.join(checked_broadcast(argmax, 300), "a", "left")


def decide_choice(losses: DataFrame, choices: DataFrame, key: str = "item_id") -> DataFrame:
    """EVL-08: lowest mean loss over the span wins (first on ties), compared with gold.

    ``choices`` has a row (key, choice, gold) for every choice of every item. A choice without losses (an empty
    span) loses against any that has some; an item without any is decided for its first choice. Means are rounded
    to 1e-9 so that mathematically equal choices (duplicate continuations) tie exactly whatever the summation order
    of the cluster.
    """
    m = losses.groupBy(key, "choice").agg(F.round(F.avg("loss"), 9).alias("mean_loss"))
    m = choices.select(key, "choice", "gold").join(m, [key, "choice"], "left")
    mean = F.coalesce("mean_loss", F.lit(float("inf"))).alias("mean")
    best = m.groupBy(key).agg(F.min_by("choice", F.struct(mean, "choice")).alias("pred"), F.max("gold").alias("gold"))
    return best.withColumn("correct", F.col("pred") == F.col("gold"))


def decide_lm(losses: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """EVL-09: correct when every argmax prediction in the span equals the actual token; an empty span is correct."""
    ok = losses.groupBy(key).agg(F.bool_and(F.coalesce(F.col("argmax_token") == F.col("b"), F.lit(False))).alias("_ok"))
    return items.select(key).join(ok, key, "left").select(key, F.coalesce("_ok", F.lit(True)).alias("correct"))


def decide_letter(scores: DataFrame, letters: DataFrame, key: str = "item_id") -> DataFrame:
    """EVL-10: argmax restricted to the item's letter tokens (ties: smaller token id).

    ``scores``: (key, token, logit) at the answer position; ``letters``:
    (key, letter, token). Letters must be single tokens (checked by caller).
    """
    j = scores.join(letters, [key, "token"])
    return j.groupBy(key).agg(F.max_by("letter", F.struct("logit", -F.col("token"))).alias("pred"))


def grade_numeric(ref: Column, resp: Column) -> Column:
    """EVL-11: extracted answers equal; null == null counts as equal (as the reference does)."""
    return ref.eqNullSafe(resp)


def topk_softmax(scores: DataFrame, by: Sequence[str], k: int, temperature: float, seed: int,
                 token: str = "token", logit: str = "logit") -> DataFrame:
    """EVL-12: sample one token per group from a top-k temperature softmax.

    T = 0 -> argmax; k = 0 -> all tokens. The draw is the inverse CDF of a
    hash uniform per group, so it is reproducible per seed.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(logit), token)
    r = scores.withColumn("_r", F.row_number().over(w))
    if temperature == 0:
        return r.where(F.col("_r") == 1).select(*by, F.col(token).alias("sampled"))
    if k > 0:
        r = r.where(F.col("_r") <= k)
    wg = Window.partitionBy(*by)
    r = r.withColumn("_e", F.exp((F.col(logit) - F.max(logit).over(wg)) / temperature))
    r = r.withColumn("_p", F.col("_e") / F.sum("_e").over(wg))
    r = r.withColumn("_c", F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_u", hash_unit(seed, *[F.col(b) for b in by]))
    # the last token stands in where rounding leaves the whole sum below the draw
    return r.groupBy(*by).agg(F.coalesce(F.min_by(F.when(F.col("_c") >= F.col("_u"), F.col(token)), F.when(F.col("_c") >= F.col("_u"), F.col("_r"))),
                                         F.max_by(token, "_r")).alias("sampled"))


def trim_completions(df: DataFrame, tokens: str, stop_ids: Sequence[int], out: str = "completion") -> DataFrame:
    """EVL-13: generated tokens up to (excluding) the first terminal token."""
    stops = F.array(*[F.lit(s) for s in stop_ids])
    first = F.array_min(F.filter(F.transform(F.col(tokens), lambda x, i: F.when(F.array_contains(stops, x), i)),
                                 lambda v: v.isNotNull()))
    return df.withColumn(out, F.when(first.isNull(), F.col(tokens)).otherwise(F.slice(tokens, 1, first)))


# ----------------------------------------------------------------------------- metrics


def accuracy(graded: DataFrame, by: Sequence[str] = ("task",), correct: str = "correct") -> DataFrame:
    """AGG-02: mean correctness per task (partial + final hash aggregate = the all-reduce)."""
    return graded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                   F.avg(F.col(correct).cast("double")).alias("accuracy"))


def centered(acc: Column, baseline: Column, percent: bool = True) -> Column:
    """AGG-03: (a - b) / (1 - b); CORE baselines are given in percent."""
    b = baseline * 0.01 if percent else baseline
    return (acc - b) / (1.0 - b)


def join_baselines(results: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    """JN-01: results with their random baseline; a missing baseline is an error."""
    j = results.join(baselines, task, "left")
    return j.withColumn("baseline", F.when(F.col("baseline").isNull(),
                                           F.raise_error(F.concat(F.lit("no baseline for task "), F.col(task))))
                        .otherwise(F.col("baseline")))


def core_metric(results: DataFrame) -> DataFrame:
    """AGG-04: mean centered accuracy over tasks."""
    return results.agg(F.avg("centered").alias("core"))


def chatcore(results: DataFrame, tasks: Sequence[str], baselines: dict[str, float]) -> DataFrame:
    """AGG-05: mean centered accuracy over a fixed task set, only when all are present."""
    b = F.create_map(*[x for t in tasks for x in (F.lit(t), F.lit(float(baselines.get(t, 0.0))))])
    r = results.where(F.col("task").isin(list(tasks))).withColumn("baseline", F.coalesce(b[F.col("task")], F.lit(0.0)))
    r = r.withColumn("centered", centered(F.col("accuracy"), F.col("baseline"), percent=False))
    return r.agg(F.when(F.countDistinct("task") == len(tasks), F.avg("centered")).alias("chatcore"))


def any_pass_rate(outcomes: DataFrame, problem: str = "problem", correct: str = "correct") -> DataFrame:
    """AGG-07: a problem passes when any sample passes; then the pass rate."""
    per = outcomes.groupBy(problem).agg(F.bool_or(correct).alias("passed"))
    return per.agg(F.count(F.lit(1)).alias("n_problems"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def pass_at_k(outcomes: DataFrame, n: int | None = None, problem: str = "problem", sample: str = "sample",
              correct: str = "correct") -> DataFrame:
    """AGG-08: pass@k for k = 1..n: share of problems with a correct sample among the first k; n defaults to all samples."""
    top = F.lit(n).cast("bigint") if n is not None else (outcomes.agg(F.max(sample)).scalar() + 1).cast("bigint")
    first = outcomes.groupBy(problem).agg(F.min(F.when(F.col(correct), F.col(sample))).alias("first_ok"))
    ks = first.select("first_ok", F.explode(F.sequence(F.lit(1).cast("bigint"), top)).alias("k"))
    return ks.groupBy("k").agg(F.avg(F.when(F.col("first_ok") < F.col("k"), 1.0).otherwise(0.0)).alias("pass_at_k"))


def advantages(rollouts: DataFrame, problem: str = "problem", reward: str = "reward") -> DataFrame:
    """AGG-09: r - mean(r) per problem (no std division)."""
    return rollouts.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(problem)))


def pg_objective(tokens: DataFrame, by: Sequence[str], logp: str = "logp", adv: str = "advantage",
                 target: str = "target") -> DataFrame:
    """AGG-10: sum(logp * adv over valid targets) / max(#valid, 1)."""
    valid = F.col(target) >= 0
    return tokens.groupBy(*by).agg(
        (F.sum(F.when(valid, F.col(logp) * F.col(adv)).otherwise(0.0))
         / F.greatest(F.count(F.when(valid, 1)), F.lit(1))).alias("pg_obj"))


def rollout_stats(rollouts: DataFrame, step: str = "step") -> DataFrame:
    """AGG-11: mean reward and mean sequence length per step."""
    return rollouts.groupBy(step).agg(F.avg("reward").alias("mean_reward"), F.avg("seq_len").alias("mean_seq_len"))
