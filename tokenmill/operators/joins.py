"""Join operators (JN-04/05/07) and run verification (LOG-12)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grade_choice(pred: DataFrame, gold: DataFrame, key: str = "item_id", domain: str | None = None) -> DataFrame:
    """JN-04: prediction joined with gold; optional answer-domain check (prediction must be a valid letter)."""
    j = pred.join(gold, key)
    ok = F.col("pred") == F.col("gold")
    if domain:
        ok = ok & F.array_contains(F.col(domain), F.col("pred"))
    return j.withColumn("correct", ok)


#: Rules whose automaton is in a task's memory at once; more go in blocks.
RULES_A_PASS = 20_000


def _matcher(rules: list[tuple], names: list[str]):
    """Column function: (priority, value) of the first rule whose substrings all occur; ``rules`` are (substrings, priority, value) in order."""
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, holders = ahocorasick.Automaton(), defaultdict(list)
        for k, (subs, _, _) in enumerate(rules):
            for word in subs:
                holders[word].append(k)
        for word in holders:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            out = []
            for text in texts:
                found, best = [0] * len(rules), len(rules)
                for word in {w for _, w in automaton.iter(text)}:
                    for k in holders[word]:
                        found[k] += 1
                        if k < best and found[k] == len(rules[k][0]):
                            best = k
                out.append(rules[best][1:] if best < len(rules) else (None, None))
            yield pd.DataFrame(out, columns=names)

    return matched


def first_match(df: DataFrame, text: str, patterns: DataFrame, default: float, key: str = "id", rules_a_pass: int = RULES_A_PASS) -> DataFrame:
    """JN-05: ordered rules ``(priority, substrings ARRAY<STRING>, value)``: the first rule whose
    substrings all occur in ``text`` (any case) gives the value, else ``default``. Of rules with the same priority the least value counts.

    A task goes over each text once, with an Aho-Corasick automaton of all substrings; no row is moved or multiplied. The rules are a
    table of parameters: they come to the driver in blocks of ``rules_a_pass``. Rules without substrings match every text, so the first of them is
    a literal; a null list, or a null in it, matches none. A null text is empty. ``key`` is not used: every row gets its own value.
    """
    filed = patterns.where(F.col("substrings").isNotNull() & ~F.exists("substrings", lambda x: x.isNull())).select(
        F.array_distinct(F.filter(F.transform("substrings", F.lower), lambda x: x != "")).alias("subs"), "priority", "value")
    always = filed.where(F.size("subs") == 0).orderBy("priority", "value").limit(1).collect()
    some = filed.where(F.size("subs") > 0)
    blocks = -(-some.count() // rules_a_pass)
    kind = T.StructType([filed.schema["priority"], filed.schema["value"]])
    best = F.lit(None).cast(kind)
    if always:
        best = F.struct(F.lit(always[0]["priority"]).cast(kind[0].dataType).alias("priority"), F.lit(always[0]["value"]).cast(kind[1].dataType).alias("value"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    for b in range(blocks):
        mine = some.where(F.pmod(F.xxhash64("subs"), F.lit(blocks)) == b).orderBy("priority", "value").collect() if blocks > 1 else some.orderBy("priority", "value").collect()
        rules = [(r["subs"], r["priority"], r["value"]) for r in mine]
        found = F.pandas_udf(_matcher(rules, kind.names), kind)(low)
        sooner = F.col("_m.priority").isNotNull() & (F.col("_b").isNull() | (F.col("_m.priority") < F.col("_b.priority"))
                                                     | ((F.col("_m.priority") == F.col("_b.priority")) & (F.col("_m.value") < F.col("_b.value"))))
        df = df.withColumn("_b", best if b == 0 else F.col("_b")).withColumn("_m", found).withColumn("_b", F.when(sooner, F.col("_m")).otherwise(F.col("_b")))
    if not blocks:
        df = df.withColumn("_b", best)
    return df.withColumn("value", F.coalesce("_b.value", F.lit(float(default)))).drop("_b", "_m")


def glob_to_regex(glob: Column) -> Column:
    """``*`` / ``?`` globs as anchored regular expressions (other regex characters escaped)."""
    esc = F.regexp_replace(glob, r"([.+^$()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(esc, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def missing_artifacts(expected: DataFrame, present: DataFrame, run: str = "run") -> DataFrame:
    """JN-07: expected artefact globs with no present file of the same run (anti join on run + rlike)."""
    e = expected.withColumn("_re", glob_to_regex(F.col("pattern")))
    j = e.alias("e").join(present.alias("p"), (F.col(f"e.{run}") == F.col(f"p.{run}"))
                          & F.expr("p.name rlike e._re"), "left_anti")
    return j.drop("_re")


# fixed values: launcher states that count as complete
TERMINAL_OK_STATES = ("complete", "completed", "stopped")


def verify_runs(runs: DataFrame, stops: DataFrame, missing: DataFrame, run: str = "run") -> DataFrame:
    """LOG-12: pass / fail with the first failing reason of each run.

    ``runs``: run, state (launcher), log_lines, final_step, critical (names of the final step's files that are there:
    model, meta, optim), meta_nonfinite, meta_step, has_cursor. Checked in this order: launcher state, expected
    artefacts, log presence, stop signal in the log, resume-critical files, non-finite metadata, metadata step, resume cursor.
    Null counts as not there.
    """
    m = missing.groupBy(run).agg(F.array_join(F.array_sort(F.collect_list("pattern")), ",").alias("_missing"))
    j = runs.join(stops.select(run, F.col("kind").alias("_stop")), run, "left").join(m, run, "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    lacking = F.array_except(F.array(*[F.lit(x) for x in ("model", "meta", "optim")]), F.coalesce("critical", F.array().cast("array<string>")))
    reason = (F.when(no(F.col("state").isin(*TERMINAL_OK_STATES)), F.concat(F.lit("state:"), F.coalesce("state", F.lit("none"))))
               .when(F.col("_missing").isNotNull(), F.concat(F.lit("missing:"), F.col("_missing")))
               .when(no(F.col("log_lines") > 0), F.lit("no_log"))
               .when(F.col("_stop").isNotNull(), F.concat(F.lit("stop:"), F.col("_stop")))
               .when(F.size(lacking) > 0, F.concat(F.lit("critical:"), F.array_join(F.array_sort(lacking), ",")))
               .when(F.coalesce("meta_nonfinite", F.lit(True)), F.lit("nonfinite_metadata"))
               .when(no(F.col("meta_step") == F.col("final_step")), F.lit("metadata_step"))
               .when(no(F.col("has_cursor")), F.lit("no_cursor")))
    return j.select(run, F.when(reason.isNull(), "pass").otherwise("fail").alias("status"), reason.alias("reason"))
