"""Conversation tables: assemble, validate, normalise, render to (ids, mask).

A message is ``STRUCT<turn, role, text, parts ARRAY<STRUCT<type, text>>>``;
``parts`` is null for plain-string content. It is array/struct SQL, but for the
last step of rendering, which lays out a batch of spans at once in Arrow; the only shuffle
is the ``groupBy(conv_id)`` that assembles turns (one group = one
conversation, bounded by its turn count).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import N_BYTES, SPECIAL_TOKENS, byte_ids, col, strip
from tokenmill.session import small_batches

PART = "struct<type:string,text:string>"


# ----------------------------------------------------------------------------- assembly / validation


def assemble(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """CNV-01: turns -> one ordered message array per conversation."""
    msg = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
                   F.lit(None).cast(f"array<{PART}>").alias("parts"))
    return turns.groupBy(conv).agg(F.array_sort(F.collect_list(msg)).alias("messages"))


def _expected_role(i: Column) -> Column:
    return F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))


def _first_failure(msgs: Column, blank_check: bool) -> Column:
    """Per message: 'bad_role' / 'blank_content' / null, then the first non-null in order."""
    def code(m, i):
        c = F.when(m["role"] != _expected_role(i), F.lit("bad_role"))
        if blank_check:
            c = c.when(m["text"].rlike(r"^\s*$"), F.lit("blank_content"))
        return c
    codes = F.transform(msgs, code)
    return F.try_element_at(F.filter(codes, lambda x: x.isNotNull()), F.lit(1))


def validate_strict(df: DataFrame, messages: str = "messages") -> DataFrame:
    """FLT-08: >= 2 messages, user/assistant alternation from user, non-blank content.

    Adds ``reason`` (null when valid); the caller splits ok / quarantine.
    """
    m = F.col(messages)
    reason = F.when(F.size(m) < 2, F.lit("too_few_messages")).otherwise(_first_failure(m, True))
    return df.withColumn("reason", reason)


def strip_system(messages: Column) -> Column:
    return F.when(F.try_element_at(messages, F.lit(1))["role"] == "system", F.slice(messages, 2, F.size(messages)))\
            .otherwise(messages)


def validate_chat(df: DataFrame, messages: str = "messages") -> DataFrame:
    """FLT-09: optional leading system message, then >= 2 alternating messages."""
    rest = strip_system(F.col(messages))
    reason = F.when(F.size(F.col(messages)) < 1, F.lit("empty")) \
              .when(F.size(rest) < 2, F.lit("too_few_messages")) \
              .otherwise(_first_failure(rest, False))
    return df.withColumn("reason", reason)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("reason").isNull()).drop("reason"), df.where(F.col("reason").isNotNull())


def merge_system(df: DataFrame, messages: str = "messages") -> DataFrame:
    """CNV-02: fold a leading system message into the next (user) message.

    A system message not followed by a user message gets ``reason``.
    """
    m = F.col(messages)
    first, second = F.try_element_at(m, F.lit(1)), F.try_element_at(m, F.lit(2))
    merged = F.struct(second["turn"].alias("turn"), second["role"].alias("role"),
                      F.concat(first["text"], F.lit("\n\n"), second["text"]).alias("text"),
                      second["parts"].alias("parts"))
    is_sys = first["role"] == "system"
    out = F.when(is_sys, F.concat(F.array(merged), F.slice(m, 3, F.greatest(F.size(m) - 2, F.lit(0))))).otherwise(m)
    bad = is_sys & ((F.size(m) < 2) | (second["role"] != "user"))
    return df.withColumn(messages, F.when(bad, m).otherwise(out)) \
             .withColumn("merge_error", F.when(bad, F.lit("system_not_followed_by_user")))


# ----------------------------------------------------------------------------- rendering


def byte_special(name: str) -> int:
    return N_BYTES + SPECIAL_TOKENS.index(name)


def _arr(v: int) -> Column:
    return F.array(F.lit(v))


def rendered(spans: pa.ListArray, bos: int) -> pa.StructArray:
    """(ids, mask) of each list of spans, a batch at a time on the flat values; both null where a span's text is null, the row null without spans."""
    count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    open_, e, close, on, ends = spans.flatten().flatten()
    open_, close, on, ends = (x.to_numpy(zero_copy_only=False) for x in (open_, close, on, ends))
    if pa.types.is_list(e.type):
        size, values = pc.list_value_length(e), e.flatten().to_numpy(zero_copy_only=False)
    else:
        size, values = pc.binary_length(e), np.frombuffer(b"".join(x for x in e.to_pylist() if x), np.uint8)
    size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(spans)), count)
    begins, closes = open_ >= 0, close >= 0
    whole = size + begins + closes
    before = np.cumsum(whole) - whole
    at = before + row + 1  # each row begins with the bos
    per_row = 1 + np.bincount(row, whole, len(spans)).astype(np.int64)
    first = np.append(0, np.cumsum(per_row))
    ids, mask = np.full(first[-1], bos, np.int32), np.zeros(first[-1], np.int32)
    ids[at[begins]], mask[at[begins]] = open_[begins], ends[begins]
    at = at + begins
    text = np.arange(size.sum()) + np.repeat(at - np.cumsum(size) + size, size)
    ids[text], mask[text] = values, np.repeat(on, size)
    at = (at + size)[closes]
    ids[at], mask[at] = close[closes], ends[closes]
    lost = np.bincount(row, e.is_null().to_numpy(zero_copy_only=False), len(spans)) > 0
    lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x), mask=pa.array(lost)) for x in (ids, mask)]
    return pa.StructArray.from_arrays(lists, ["ids", "mask"], mask=spans.is_null())


def render(df: DataFrame, messages: str = "messages", max_tokens: int | None = 2048,
           encode: Callable[[Column], Column] = byte_ids,
           special: Callable[[str], int] = byte_special) -> DataFrame:
    """CNV-03: (ids, mask) per conversation; a leading system message is merged first.

    user: start, text, end all 0. assistant: start 0; text parts 1; python
    parts with their start/end 1; python_output with its start/end 0; end 1.
    Each part is encoded once, by itself. Truncated to ``max_tokens``, if given.
    Conversations that can't be rendered (a system message that can't be merged, a
    role other than user and assistant) are left out: :func:`unrenderable` has them.
    """
    d = merge_system(df, messages)
    us, ue = special("<|user_start|>"), special("<|user_end|>")
    as_, ae = special("<|assistant_start|>"), special("<|assistant_end|>")
    ps, pe = special("<|python_start|>"), special("<|python_end|>")
    os_, oe = special("<|output_start|>"), special("<|output_end|>")
    bos = special("<|bos|>")

    def parts_of(m):
        return F.coalesce(m["parts"], F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))))

    coded = (lambda t: F.encode(t, "UTF-8")) if encode is byte_ids else encode  # the bytes of a text are its ids: they needn't be taken apart here
    kind = "binary" if encode is byte_ids else "array<int>"
    nothing = F.lit(b"") if encode is byte_ids else F.array().cast("array<int>")

    # a span is (open token, encoded text, close token, mask of text and of both tokens); -1 stands for no token
    def span(open_, e, close, on, ends):
        return F.struct(open_.alias("open"), e.cast(kind).alias("e"), close.alias("close"), on.alias("on"), ends.alias("ends"))

    def edge(t, on):
        return F.array(span(F.lit(t), nothing, F.lit(-1), F.lit(on), F.lit(on)))

    def part_span(p):
        of = lambda python, output, text: F.when(p["type"] == "python", python).when(p["type"] == "python_output", output).otherwise(text)
        return span(of(ps, os_, -1), coded(p["text"]), of(pe, oe, -1), of(1, 0, 1), of(1, 0, 1))

    def spans_of(m):
        return F.when(m["role"] == "user", F.array(span(F.lit(us), coded(m["text"]), F.lit(ue), F.lit(0), F.lit(0)))).otherwise(
            F.concat(edge(as_, 0), F.transform(parts_of(m), part_span), edge(ae, 1)))

    @F.arrow_udf("struct<ids:array<int>,mask:array<int>>")
    def ids_and_mask(spans: pa.Array) -> pa.Array:
        return rendered(spans, bos)

    small_batches(df.sparkSession)
    # what can't be rendered has no spans; it is left out after the Arrow step. A filter that Spark can push below it would work out the
    # messages, and the step, once more for each place that names them; hence the mark as not deterministic
    spans = F.when(F.col("merge_error").isNull() & ~F.exists(messages, _other_role), F.flatten(F.transform(F.col(messages), spans_of)))
    r = d.withColumn("_r", ids_and_mask.asNondeterministic()(spans)).where(F.col("_r").isNotNull())
    cut = (lambda c: c) if max_tokens is None else (lambda c: F.slice(c, 1, max_tokens))
    return r.withColumn("ids", cut(F.col("_r.ids"))).withColumn("mask", cut(F.col("_r.mask"))).drop("_r")


def _other_role(m: Column) -> Column:
    return ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False))


def unrenderable(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Conversations that :func:`render` leaves out, with a ``reason``."""
    d = merge_system(df, messages)
    reason = F.coalesce("merge_error", F.when(F.exists(messages, _other_role), F.lit("bad_role")))
    return d.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("merge_error")


def render_for_completion(df: DataFrame, messages: str = "messages", **kw) -> DataFrame:
    """CNV-04: drop the final assistant message, render, append assistant-start."""
    special = kw.get("special", byte_special)
    m = F.col(messages)
    last_ok = F.try_element_at(m, F.lit(-1))["role"] == "assistant"
    d = df.where(last_ok).withColumn(messages, F.slice(m, 1, F.size(m) - 1))
    r = render(d, messages, **kw)
    return r.withColumn("ids", F.concat("ids", _arr(special("<|assistant_start|>")))).drop("mask")


def targets_from_mask(ids: str | Column, mask: str | Column) -> Column:
    """CNV-05: targets = ids shifted left by one, -1 where the target's mask is 0."""
    i, m = col(ids), col(mask)
    n = F.size(i) - 1
    return F.zip_with(F.slice(i, 2, n), F.slice(m, 2, n), lambda t, k: F.when(k == 1, t).otherwise(F.lit(-1)))


# ----------------------------------------------------------------------------- task shaping


# --- fixed values that must equal the reference: wording of prompts, patterns of calls, answers and programs ---
MC_HEAD, MC_TAIL = "Multiple Choice question: ", "\nRespond only with the letter of the correct answer."
LETTERS = ["A", "B", "C", "D"]
CALL_RE = "<<[^>]+>>"
ANSWER_RE = r"#### (\-?[0-9\.\,]+)"
PROGRAM_RE = r"(?s)```(?:python)?\s*\n(.*?)\n```"
# ---------------------------------------------------------------------------------


def render_mc(question: Column, letters: Column, choices: Column) -> Column:
    """CNV-06: multiple-choice prompt, ``- choice=LETTER`` lines (no space before the letter)."""
    lines = F.zip_with(choices, letters, lambda c, l: F.concat(F.lit("- "), c, F.lit("="), l, F.lit("\n")))
    return F.concat(F.lit(MC_HEAD), question, F.lit("\n"), F.array_join(lines, ""),
                    F.lit(MC_TAIL))


def mc_to_conversation(df: DataFrame, question: str = "query", choices: str = "choices",
                       answer: str = "gold") -> DataFrame:
    """CNV-07: index answer -> letter (exactly 4 choices) and a 2-message conversation."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    ok = F.size(F.col(choices)) == 4
    letter = F.try_element_at(letters, F.col(answer) + 1)
    user = render_mc(F.col(question), letters, F.col(choices))
    msgs = F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), user.alias("text"),
                 F.lit(None).cast(f"array<{PART}>").alias("parts")),
        F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), letter.alias("text"),
                 F.lit(None).cast(f"array<{PART}>").alias("parts")))
    return df.withColumn("letters", letters).withColumn("answer_letter", letter) \
             .withColumn("messages", msgs).withColumn("reason", F.when(~ok, F.lit("need_4_choices")))


def parse_tool_calls(answer: str | Column) -> Column:
    """CNV-08: text / python / python_output parts from ``<<expr=result>>`` markers.

    The last ``=`` separates expression and result; without ``=`` the result
    is empty. Empty text parts are kept (split semantics).
    """
    a = col(answer)
    texts = F.split(a, CALL_RE, -1)
    inners = F.regexp_extract_all(a, F.lit("<<([^>]+)>>"), 1)

    def pieces(t, inner):
        has_eq = inner.contains("=")
        expr = F.when(has_eq, F.regexp_extract(inner, "^(.*)=", 1)).otherwise(inner)
        res = F.when(has_eq, F.substring_index(inner, "=", -1)).otherwise(F.lit(""))
        text = F.struct(F.lit("text").alias("type"), t.alias("text"))
        py = F.struct(F.lit("python").alias("type"), expr.alias("text"))
        out = F.struct(F.lit("python_output").alias("type"), res.alias("text"))
        return F.when(inner.isNull(), F.array(text)).otherwise(F.array(text, py, out))  # the last text has no call behind it

    return F.flatten(F.zip_with(texts, inners, pieces))


def audit_tool_calls(df: DataFrame, by: Sequence[str], parts: str = "parts") -> DataFrame:
    """CNV-13: recompute every calculator call of the parts (AST whitelist, no eval): calls, mismatches with the
    output that follows a call, and calls that can't be computed, per group."""
    from tokenmill.functions.calculator import calculated

    # the output of a call is the part after it
    pairs = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.get(parts, i + 1).alias("o")))
    calls = df.select(*by, F.explode(F.filter(pairs, lambda x: x["p"]["type"] == "python")).alias("c"))
    j = calls.select(*by, "c.p", "c.o").withColumn("recomputed", calculated(F.col("p.text")))
    wrong = F.col("recomputed").isNotNull() & (F.col("o.text") != "") & (F.col("recomputed") != F.col("o.text"))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.count(F.when(wrong, 1)).alias("n_mismatch"),
                              F.count(F.when(F.col("recomputed").isNull(), 1)).alias("n_unsupported"))


def parts_to_text(parts: str | Column) -> Column:
    """CNV-14: plain text with calls shown as ``<<expr=result>>`` (inverse of CNV-08)."""
    p = col(parts)
    idx = F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)))

    def show(i):
        cur = F.try_element_at(p, i)
        nxt = F.try_element_at(p, F.least(i + 1, F.size(p)))
        return F.when(cur["type"] == "python", F.concat(F.lit("<<"), cur["text"], F.lit("="), nxt["text"], F.lit(">>"))) \
                .when(cur["type"] == "python_output", F.lit("")).otherwise(cur["text"])

    return F.array_join(F.transform(idx, show), "")


def extract_answer(text: str | Column) -> Column:
    """CNV-09: first ``#### number``, commas removed; null when absent."""
    t = col(text)
    return F.when(t.rlike(ANSWER_RE), F.replace(strip(F.regexp_extract(t, ANSWER_RE, 1)), F.lit(","), F.lit("")))


def extract_imports(prompt: str | Column) -> Column:
    """CNV-10: leading import lines (comments and blanks skipped, stop at other code)."""
    lines = F.transform(F.split(col(prompt), "\n", -1), strip)
    is_imp = lambda s: s.startswith("import ") | s.startswith("from ")
    is_stop = lambda s: (~is_imp(s)) & (s != "") & (~s.startswith("#"))
    state = F.struct(F.array().cast("array<string>").alias("acc"), F.lit(False).alias("done"))

    def step(st, s):
        stop = st["done"] | is_stop(s)
        acc = F.when(~stop & is_imp(s), F.concat(st["acc"], F.array(s))).otherwise(st["acc"])
        return F.struct(acc.alias("acc"), stop.alias("done"))

    return F.aggregate(lines, state, step, lambda st: F.array_join(st["acc"], "\n"))


def extract_program(completion: str | Column) -> Column:
    """CNV-11: first fenced code block (trimmed), else the whole trimmed text."""
    c = col(completion)
    return F.when(c.rlike(PROGRAM_RE), strip(F.regexp_extract(c, PROGRAM_RE, 1))).otherwise(strip(c))


def assemble_program(imports: Column, code: Column, test: Column, entry_point: Column) -> Column:
    """CNV-12: imports + code + tests + ``check(entry)``."""
    return F.concat(imports, F.lit("\n\n"), code, F.lit("\n\n"), test, F.lit("\n"),
                    F.lit("check("), entry_point, F.lit(")"))


def join_docs(df: DataFrame, by: Sequence[str], order: str, text: str = "text", sep: str = "\n") -> DataFrame:
    """TOK-12: ordered text join per batch (a batch is bounded: one row group)."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
                            .alias("_m"))
    return g.select(*by, F.array_join(F.transform("_m", lambda m: m["t"]), sep).alias("joined"))
