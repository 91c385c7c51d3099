"""Task tables: request audit, slicing, mixtures, curriculum and synthetic generators.

Synthetic rows (GEN-*) draw every random choice from a hash of the row index
(seeded), so they are reproducible, independent per row and computable in
SQL. Words come from a word table derived from the corpus; a row picks its
word with an equi-join on a dense position (no pairs, no driver lists).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.hashing import HASH_BITS, hash_key
from tokenmill.operators.ordering import hash_bucket, member_offsets, permute, with_index

# --- fixed values that must equal the reference ----------------------------------
REQUEST_LIMITS = dict(max_messages=500, max_message_chars=8000, max_total_chars=32000,
                      min_temperature=0.0, max_temperature=2.0, min_top_k=0, max_top_k=200,
                      min_max_tokens=1, max_max_tokens=4096)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
USER_MSG_TEMPLATES = [
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?",
    "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}",
    "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}",
    "{word}里有几个{letter}",
    "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요",
    "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요",
    "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}",
    "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor",
    "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか",
    "{word}の中に{letter}がいくつ",
    "{word}に{letter}が何回出てくる",
]
QUOTES = ["", "'", '"']
# ---------------------------------------------------------------------------------


def audit_requests(df: DataFrame, messages: str = "messages", temperature: str = "temperature",
                   top_k: str = "top_k", max_tokens: str = "max_tokens", limits: dict | None = None) -> DataFrame:
    """FLT-10: first failing request rule -> ``reject_reason`` (null = accepted)."""
    L = {**REQUEST_LIMITS, **(limits or {})}
    m = F.col(messages)
    lens = F.transform(m, lambda x: F.coalesce(F.char_length(x["text"]), F.lit(0)))
    empty = F.exists(m, lambda x: x["text"].isNull() | (x["text"] == ""))
    too_long = F.exists(lens, lambda n: n > L["max_message_chars"])
    # the reference checks message by message: the first empty or too-long message decides
    first_bad = F.try_element_at(F.filter(F.transform(m, lambda x: F.when(x["text"].isNull() | (x["text"] == ""),
                                                                          F.lit("empty_content"))
                                                      .when(F.char_length(x["text"]) > L["max_message_chars"],
                                                            F.lit("message_too_long"))),
                                          lambda v: v.isNotNull()), F.lit(1))
    total = F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, n: a + n)
    bad_role = F.exists(m, lambda x: ~x["role"].isin("user", "assistant"))
    t, k, mt = F.col(temperature), F.col(top_k), F.col(max_tokens)
    reason = (F.when(F.size(m) == 0, F.lit("no_messages"))
               .when(F.size(m) > L["max_messages"], F.lit("too_many_messages"))
               .when(empty | too_long, first_bad)
               .when(total > L["max_total_chars"], F.lit("conversation_too_long"))
               .when(bad_role, F.lit("invalid_role"))
               .when(t.isNotNull() & ~t.between(L["min_temperature"], L["max_temperature"]), F.lit("bad_temperature"))
               .when(k.isNotNull() & ~k.between(L["min_top_k"], L["max_top_k"]), F.lit("bad_top_k"))
               .when(mt.isNotNull() & ~mt.between(L["min_max_tokens"], L["max_max_tokens"]), F.lit("bad_max_tokens")))
    return df.withColumn("reject_reason", reason)


def _nonfinite_paths(c: Column, kind: T.DataType, path: str) -> Column | None:
    """Array of the paths below ``c`` that hold NaN or +-inf; None if there can be none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.array(F.lit(path))).otherwise(F.array().cast("array<string>"))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind if (p := _nonfinite_paths(c[f.name], f.dataType, f"{path}.{f.name}")) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.MapType):
        c, kind, path = F.map_values(c), T.ArrayType(kind.valueType), f"{path}{{}}"
    elif isinstance(kind, T.ArrayType):
        path = f"{path}[]"
    else:
        return None
    if _nonfinite_paths(F.lit(None), kind.elementType, path) is None:
        return None
    found = F.flatten(F.transform(c, lambda x: F.coalesce(_nonfinite_paths(x, kind.elementType, path), F.array().cast("array<string>"))))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def nonfinite_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FLT-12: paths holding NaN or +-inf in ``cols``, per row (null when all finite).

    Structs, arrays and maps are searched at any depth: ``a.b``, ``a[]``, ``a{}``.
    """
    parts = [F.coalesce(p, F.array().cast("array<string>")) for c in cols if (p := _nonfinite_paths(F.col(c), df.schema[c].dataType, c)) is not None]
    arr = F.concat(F.array().cast("array<string>"), *parts)
    return df.withColumn("nonfinite", F.when(F.size(arr) > 0, F.array_join(arr, ",")))


# ----------------------------------------------------------------------------- mixtures


def mixture(members: Sequence[tuple[DataFrame, int]], seed: int = 42, n_buckets: int | None = None) -> DataFrame:
    """SET-01: UNION ALL of tasks (``task_idx``, dense ``local_idx``), each repeated ``epochs`` times,
    then one seeded permutation -> ``pos``."""
    parts = []
    for t, (df, epochs) in enumerate(members):
        d = df.select(F.lit(t).cast("bigint").alias("task_idx"), F.col("local_idx").cast("bigint"))
        d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        parts.append(d.withColumn("epoch", F.col("epoch").cast("bigint")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("_key", F.concat_ws(":", "task_idx", "local_idx", "epoch"))
    h = u.withColumn("_h", hash_key(seed, "_key"))
    if n_buckets:
        out = with_index(h, ["_h", "_key"], name="pos", bucket=hash_bucket("_h", n_buckets), n_buckets=n_buckets)
    else:
        out = with_index(h, ["_h", "_key"], name="pos")
    return out.drop("_h", "_key")


def curriculum(members: Sequence[DataFrame]) -> DataFrame:
    """SET-02: ordered concatenation (no shuffle): global idx = member offset + local idx."""
    parts = [df.select(F.lit(t).cast("bigint").alias("task_idx"), F.col("local_idx").cast("bigint"))
             for t, df in enumerate(members)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    sizes = u.groupBy("task_idx").agg(F.count(F.lit(1)).alias("size"))
    offs = member_offsets(sizes, "size", ["task_idx"])
    # the offsets table has one row per member task
    return u.join(F.broadcast(offs.select("task_idx", "offset")), "task_idx") \
            .withColumn("idx", F.col("offset") + F.col("local_idx")).drop("offset")


def mixture_shares(mix: DataFrame) -> DataFrame:
    """SET-03: rows and share per member of a mixture."""
    c = mix.groupBy("task_idx").agg(F.count(F.lit(1)).alias("rows"))
    total = mix.agg(F.count(F.lit(1))).scalar()
    return c.withColumn("share", F.col("rows") / total)


def union_with_source(parts: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """SET-04: union of row sets with a provenance column."""
    out = None
    for df, src in parts:
        d = df.withColumn("source", F.lit(src))
        out = d if out is None else out.unionByName(d)
    return out


# ----------------------------------------------------------------------------- synthetic generators


def _h(seed: str, i: Column) -> Column:
    return hash_key(seed, i)


def _below(seed: str, i: Column, p: float) -> Column:
    """True with probability p (integer threshold on the 60-bit hash)."""
    return _h(seed, i) < F.lit(int(p * (1 << HASH_BITS)))


def _pick(options: Sequence[str], seed: str, i: Column) -> Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (_h(seed, i) % len(options) + 1).cast("int"))


def indexed_words(words: DataFrame, seed: int = 0) -> DataFrame:
    """Dense word positions in a seeded order: (widx, word)."""
    return permute(words.select("word"), "word", seed=seed, name="widx", n_buckets=256)


def letter_count_rows(words: DataFrame, n: int | Column, split: str = "train", seed_offset: int = 10_000_000
                      ) -> DataFrame:
    """GEN-01: letter-count questions; row i is seeded by i (test rows by i + offset)."""
    w = indexed_words(words)
    n_words = w.agg(F.count(F.lit(1))).scalar()
    rows = w.sparkSession.range(n) if isinstance(n, int) else n
    rows = rows.select(F.col("id").alias("i"), (F.col("id") + (seed_offset if split == "test" else 0)).alias("seed"))
    rows = rows.withColumn("widx", _h("gw", F.col("seed")) % n_words)
    r = rows.join(w, "widx")
    s = F.col("seed")
    in_word = F.substring(F.col("word"), (_h("gl", s) % F.char_length("word") + 1).cast("int"), 1)
    letter = F.when(_below("gp", s, 0.9), in_word).otherwise(_pick(list(LETTERS), "gr", s))
    tmpl = _pick(USER_MSG_TEMPLATES, "gt", s)
    tmpl = F.when(_below("gc", s, 0.3), F.lower(tmpl)).otherwise(tmpl)
    lq, wq = _pick(QUOTES, "gq1", s), _pick(QUOTES, "gq2", s)
    msg = F.replace(F.replace(tmpl, F.lit("{letter}"), F.concat(lq, letter, lq)), F.lit("{word}"), F.concat(wq, F.col("word"), wq))
    msg = F.when(_below("gm", s, 0.5), F.concat(msg, F.lit("?"))).otherwise(msg)
    count = F.char_length("word") - F.char_length(F.replace(F.col("word"), letter, F.lit("")))
    return r.select("i", "word", letter.alias("letter"), count.cast("bigint").alias("count"), msg.alias("user_msg"))


def worked_solution(word: Column, letter: Column) -> Column:
    """GEN-02: assistant parts: manual spell-out with running count, python check, final answer."""
    spelled = F.array_join(F.split(word, ""), ",")
    n = F.char_length(word)

    def line(i):
        ch = F.substring(word, i, 1)
        prefix = F.substring(word, 1, i)
        running = F.char_length(prefix) - F.char_length(F.replace(prefix, letter, F.lit("")))
        return F.when(ch == letter, F.concat(i.cast("string"), F.lit(":"), ch, F.lit(" hit! count="),
                                             running.cast("string"), F.lit("\n"))) \
                .otherwise(F.concat(i.cast("string"), F.lit(":"), ch, F.lit("\n")))

    count = (n - F.char_length(F.replace(word, letter, F.lit("")))).cast("string")
    manual = F.concat(F.lit("We are asked to find the number '"), letter, F.lit("' in the word '"), word,
                      F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"), word, F.lit(":"),
                      spelled, F.lit("\n\nThen count the occurrences of '"), letter, F.lit("':\n"),
                      F.array_join(F.transform(F.sequence(F.lit(1), n), line), ""),
                      F.lit("\nThis gives us "), count, F.lit("."))

    def part(t, x):
        return F.struct(F.lit(t).alias("type"), x.alias("text"))

    return F.array(part("text", manual), part("text", F.lit("\n\nLet me double check this using Python:\n\n")),
                   part("python", F.concat(F.lit("'"), word, F.lit("'.count('"), letter, F.lit("')"))),
                   part("python_output", count),
                   part("text", F.concat(F.lit("\n\nPython gives us "), count,
                                         F.lit(".\n\nMy final answer is:\n\n#### "), count)))


def spelling_rows(words: DataFrame, n: int, split: str = "train", seed_offset: int = 10_000_000) -> DataFrame:
    """GEN-03: ``Spell the word: w`` -> ``w:l,e,t,t,e,r,s`` on a reshuffled word order."""
    w = indexed_words(words, seed=42)
    n_words = w.agg(F.count(F.lit(1))).scalar()
    rows = w.sparkSession.range(n).select(F.col("id").alias("i"),
                                          (F.col("id") + (seed_offset if split == "test" else 0)).alias("seed"))
    r = rows.withColumn("widx", _h("sw", F.col("seed")) % n_words).join(w, "widx")
    return r.select("i", "word", F.concat(F.lit("Spell the word: "), "word").alias("user"),
                    F.concat("word", F.lit(":"), F.array_join(F.split("word", ""), ",")).alias("assistant"))


def three_positions(row: str, n: Column) -> Column:
    """Three different positions below ``n`` (all there are, if ``n`` is smaller) in an order drawn by hash for each row."""
    a = _h("m1", F.col(row)) % n
    b = (a + 1 + _h("m2", F.col(row)) % F.greatest(n - 1, F.lit(1))) % n
    r = _h("m3", F.col(row)) % F.greatest(n - 2, F.lit(1))
    r = r + (r >= F.least(a, b)).cast("bigint")
    c = r + (r >= F.greatest(a, b)).cast("bigint")
    return F.slice(F.array(a, b, c), F.lit(1), F.least(n, F.lit(3)).cast("int"))


def generation_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """GEN-05: success / error accounting of a generation run."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


# ----------------------------------------------------------------------------- UDF-01: task surface


class Task:
    """A task is a table plus two functions (UDF-01).

    ``to_messages``: DataFrame -> DataFrame with a ``messages`` column;
    ``grade``: (reference Column, response Column) -> boolean Column. Examples
    are addressed by a dense ``idx`` (slicing = FLT-03); ``reward`` is the
    grade as a double.
    """

    def __init__(self, name: str, df: DataFrame, key: str, grade, to_messages=None, eval_type: str = "generative"):
        self.name, self.df, self.key, self._grade, self._to_messages = name, df, key, grade, to_messages
        self.eval_type = eval_type

    def num_examples(self) -> Column:
        return self.df.agg(F.count(F.lit(1))).scalar()

    def examples(self, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
        from tokenmill.operators.filters import slice_task
        return slice_task(with_index(self.df, [self.key], name="idx"), start, stop, step)

    def conversations(self) -> DataFrame:
        return self._to_messages(self.df) if self._to_messages else self.df

    def evaluate(self, responses: DataFrame, reference: str, response: str) -> DataFrame:
        return responses.withColumn("correct", self._grade(F.col(reference), F.col(response)))

    def reward(self, responses: DataFrame, reference: str, response: str) -> DataFrame:
        return self.evaluate(responses, reference, response).withColumn("reward", F.col("correct").cast("double"))


TASKS: dict[str, "callable"] = {}


def register_task(name: str):
    def deco(factory):
        TASKS[name] = factory
        return factory
    return deco
