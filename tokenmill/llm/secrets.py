"""Secret scan on the JVM only: fixed patterns, and a battery of randomness tests for all other long tokens.

A token is a run of 20 or more characters of the base64 and base64url alphabets that no pattern span touches. Its encoding is
inferred from its characters: hex, base32 or base64. Three statistics are taken for that alphabet: chi-squared of the
symbol counts, the number of runs of one character class, and the correlation of neighbouring symbols. Each
is compared with two models. Against a uniform source the three z-values must stay below ``TOO_FAR``. Against text
(whose letters are uneven, whose classes change rarely) they give one-sided p-values, which depend on the token's
length through mean and spread; they are combined by Fisher's method. Tokens are called secrets under Benjamini-Hochberg control of the
false discovery rate, separately for classes of length, so that the many short tokens don't decide for the long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the base kinds and what a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # AKIA[A-Z0-9]+ of 20 and more: a run has one leftmost match either way
HEX = r"[0-9a-f]{24,}+"  # [0-9a-f]+ of 24 and more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
#: False discovery rate, largest distance from a uniform source, steps of -log10 p that p-values are rounded up to.
RATE, TOO_FAR, STEP = 0.01, 4.0, 0.25
#: Lower ends of the classes of length.
LENGTHS = (20, 32, 48, 80)
DIGITS16, DIGITS32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Chance that neighbouring symbols of a uniform source differ in class (letter case, digit, other), by alphabet.
CHANGES = {64: 1 - 1456 / 4096, 32: 1 - 712 / 1024, 16: 1 - 136 / 256}
#: Text: sum of squared letter frequencies, sum of cubes less the square of that, changes of class, serial products.
TEXT_SQUARES, TEXT_SPREAD, TEXT_CHANGES, TEXT_SERIAL = 0.066, 0.0013, 0.2, 0.12


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """Array of struct(start, stop, kind) of all leftmost non-overlapping matches that pass ``ok``, in code points.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths are the offsets.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def of(both: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(both["between"], i))
            stop = start + F.length(F.get(both["found"], i))
            one = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"))
            good = ok(F.get(both["found"], i)) if ok else F.lit(True)
            return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        empty = F.array().cast("array<struct<start:int,stop:int,kind:int>>")
        return F.when(F.size(both["found"]) == 0, empty).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"])

    return _let(F.struct(found.alias("found"), between.alias("between")), of)


_SPANS = "array<struct<start:int,stop:int,kind:int>>"


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, ordered by start, then kind. Cheap tests spare most texts the patterns."""
    none = F.array().cast(_SPANS)
    low = F.lower(text)
    may_assign = F.contains(low, F.lit(ASSIGN_WORDS[0]))
    for w in ASSIGN_WORDS[1:]:
        may_assign = may_assign | F.contains(low, F.lit(w))
    long_enough = lambda m: F.length(F.regexp_extract(m, "^(?:" + ASSIGN + ")$", 2)) >= 6
    assign = F.when(may_assign, matches(text, ASSIGN, 0, long_enough)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), matches(text, HEX, 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def tokens(text: Column, base: Column) -> Column:
    """struct(start, stop, kind) of long tokens that touch none of the ``base`` spans."""
    found = F.when(text.rlike(TOKEN), matches(text, TOKEN, 3)).otherwise(F.array().cast(_SPANS))
    return F.filter(found, lambda t: ~F.exists(base, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))


def _log_tail(z: Column) -> Column:
    """Log of the upper tail of the normal distribution, which is known to a few parts in a hundred. Taken without the
    tail itself, which is 0 from z of about 41 on, as tokens of some thousand characters have it."""
    half = lambda x: F.log(F.lit(0.5)) - 0.717 * x - 0.416 * x * x
    return F.when(z >= 0, half(z)).otherwise(F.log(1.0 - F.exp(half(-z))))


def battery(token: Column) -> Column:
    """struct(n, far, p) of a token: its length without padding, the largest distance from a uniform source in
    standard deviations, and Fisher's combined p-value against text. Digits alone are far from any source of keys."""
    is_hex = token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & token.rlike("[A-Fa-f]")
    is_32 = token.rlike("^[A-Z2-7]+=*$")
    size = F.when(is_hex, 16).when(is_32, 32).otherwise(64)
    alphabet = F.when(is_hex, F.lit(DIGITS16)).when(is_32, F.lit(DIGITS32)).otherwise(F.lit(DIGITS64))
    plain = F.regexp_replace(F.when(is_hex, F.lower(token)).when(is_32, token).otherwise(F.translate(token, "-_", "+/")), "=", "")
    codes = F.transform(F.array_remove(F.split(plain, ""), ""), lambda c: F.instr(alphabet, c) - 1)

    def stats(v: Column) -> Column:
        c, a = v["codes"], v["a"].cast("double")
        n = F.when(F.size(c) >= 2, F.size(c)).cast("double")  # null: too short for any statistic
        kind = lambda x: F.when(v["a"] == 64, F.when(x < 26, 0).when(x < 52, 1).when(x < 62, 2).otherwise(3)).when(v["a"] == 32, (x < 26).cast("int")).otherwise((x < 10).cast("int"))
        pairs = F.filter(F.transform(c, lambda x, i: F.struct(x.alias("x"), F.get(c, i + 1).alias("y"))), lambda e: e["y"].isNotNull())
        squares = F.aggregate(F.array_sort(c), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum")),
                              lambda acc, x: F.struct(x.alias("last"), F.when(x == acc["last"], acc["run"] + 1).otherwise(1).alias("run"),
                                                      (acc["sum"] + F.when(x == acc["last"], 2 * acc["run"] + 1).otherwise(1)).cast("long").alias("sum")))["sum"]
        changes = F.aggregate(pairs, F.lit(0), lambda acc, e: acc + (kind(e["x"]) != kind(e["y"])).cast("int"))
        mean = (a - 1) / 2
        products = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + (e["x"] - mean) * (e["y"] - mean))
        return F.struct(n.alias("n"), a.alias("a"), (a / n * squares - n).alias("chi"), changes.cast("double").alias("changes"),
                        (products / ((a * a - 1) / 12)).alias("serial"))

    def verdict(s: Column) -> Column:
        n, a = s["n"], s["a"]
        q = F.when(a == 64, CHANGES[64]).when(a == 32, CHANGES[32]).otherwise(CHANGES[16])
        from_uniform = F.greatest((s["chi"] - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n), F.abs(s["changes"] - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q)),
                                  F.abs(s["serial"]) / F.sqrt(n - 1))
        chi_text = (a - 1 + (n - 1) * (a * TEXT_SQUARES - 1) - s["chi"]) / F.sqrt(2 * (a - 1) + 4 * (n - 1) * a * a * TEXT_SPREAD)
        changes_text = (s["changes"] - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))
        serial_text = F.when(a == 64, ((n - 1) * TEXT_SERIAL - s["serial"]) / F.sqrt(n - 1)).otherwise(0.0)
        x = -(_log_tail(chi_text) + _log_tail(changes_text) + _log_tail(serial_text))
        return F.struct(F.coalesce(n.cast("int"), F.lit(0)).alias("n"), F.coalesce(F.when(token.rlike("^[0-9]+$"), 1e9).otherwise(from_uniform), F.lit(1e9)).alias("far"),
                        F.when(n.isNull(), 1.0).otherwise(F.exp(-x) * (1 + x + x * x / 2)).alias("p"))

    return _let(_let(F.struct(codes.alias("codes"), size.alias("a")), stats), verdict)


def judged_tokens(text: Column, base: Column) -> Column:
    """Array of struct(span, class, step, near) for the long tokens: class of length, p-value in steps, and whether
    the token is near a uniform source."""

    def one(t: Column) -> Column:
        def of(b: Column) -> Column:
            cls = F.lit(0)
            for low in LENGTHS[1:]:
                cls = cls + (b["n"] >= low).cast("int")
            step = F.least(F.floor(-F.log10(F.greatest(b["p"], F.lit(1e-99))) / STEP), F.lit(400)).cast("int")
            return F.struct(t.alias("span"), cls.alias("cls"), F.greatest(step, F.lit(0)).alias("step"), ((b["far"] < TOO_FAR) & (b["n"] >= LENGTHS[0])).alias("near"))

        return _let(battery(F.substring(text, t["start"] + 1, t["stop"] - t["start"])), of)

    return F.transform(tokens(text, base), one)


def _scanned(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def limits(docs: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Least step at which a token of each class of length is called a secret, from all tokens of ``docs``.

    Benjamini-Hochberg over p-values rounded up to a step: counts by class and step are all that is gathered, at most
    a few hundred rows. A class without a discovery is left out.
    """
    text = F.col("text")
    rows = docs.select(_scanned(text).alias("text")).withColumn("base", base_spans(text)).select(F.explode(judged_tokens(text, F.col("base"))).alias("t"))
    counts = rows.groupBy("t.cls", "t.step").agg(F.count("*").alias("n"))
    all_, up = Window.partitionBy("cls"), Window.partitionBy("cls").orderBy(F.desc("step"))
    ranked = counts.select("cls", "step", F.sum("n").over(all_).alias("m"), F.sum("n").over(up).alias("rank"))
    found = ranked.where(F.pow(F.lit(10.0), -STEP * F.col("step")) <= rate * F.col("rank") / F.col("m")).groupBy("cls").agg(F.min("step").alias("step"))
    return {r["cls"]: r["step"] for r in found.collect()}


def spans_of(text: Column, found: dict[int, int]) -> Column:
    """struct(base, all): spans of the fixed kinds, and those with the tokens called secret, ordered by start and kind."""

    def of(base: Column) -> Column:
        def secret(t: Column) -> Column:
            least = F.lit(None).cast("int")
            for cls, step in sorted(found.items()):
                least = F.when(t["cls"] == cls, step).otherwise(least)
            return t["near"] & F.coalesce(t["step"] >= least, F.lit(False))

        more = F.transform(F.filter(judged_tokens(text, base), secret), lambda t: t["span"]) if found else F.array().cast(_SPANS)
        both = F.array_sort(F.concat(base, more), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
        return F.struct(base.alias("base"), both.alias("all"))

    return _let(base_spans(text), of)


def _written(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind. A null text is empty: no span, and
    the digest of the empty string. Repeated rows are scanned one by one and all count for the discovery rate; texts
    are scanned whole; an empty table gives no rows; other columns are ignored.
    """
    found = limits(docs, rate)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(_scanned(F.col("text")), found).alias("s"))
    count = lambda k: F.size(F.filter("s.all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(_written(F.col("s.base")), 256).alias("base_sha256"), _written(F.col("s.all")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (overlapping spans by one) and n_chars, if it is
    there, set to the new length. Texts without secrets, and null texts, stay as they are."""
    found = limits(docs, rate)
    text = _scanned(F.col("text"))

    def cut(v: Column) -> Column:
        t = v["text"]

        def step(acc: Column, s: Column) -> Column:
            new = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

        done = F.aggregate(v["spans"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
        return _let(done, lambda d: F.concat(d["out"], F.substring(t, d["at"] + 1, F.length(t))))

    with_spans = _let(F.struct(text.alias("text"), spans_of(text, found)["all"].alias("spans")), lambda v: F.when(F.size(v["spans"]) > 0, cut(v)))
    name = "__cut"
    while name in docs.columns:  # a user's column keeps its name
        name += "_"
    out = docs.withColumn(name, with_spans)
    new = {"text": F.coalesce(name, "text")} | ({"n_chars": F.when(F.col(name).isNotNull(), F.length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
