"""Quality rules on the JVM only: base counts and a hashed n-gram log-likelihood ratio of target against raw corpus.

Both corpora are multinomials over ``buckets`` hashed word unigrams and bigrams. The raw one is counted over every document, the
target over every trusted one. A text's
score is the sum of log(target / raw) over its n-grams divided by their number, and each document is kept or not by a
fixed threshold on its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import saved

BUCKETS = 1 << 16
#: Parts that documents without an id are dealt out in.
SALTS = 1024
#: Added to every count, so that a bucket unseen in one corpus has a finite ratio.
SMOOTHING = 1.0
#: Least score (nats per n-gram) of a kept document.
THRESHOLD = -0.35

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""

    def of(h: Column) -> Column:
        n = F.size(h)
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

        def marked(w: Column) -> Column:
            ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def starts(s: Column) -> Column:
                hit = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
                return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

            return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(ordered, starts))

        return F.when(n < 4, 0).otherwise(_let(windows, marked))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def grams(text: Column, buckets: int) -> Column:
    """Bucket of each word and of each word with its successor (the end, for the last one).

    Words are lower-cased; runs of symbols and exclamation marks are words of their own.
    """
    words = F.array_remove(F.split(F.regexp_replace(F.lower(text), r"([#*$%&|<>!]+)", " $1 "), SPACE), "")
    mask = F.lit(buckets - 1)

    def of(h: Column) -> Column:
        return F.concat(F.transform(h, lambda x: x.bitwiseAND(mask)), F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)).bitwiseAND(mask)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def counted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, t): n-grams of all rows of ``docs``, and of all rows with one of the ids of ``trusted`` (doc_id).

    Texts are read once and turned into bucket numbers, of two bytes each up to 65,536 buckets; only these are dealt out by id and
    meet the trusted ids, which are hashed, not broadcast. Documents without an id are dealt out by their text. Counts are
    combined within each task before they are shuffled.
    """
    low, kind = buckets // 2, "short" if buckets <= 1 << 16 else "int"
    text = F.col("text")
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(text), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    rows = _texts(docs).select("doc_id", salt.alias("salt"), F.transform(grams(text, buckets), lambda g: (g - low).cast(kind)).alias("g"))
    # pmod by 1 is 0, as salt is, but no literal, which would not be a key to deal out by
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", F.pmod("doc_id", F.lit(1)).cast("long").alias("salt"), F.lit(1).cast("long").alias("t"))
    both = rows.join(ids.hint("shuffle_hash"), ["doc_id", "salt"], "left").select(F.explode_outer("g").alias("g"), "t").where("g is not null")  # plain explode tests the array's size below the join, which makes it twice
    return both.groupBy("g").agg(F.count("*").alias("n"), F.count("t").alias("t")).select((F.col("g").cast("long") + low).alias("bucket"), "n", "t")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, ratio) with log(target / raw) of every bucket seen; at most ``buckets`` rows, whatever the corpus.

    Raw counts are over all ``docs``, target counts over all of their rows that are ``trusted``. With no trusted
    document every ratio is 0.
    """
    both = saved(counted(docs, trusted, buckets))
    total = both.agg(F.sum("n").alias("sum_n"), F.sum("t").alias("sum_t"))
    share = lambda n, of: F.log((F.col(n) + smoothing) / (F.col(of) + smoothing * buckets))
    return both.join(F.broadcast(total)).select("bucket", F.when(F.col("sum_t") > 0, share("t", "sum_t") - share("n", "sum_n")).otherwise(0.0).alias("ratio"))


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score.

    A null text has no words; a text without n-grams has score 0. ``buckets`` must be a power of two. Repeated rows are
    judged one by one, texts are read whole, an empty table gives no rows, other columns are ignored.
    """
    ratios = log_ratios(docs, trusted, buckets, smoothing)
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(ratios, "bucket", "left").fillna(0.0, ["ratio"])
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda e: e["ratio"]).alias("r")).scalar()

    def mean_ratio(g: Column) -> Column:
        total = _let(F.col("__ratio"), lambda r: F.aggregate(g, F.lit(0.0), lambda acc, x: acc + F.get(r, x.cast("int"))))
        return F.when(F.size(g) > 0, total / F.size(g)).otherwise(0.0)

    def base(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        _repeated_words(words).alias("n_repeat_words"))

    text = F.col("text")
    rows = _texts(docs).withColumn("__ratio", table).select("doc_id", _let(words_of(text), base).alias("b"), F.length(F.regexp_replace(text, SYMBOL, "")).cast("long").alias("n_symbols"),
                               _repeated_lines(text).alias("n_dup_lines"), _let(grams(text, buckets), mean_ratio).alias("score"))
    rows = rows.select("doc_id", "b.n_words", "b.word_chars", "n_symbols", "n_dup_lines", "b.n_repeat_words", "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
