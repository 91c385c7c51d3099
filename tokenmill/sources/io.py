"""Readers and writers: JSONL conversations, CORE / sweep CSVs, reports, reshard, run catalog."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.operators.ordering import permute
from tokenmill.session import cut_lineage
from tokenmill.sources.corpus import ROW_GROUP_ROWS

MSG_ARRAY = T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                      T.StructField("content", T.StringType())]))


# ----------------------------------------------------------------------------- conversations JSONL


def write_conversations(df: DataFrame, path: str, mode: str = "overwrite", metadata: bool = False,
                        messages: str = "messages") -> None:
    """SNK-06: one JSON array of {role, content} per line; optionally with metadata columns."""
    msgs = F.transform(F.col(messages), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    if metadata:
        line = F.to_json(F.struct(msgs.alias("messages"), *[F.col(c) for c in df.columns if c != messages]))
    else:
        line = F.to_json(msgs)
    df.select(line.alias("value")).write.mode(mode).text(path)


def read_conversations_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-08: blank lines skipped; each line an array of messages; >= 2 messages alternating from
    user; content a string. Returns (ok, quarantined-with-reason)."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    p = raw.select("value", F.from_json("value", MSG_ARRAY).alias("m"))

    def bad_role(x, i):
        return x["role"] != F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))

    reason = (F.when(F.col("m").isNull(), F.lit("not_a_message_list"))
               .when(F.size("m") < 2, F.lit("too_few_messages"))
               .when(F.exists(F.transform("m", bad_role), lambda b: b), F.lit("bad_role"))
               .when(F.exists("m", lambda x: x["content"].isNull()), F.lit("content_not_string")))
    v = p.withColumn("reason", reason)
    return v.where(F.col("reason").isNull()).drop("reason"), v.where(F.col("reason").isNotNull())


# ----------------------------------------------------------------------------- CORE CSV / sweep append


def write_core_csv(results: DataFrame, path: str) -> None:
    """SNK-04: padded task / accuracy / centered rows plus a CORE summary row (accuracy blank)."""
    core = results.agg(F.avg("centered").alias("centered"))
    rows = results.select(F.col("task"), F.format_string("%.6f", "accuracy").alias("acc"),
                          F.format_string("%.6f", "centered").alias("cen")).unionByName(
        core.select(F.lit("CORE").alias("task"), F.lit("").alias("acc"), F.format_string("%.6f", "centered").alias("cen")))
    line = F.concat_ws(", ", F.rpad("task", 35, " "), F.rpad("acc", 10, " "), F.rpad("cen", 10, " "))
    # fixed value: the padded header
    header = F.lit(f"{'Task':<35}, {'Accuracy':<10}, {'Centered':<10}")
    out = rows.select(line.alias("value")).coalesce(1)
    out = results.sparkSession.range(1).select(header.alias("value")).unionByName(out).coalesce(1)
    out.write.mode("overwrite").text(path)


def append_runs(new: DataFrame, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """SNK-05: idempotent append -- rows whose key is already present are skipped. Returns the rows written.

    Only a missing path means that nothing was written yet; any other read error is raised.
    """
    spark = new.sparkSession
    try:
        existing = spark.read.option("header", "true").schema(schema).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = spark.createDataFrame([], schema)
    fresh = cut_lineage(new.join(existing.select(*keys).distinct(), list(keys), "left_anti"))
    fresh.write.mode("append").option("header", "true").csv(path)
    return fresh


# ----------------------------------------------------------------------------- report sections


def slugify(section: Column | str) -> Column:
    c = F.lit(section) if isinstance(section, str) else section
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def report_rows(df: DataFrame, section: str, order: str = "ord", key: str = "key") -> DataFrame:
    """SNK-07: ``- key: value`` rows of a report section. ``df`` holds (ord, key, dval, ival, sval):
    floats -> 4 decimals, ints >= 10000 -> thousands separators, falsy items skipped."""
    value = (F.when(F.col("dval").isNotNull(), F.format_string("%.4f", "dval"))
              .when(F.col("ival") >= 10000, F.format_number("ival", 0))
              .when(F.col("ival").isNotNull(), F.col("ival").cast("string"))
              .otherwise(F.col("sval")))
    falsy = ((F.col("dval").isNull() & F.col("ival").isNull() & (F.coalesce(F.col("sval"), F.lit("")) == "")))
    return df.where(~falsy).select(F.lit(section).alias("section"), slugify(section).alias("slug"), order,
                                   F.concat(F.lit("- "), F.col(key), F.lit(": "), value).alias("line"))


# ----------------------------------------------------------------------------- resharding


#: Row groups of a block, and blocks whose transfer functions one task composes.
BLOCK_GROUPS, FAN = 4096, 64


class Closing:
    """What a stretch of row groups does to the characters that the open shard has when it begins.

    With ``acc`` characters the first shard closes at the first k with ``acc + need[k] >= limit``; ``closes[k]`` shards close in all, and the
    open shard ends with ``out[k]`` characters. If there is no such k, none closes and ``total`` is added. ``need`` grows and ends
    where an empty shard would close, so there are no more entries than row groups of a shard.
    """

    def __init__(self, limit: int, need: Sequence[int], closes: Sequence[int], out: Sequence[int], total: int):
        self.limit, self.need, self.closes, self.out, self.total = limit, need, closes, out, total

    @staticmethod
    def of(chars: Sequence[int], limit: int) -> Closing:
        """The function of single row groups, in order."""
        n, ends = len(chars), list(accumulate(chars))
        closes, out = [0] * (n + 1), [0] * (n + 1)  # from an empty shard at row group k
        for k in range(n - 1, -1, -1):
            close = bisect_left(ends, limit + (ends[k - 1] if k else 0))
            closes[k], out[k] = (1 + closes[close + 1], out[close + 1]) if close < n else (0, ends[-1] - (ends[k - 1] if k else 0))
        reach = min(n, bisect_left(ends, limit) + 1)
        need = [k for k in range(reach) if k == 0 or ends[k] > ends[k - 1]]
        return Closing(limit, [ends[k] for k in need], [1 + closes[k + 1] for k in need], [out[k + 1] for k in need], ends[-1] if n else 0)

    def __call__(self, acc: int) -> tuple[int, int]:
        """(shards closed, characters of the open shard at the end)."""
        k = bisect_left(self.need, self.limit - acc)
        return (self.closes[k], self.out[k]) if k < len(self.need) else (0, acc + self.total)

    def then(self, other: Closing) -> Closing:
        """This stretch and then the other."""
        after = [other(acc) for acc in self.out]
        need, closes, out = list(self.need), [c + d for c, (d, _) in zip(self.closes, after)], [a for _, a in after]
        if not need or need[-1] < self.limit:  # the first shard may close in the other stretch
            need += [self.total + x for x in other.need]
            closes += other.closes
            out += other.out
        stop = bisect_left(need, self.limit) + 1
        return Closing(self.limit, need[:stop], closes[:stop], out[:stop], self.total + other.total)


def shard_of_groups(groups: DataFrame, limit: int, block: int = BLOCK_GROUPS, fan: int = FAN) -> DataFrame:
    """(rg, shard_idx, closes) for dense row groups (rg, chars): a shard closes with the row group at which its characters reach ``limit``.

    The running sum restarts at every close, so no prefix sum gives it. Each block of row groups is turned into its transfer function, the functions of
    ``fan`` neighbours are composed until at most ``fan`` are left, and with what each then begins with the blocks are gone through again,
    all in parallel: no task sees more than a block, or ``fan`` functions.
    """
    spark = groups.sparkSession
    shape = "key long, need array<long>, closes array<long>, out array<long>, total long"
    names = ["need", "closes", "out", "total"]
    read = lambda r: Closing(limit, list(r.need), list(r.closes), list(r.out), int(r.total))
    shown = lambda key, f: pd.DataFrame([(key, f.need, f.closes, f.out, f.total)], columns=["key", *names])

    def first(key, pdf):
        return shown(key[0], Closing.of(pdf.sort_values("rg")["chars"].tolist(), limit))

    def composed(key, pdf):
        return shown(key[0], reduce(Closing.then, map(read, pdf.sort_values("key").itertuples())))

    cut = groups.select((F.col("rg") / block).cast("bigint").alias("key"), "rg", F.col("chars").cast("bigint").alias("chars"))
    levels = [cut_lineage(cut.groupBy("key").applyInPandas(first, shape))]
    while levels[-1].count() > fan:
        up = levels[-1].select((F.col("key") / fan).cast("bigint").alias("parent"), "key", *names)
        levels.append(cut_lineage(up.groupBy("parent").applyInPandas(composed, shape)))

    def entries(functions, acc, shard):
        for key, f in functions:
            yield key, acc, shard
            closed, acc = f(acc)
            shard += closed

    top = sorted(((r.key, read(r)) for r in levels[-1].collect()), key=lambda x: x[0])  # at most ``fan``
    at = "key long, acc long, shard long"
    begins = spark.createDataFrame(list(entries(top, 0, 0)), at)
    for lower in reversed(levels[:-1]):
        def down(key, pdf):
            pdf = pdf.sort_values("key")
            return pd.DataFrame(entries(zip(pdf["key"], map(read, pdf.itertuples())), int(pdf["acc"].iloc[0]), int(pdf["shard"].iloc[0])), columns=["key", "acc", "shard"])

        kids = lower.withColumn("parent", (F.col("key") / fan).cast("bigint")).join(begins.withColumnRenamed("key", "parent"), "parent")
        begins = kids.groupBy("parent").applyInPandas(down, at)

    def replay(pdf):
        pdf = pdf.sort_values("rg")
        acc, shard, shards, closes = int(pdf["acc"].iloc[0]), int(pdf["shard"].iloc[0]), [], []
        for c in pdf["chars"].tolist():
            acc += c
            shards.append(shard)
            closes.append(acc >= limit)
            if closes[-1]:
                acc, shard = 0, shard + 1
        return pd.DataFrame({"rg": pdf["rg"], "shard_idx": shards, "closes": closes})

    return cut.join(begins, "key").groupBy("key").applyInPandas(replay, "rg long, shard_idx long, closes boolean")


def reshard_plan(docs: DataFrame, chars_per_shard: int, rows_per_group: int = ROW_GROUP_ROWS, seed: int = 42,
                 key: str = "doc_id", text: str = "text", drop_tail: bool = True) -> DataFrame:
    """SNK-01 plan: seeded shuffle; a shard closes at the first row-group boundary where its
    characters reach ``chars_per_shard``; documents after the last close are dropped (as the
    reference does) unless ``drop_tail=False``. The close/reset recurrence runs in blocks (:func:`shard_of_groups`)."""
    p = permute(docs.select(key, F.char_length(text).alias("_n")), key, seed=seed, name="pos", n_buckets=1024)
    p = p.withColumn("rg", (F.col("pos") / rows_per_group).cast("bigint"))
    rec = cut_lineage(shard_of_groups(p.groupBy("rg").agg(F.sum("_n").alias("chars")), chars_per_shard))
    if drop_tail:
        last_closed = rec.where("closes").agg(F.max("shard_idx")).scalar()
        rec = rec.where(F.col("shard_idx") <= last_closed)
    first_rg = rec.groupBy("shard_idx").agg(F.min("rg").alias("_r0"))
    out = p.join(rec.select("rg", "shard_idx"), "rg").join(first_rg, "shard_idx")
    return out.select(key, "pos", "shard_idx", (F.col("rg") - F.col("_r0")).alias("rg_idx")).drop("_n")


def write_reshard(docs: DataFrame, plan: DataFrame, path: str, key: str = "doc_id", text: str = "text", rows_per_group: int = ROW_GROUP_ROWS) -> None:
    """SNK-01 files: one folder per shard (``shard=00000``, zero-padded so path order is shard
    order), rows in shuffled order, row groups of ``rows_per_group`` rows, zstd level 3, no dictionary, no
    statistics; each shard is written by one task."""
    d = docs.select(key, text).join(plan, key).withColumn("shard", F.format_string("%05d", "shard_idx"))
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false",
               "parquet.block.row.count.limit": str(rows_per_group), "parquet.block.size": str(1 << 30)}  # rows end a group, not bytes
    (d.repartition("shard").sortWithinPartitions("shard", "pos").select("shard", text)
      .write.mode("overwrite").options(**options).partitionBy("shard").parquet(path))


# ----------------------------------------------------------------------------- run catalog


# fixed value: name of a checkpoint's metadata file below its model tag
META_PATH = r"(?:^|/)(?:tag=)?([^/]+)/meta_(\d+)\.json$"


def checkpoint_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """SRC-16: tag, step and depth (``d<depth>`` in the tag, null without) of checkpoint metadata files; other files are left out."""
    f = files.where(F.col(path).rlike(META_PATH)).select(
        "*", F.regexp_extract(path, META_PATH, 1).alias("tag"), F.regexp_extract(path, META_PATH, 2).cast("bigint").alias("step"))
    depth = F.regexp_extract("tag", r"^d(\d+)", 1)
    return f.withColumn("depth", F.when(depth != "", depth.cast("int")))


def latest_checkpoints(files: DataFrame, path: str = "path") -> DataFrame:
    """SRC-16: last step and number of checkpoints of each tag."""
    return checkpoint_paths(files, path).groupBy("tag", "depth").agg(F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n_checkpoints"))


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """SRC-16: run catalog of checkpoint metadata JSON, one ``tag=<model tag>`` folder per run family.

    The tag comes from partition discovery, the write time from ``_metadata``; the step of files that are named for it, from their name.
    """
    m = spark.read.json(root)
    named = F.regexp_extract(F.col("_metadata.file_path"), META_PATH, 2)
    step = F.coalesce(F.when(named != "", named.cast("bigint")), F.col("step") if "step" in m.columns else F.lit(None).cast("bigint"))
    return m.select(*[c for c in m.columns if c != "step"], step.alias("step"), F.col("_metadata.file_modification_time").alias("mtime"))
