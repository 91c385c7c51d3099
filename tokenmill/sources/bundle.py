"""SRC-09: evaluation bundle = YAML task list + per-task JSONL items + baseline CSV.

The task list is a small dimension table (parsed on the driver); items and
baselines are read by Spark. Everything is written and read through Spark
data sources, so the bundle can live on any shared filesystem.
"""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = "label string, icl_task_type string, dataset_uri string, num_fewshot int, continuation_delimiter string"


def write_eval_bundle(spark: SparkSession, items: DataFrame, root: str) -> None:
    """Derived bundle: a multiple-choice task and a language-modelling task over the same items."""
    n_choices = items.agg(F.max(F.size("choices"))).first()[0]
    tasks = [{"label": "bench_mc", "icl_task_type": "multiple_choice", "dataset_uri": "bench_mc.jsonl",
              "num_fewshot": [2], "continuation_delimiter": " "},
             {"label": "bench_lm", "icl_task_type": "language_modeling", "dataset_uri": "bench_lm.jsonl",
              "num_fewshot": [0]}]
    text = yaml.safe_dump({"icl_tasks": tasks})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/core.yaml")
    items.select(F.to_json(F.struct("query", "choices", "gold")).alias("value")) \
         .write.text(f"{root}/eval_data/bench_mc.jsonl")
    items.select(F.to_json(F.struct(F.col("query").alias("context"), "continuation")).alias("value")) \
         .write.text(f"{root}/eval_data/bench_lm.jsonl")
    spark.createDataFrame([("bench_mc", 100.0 / n_choices), ("bench_lm", 0.0)], "`Eval Task` string, `Random baseline` double") \
         .coalesce(1).write.option("header", "true").csv(f"{root}/eval_meta_data.csv")


def read_eval_bundle(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, items with their task label, baselines in percent)."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(f"{root}/core.yaml").collect())
    conf = yaml.safe_load(text)
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]),
             t.get("continuation_delimiter", " ")) for t in conf["icl_tasks"]]
    tasks = spark.createDataFrame(rows, TASK_SCHEMA)
    parts = []
    for label, _, uri, _, _ in rows:
        raw = spark.read.text(f"{root}/eval_data/{uri}")
        parts.append(raw.select(F.lit(label).alias("label"), F.col("value").alias("json")))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    base = spark.read.option("header", "true").schema(
        T.StructType([T.StructField("Eval Task", T.StringType()), T.StructField("Random baseline", T.DoubleType())])
    ).csv(f"{root}/eval_meta_data.csv")
    baselines = base.select(F.col("Eval Task").alias("label"), F.col("Random baseline").alias("baseline"))
    return tasks, items, baselines
