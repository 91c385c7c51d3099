"""What the driver must not hold: the side of a join that grows with the input."""

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import scoring
from tokenmill.operators import tokenizer as TK


@pytest.fixture()
def default_limit(spark):
    """Spark's own limit of what is broadcast without a hint."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10485760")
    yield
    spark.conf.set(key, before)


def test_valid_targets_broadcasts_the_vocabulary_not_the_targets(spark, default_limit):
    """Exploded targets look small to Spark and the vocabulary large, whatever their true sizes."""
    ids = [-1, 0, 7, 7, 255, 256, 264, 9999, None]
    each = F.explode(F.array(*[F.lit(i).cast("int") for i in ids])).alias("target")
    v = scoring.valid_targets(spark.range(50).select(each), TK.token_bytes_table(TK.byte_vocab(spark), mode="raw"))
    plan = v._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]
    got = {tuple(r) for r in v.groupBy("target", "token_bytes").count().collect()}
    assert got == {(0, 1, 50), (7, 1, 100), (255, 1, 50)}
