"""Fits over result tables (FIT-*, JN-11, AGG-21).

Every fit is a distributed aggregate of sufficient statistics (sums of
products) per group; only the tiny normal-equation systems are solved on the
driver (ridge) or in SQL (closed-form quadratic).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def linreg(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """FIT-01: simple linear regression and R^2 per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                               F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def linreg_each(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """FIT-02: one regression per feature (unpivot, then one grouped aggregate), ranked by R^2."""
    long = df.select(y, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                                            for f in features])).alias("f")).select(y, "f.feature", "f.x")
    r = linreg(long, "x", y, ["feature"])
    return r.withColumn("rank", F.rank().over(Window.orderBy(F.desc("r2"))).cast("bigint"))


def ridge(df: DataFrame, features: Sequence[str], y: str, alphas: Sequence[float]) -> list[dict]:
    """FIT-03: ridge regression with an unpenalised intercept for each alpha.

    One distributed aggregate builds the (p+1)^2 Gram matrix and X'y; the
    (p+1)-sized systems are solved on the driver (size fixed by p, not n).
    """
    cols = ["_one"] + list(features)
    d = df.select(F.lit(1.0).alias("_one"), *[F.col(f).cast("double") for f in features], F.col(y).cast("double"))
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    aggs += [F.sum(F.col(a) * F.col(y)).alias(f"v_{i}") for i, a in enumerate(cols)]
    aggs += [F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy")]
    row = d.agg(*aggs).first().asDict()
    p = len(cols)
    G = np.array([[row[f"g_{i}_{j}"] for j in range(p)] for i in range(p)])
    v = np.array([row[f"v_{i}"] for i in range(p)])
    n, yy, sy = G[0, 0], row["yy"], row["sy"]
    out = []
    for a in alphas:
        pen = np.eye(p) * a
        pen[0, 0] = 0.0
        w = np.linalg.solve(G + pen, v)
        sse = yy - 2 * w @ v + w @ G @ w
        sst = yy - sy * sy / n
        out.append({"alpha": float(a), "intercept": float(w[0]), "coefs": [float(c) for c in w[1:]],
                    "weight_norm": float(np.linalg.norm(w[1:])), "r2": float(1 - sse / sst)})
    return out


def ridge_df(spark: SparkSession, fits: list[dict], features: Sequence[str]) -> DataFrame:
    rows = [(f["alpha"], f["intercept"], *f["coefs"], f["weight_norm"], f["r2"]) for f in fits]
    schema = ", ".join(["alpha double", "intercept double"] + [f"coef_{c} double" for c in features]
                       + ["weight_norm double", "r2 double"])
    return spark.createDataFrame(rows, schema)


def isoflop_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """FIT-04: y = a*u^2 + b*u + c with u = log10(x) per group (least squares, Cramer's rule).

    Optimum: 10^(-b/2a) when a > 0, else the raw argmin x of the group (WIN-08).
    Sums are taken on u centred by the group mean for conditioning.
    """
    u = F.log10(F.col(x))
    g = df.withColumn("_u", u).withColumn("_m", F.avg("_u").over(Window.partitionBy(*by)))
    g = g.withColumn("_z", F.col("_u") - F.col("_m"))
    s = g.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum("_z").alias("s1"), F.sum(F.pow("_z", 2)).alias("s2"),
        F.sum(F.pow("_z", 3)).alias("s3"), F.sum(F.pow("_z", 4)).alias("s4"), F.sum(y).alias("t0"),
        F.sum(F.col("_z") * F.col(y)).alias("t1"), F.sum(F.pow("_z", 2) * F.col(y)).alias("t2"),
        F.first("_m").alias("m"), F.min_by(x, F.struct(F.col(y), F.col(x))).alias("raw_opt"))
    s4, s3, s2, s1, s0, t2, t1, t0 = (F.col(c) for c in ("s4", "s3", "s2", "s1", "s0", "t2", "t1", "t0"))

    def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31)

    D = det3(s4, s3, s2, s3, s2, s1, s2, s1, s0)
    A = det3(t2, s3, s2, t1, s2, s1, t0, s1, s0) / D
    Bz = det3(s4, t2, s2, s3, t1, s1, s2, t0, s0) / D
    Cz = det3(s4, s3, t2, s3, s2, t1, s2, s1, t0) / D
    m = F.col("m")
    # back from centred z = u - m to u: a u^2 + (b - 2am) u + (a m^2 - b m + c)
    out = s.select(*by, A.alias("a"), (Bz - 2 * A * m).alias("b"), (A * m * m - Bz * m + Cz).alias("c"), "raw_opt")
    opt = F.when(F.col("a") > 0, F.pow(F.lit(10.0), -F.col("b") / (2 * F.col("a")))).otherwise(F.col("raw_opt"))
    return out.withColumn("opt_x", opt)


def power_law(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """FIT-05: log-log slope (exponent) and intercept per group."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.log10(x).alias("_lx"), F.log10(y).alias("_ly"))
    return d.groupBy(*by).agg(F.regr_slope("_ly", "_lx").alias("exponent"), F.regr_intercept("_ly", "_lx").alias("log_coef"),
                              F.min(F.pow(F.lit(10.0), "_lx")).alias("x_min"), F.max(F.pow(F.lit(10.0), "_lx")).alias("x_max"))


def ratio_at_reference(pl: DataFrame) -> DataFrame:
    """FIT-06: prediction at the geometric mean of each group's x range."""
    xref = F.sqrt(F.col("x_min") * F.col("x_max"))
    return pl.withColumn("x_ref", xref).withColumn(
        "y_ref", F.pow(F.lit(10.0), F.col("log_coef") + F.col("exponent") * F.log10(xref)))


def apply_models(df: DataFrame, models: DataFrame, x: str, key: str, n_models: int | None = None) -> DataFrame:
    """FIT-07: apply per-group linear models (one row per group); callers average two predictors.

    The model table is broadcast only when its row count is known to be small.
    """
    from tokenmill.operators.ordering import checked_broadcast
    m = checked_broadcast(models, n_models) if n_models is not None else models
    return df.join(m, key).withColumn("pred", F.col("intercept") + F.col("slope") * F.col(x))


def row_mean(arr: str | Column) -> Column:
    """FIT-08: mean of a numeric array."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / F.size(a)


def interp(points: DataFrame, xs: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """JN-11: linear interpolation of y at query xs, ends clamped.

    As-of on both sides without pairs: points and queries are unioned, and
    the nearest point below/above comes from ``last/first(ignorenulls)``
    windows in x order.
    """
    p = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                      F.lit(0).alias("_q"))
    q = xs.select(*by, F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"),
                  F.lit(1).alias("_q"))
    u = p.unionByName(q)
    w = Window.partitionBy(*by).orderBy("_x", "_q")
    below = w.rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*by).orderBy("_x", F.desc("_q")).rowsBetween(0, Window.unboundedFollowing)
    pt = F.when(F.col("_q") == 0, F.struct("_x", "_y"))
    u = u.withColumn("_lo", F.last(pt, ignorenulls=True).over(below)).withColumn("_hi", F.first(pt, ignorenulls=True).over(above))
    lo, hi = F.col("_lo"), F.col("_hi")
    t = (F.col("_x") - lo["_x"]) / (hi["_x"] - lo["_x"])
    val = (F.when(lo.isNull(), hi["_y"]).when(hi.isNull(), lo["_y"])
            .when(hi["_x"] == lo["_x"], lo["_y"]).otherwise(lo["_y"] + t * (hi["_y"] - lo["_y"])))
    return u.where(F.col("_q") == 1).select(*by, F.col("_x").alias(x), val.alias("y_interp"))


def effective_params(df: DataFrame, definition: Callable[[DataFrame], Column], tokens: str = "tokens_trained") -> DataFrame:
    """AGG-21: effective parameter count under a pluggable definition, and tokens per parameter."""
    return df.withColumn("effective_params", definition(df)).withColumn(
        "tokens_per_param", F.col(tokens) / F.col("effective_params"))


def default_effective(df: DataFrame) -> Column:
    """Default definition: transformer matrices + lm head."""
    return F.col("params_transformer") + F.col("params_lm_head")
