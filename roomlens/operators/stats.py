"""Robust scales, ranks, step-up adjustment, agreement and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import safe_corr
from .order import ROWS, largest_group, numbered, running_min
from .quantiles import percentiles
from .shared import join_keys


def robust_center_scale(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median, and the largest of the scaled MAD, the scaled IQR, the population deviation and 1e-6."""
    v = df.filter(F.col(x).isNotNull())
    q = percentiles(v, keys, {x: (0.25, 0.5, 0.75)}).withColumnRenamed(x, "_q")
    c = join_keys(q, v.groupBy(*keys).agg(F.stddev_pop(x).alias("_sd")), keys)
    away = join_keys(v.select(*keys, x), c, keys).withColumn("_away", F.abs(F.col(x) - F.col("_q")[1]))
    both = join_keys(c, percentiles(away, keys, {"_away": (0.5,)}), keys)
    scale = F.greatest(1.4826 * F.col("_away")[0], (F.col("_q")[2] - F.col("_q")[0]) / 1.349, F.col("_sd"), F.lit(1e-6))
    return both.select(*keys, F.col("_q")[1].alias("center"), scale.alias("scale"))


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank with ties given their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    v = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = v.select(*keys, average_rank(x, keys).alias("_rx"), average_rank(y, keys).alias("_ry"))
    return r.groupBy(*keys).agg(safe_corr(F.col("_rx"), F.col("_ry")).alias("rho"), F.count("*").alias("n"))


def step_up(df: DataFrame, keys: list[str], p: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """Benjamini-Hochberg: running minimum from the largest p of p * m / rank, at most 1; null p stay null. Beyond ``rows`` rows of a group, ranks and minima go
    over range partitions."""
    if largest_group(df, keys) <= rows:
        part = Window.partitionBy(*keys, F.col(p).isNull())
        df = df.withColumn("_rn", F.row_number().over(part.orderBy(p, *order))).withColumn("_m", F.count("*").over(part))
        low = F.min(F.col(p) * F.col("_m") / F.col("_rn")).over(part.orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("q", F.when(F.col(p).isNotNull(), F.least(low, F.lit(1.0)))).drop("_rn", "_m")
    x = numbered(df.filter(F.col(p).isNotNull()), keys, [F.col(p), *map(F.col, order)], "_rn", "_m", rows)
    x = running_min(x.withColumn("_t", F.col(p) * F.col("_m") / F.col("_rn")), keys, [F.col("_rn")], "_t", "_low", rows)
    x = x.withColumn("q", F.least("_low", F.lit(1.0))).drop("_rn", "_m", "_t", "_low")
    return x.unionByName(df.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    sums = [t.agg(F.sum(pairs(F.col("n"))).alias(k), F.sum("n").alias(f"n_{k}")) for k, t in (
        ("c", cells), ("x", cells.groupBy(a).agg(F.sum("n").alias("n"))), ("y", cells.groupBy(b).agg(F.sum("n").alias("n"))))]
    s = sums[0].crossJoin(F.broadcast(sums[1])).crossJoin(F.broadcast(sums[2]))  # three rows of totals
    expected = F.try_divide(F.col("x") * F.col("y"), pairs(F.col("n_c")))
    return s.select(F.col("n_c").alias("n"), F.coalesce(F.try_divide(F.col("c") - expected, (F.col("x") + F.col("y")) / 2 - expected), F.lit(1.0)).alias("ari"))
