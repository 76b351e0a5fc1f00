"""Sliding windows, containment, limits, runs, sessions, rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(media: DataFrame, window: float = 30.0, stride: float = 10.0) -> DataFrame:
    """Windows of every media row (media_id, duration): full ones at multiples of the stride; a short medium gives one
    partial window, a missing or zero duration one full-length window with a warning."""
    d = F.col("duration")
    last = F.floor((d - window + 1e-9) / stride).cast("int")
    n = F.when(d.isNull() | (d <= 0) | (d < window), F.lit(0)).otherwise(last)
    rows = media.select("media_id", d.alias("d"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    short = (F.col("d") > 0) & (F.col("d") < window)
    return rows.select(
        "media_id",
        F.format_string("w%04d", F.col("k") + 1).alias("window_no"),
        (F.col("k") * stride).alias("start_offset"),
        F.when(short, F.col("d")).otherwise(F.lit(window)).alias("length"),
        F.when(F.col("d").isNull() | (F.col("d") <= 0), "missing_or_zero_duration").when(short, "short_media_partial_window").otherwise("").alias("warnings"),
    )


def contain(points: DataFrame, key: str, at: Column, window: int, stride: int) -> DataFrame:
    """Each row once for every window [k * stride, k * stride + window) that holds ``at``; no range join is needed."""
    hi = F.floor(at / stride).cast("long")
    lo = F.floor((at - window) / stride).cast("long") + 1
    return points.withColumn("window_start", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * stride)))


def first_rows(df: DataFrame, levels: list[tuple[list[str], int]], order: list[Column]) -> DataFrame:
    """Cascaded limits: at most n rows for each key of every level in turn."""
    for keys, n in levels:
        w = Window.partitionBy(*keys).orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return df


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_rows(df, [(keys, 1)], order)


def close_gaps(mask: Column, w) -> Column:
    """A single false row between two true ones becomes true."""
    return mask | (F.coalesce(F.lag(mask).over(w), F.lit(False)) & F.coalesce(F.lead(mask).over(w), F.lit(False)))


def runs(df: DataFrame, key: str, order: list[str], mask: str) -> DataFrame:
    """Runs of true rows of a boolean column: key, run, first order value, rows."""
    w = Window.partitionBy(key).orderBy(*order)
    start = F.col(mask) & ~F.coalesce(F.lag(mask).over(w), F.lit(False))
    r = df.withColumn("_s", start.cast("int")).withColumn("run", F.sum("_s").over(w)).filter(F.col(mask))
    return r.groupBy(key, "run").agg(F.min(order[0]).alias("run_start"), F.count("*").alias("rows"))


def sessionize(df: DataFrame, key: str, at: Column, order: list[str], gap: float) -> DataFrame:
    """A segment number in each key; a new segment where the step is over ``gap`` seconds or unknown."""
    w = Window.partitionBy(key).orderBy(*order)
    step = at - F.lag(at).over(w)
    return df.withColumn("_b", F.coalesce((step > gap).cast("int"), F.lit(1))).withColumn("segment", F.sum("_b").over(w)).drop("_b")


def rolling_mean(x: str, keys: list[str], order: list[str], n: int) -> Column:
    """Mean of the last n rows, null where fewer than min(3, n) have a value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= min(3, n), F.avg(x).over(w))
