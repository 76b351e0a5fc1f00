"""Zone shares, biomarkers, risk, calibration, geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp, distribution, entropy, imbalance, min_max
from .quantiles import percentiles
from .shared import join_keys

ZONES = ("drinking", "feeding", "resting", "open_movement")


def shares(df: DataFrame, window: list[str], value: str) -> DataFrame:
    """Each row's share of its window's sum; equal shares where the sum is not positive."""
    w = Window.partitionBy(*window)
    total, n = F.sum(value).over(w), F.count("*").over(w)
    return df.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(1.0 / n))


def biomarkers(activity: DataFrame, keys: list[str], room: str, order: list[str]) -> DataFrame:
    """One row for each window from zone rows (zone, activity): shares, entropy, imbalance, ratio, transition, mobility."""
    p = activity.groupBy(*keys).pivot("zone", list(ZONES)).agg(F.max("activity"))
    p = p.select(*keys, *[F.coalesce(F.col(z), F.lit(0.0)).alias(z) for z in ZONES])
    p = p.withColumn("activity_mean", (F.col("drinking") + F.col("feeding") + F.col("resting") + F.col("open_movement")) / 4)
    d = distribution([F.col(z) for z in ZONES])
    p = p.select("*", *[x.alias(f"{z}_fraction") for z, x in zip(ZONES, d, strict=True)])
    f = [F.col(f"{z}_fraction") for z in ZONES]
    w = Window.partitionBy(room).orderBy(*order)
    moved = reduce(lambda a, b: a + b, [F.abs(x - F.lag(x).over(w)) for x in f])
    p = p.withColumn("transition", F.coalesce(0.5 * moved, F.lit(0.0)))
    r = Window.partitionBy(room)
    norm = min_max(F.col("activity_mean"), F.min("activity_mean").over(r), F.max("activity_mean").over(r))
    return p.select(
        "*", entropy(f).alias("zone_entropy"), imbalance(f).alias("zone_imbalance"),
        F.when(F.col("feeding") > 0, F.col("drinking") / F.col("feeding")).alias("drinking_to_feeding"),
        clamp(0.7 * norm + 0.3 * F.col("transition")).alias("mobility"))


def risk(low: Column, imbal: Column, cluster: Column, use: Column) -> Column:
    crowd = F.greatest(imbal, cluster)
    penalty = clamp((0.55 - use) / 0.55)
    return clamp(0.38 * low + 0.32 * crowd + 0.20 * cluster + 0.10 * penalty)


def phase(score: Column) -> Column:
    return F.when(score >= 0.66, "during").when(score >= 0.48, "recovery").otherwise("background")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low")


def calibration(df: DataFrame, zone: str, value: str) -> DataFrame:
    """Reference activity of each zone: the largest of its 95th percentile, 0.35 of its maximum, and 1e-4."""
    pos = df.filter(F.col(value) > 0)
    top = join_keys(percentiles(pos, [zone], {value: (0.95,)}).withColumnRenamed(value, "_q"), pos.groupBy(zone).agg(F.max(value).alias("_top")), [zone])
    return top.select(zone, F.greatest(F.col("_q")[0], 0.35 * F.col("_top"), F.lit(1e-4)).alias("reference"))


def calibrated(raw: Column, reference: Column) -> Column:
    return F.sqrt(clamp(raw / reference))


def even_odd(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of edges crossed to its right."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 == y2:
            continue
        cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside = inside != cross
    return inside


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])
