"""Exact percentiles of groups of any size, by narrowing the ranges that hold the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_keys

#: Rows that one task may sort; buckets into which a range is cut.
ROWS, BUCKETS = 1_000_000, 1024


def _narrowed(long: DataFrame, targets: DataFrame, own: list[str]) -> DataFrame:
    """Each target's range becomes the bucket that holds its rank: its least and largest value, rows below it, its rows."""
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    inside = join_keys(long, targets, own, "inner").filter((x >= lo) & (x <= hi))
    # the ends have buckets of their own, so every round takes rows away, whatever the values between are
    between = F.greatest(F.lit(1), F.least(F.lit(BUCKETS - 2), F.coalesce(F.floor((x - lo) / (hi - lo) * BUCKETS).cast("int"), F.lit(1))))
    at = F.when(x == lo, 0).when(x == hi, BUCKETS - 1).otherwise(between)
    h = inside.groupBy(*own, "_k", "_below", at.alias("_at")).agg(F.count("*").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = Window.partitionBy(*own, "_k").orderBy("_at")  # at most BUCKETS rows
    h = h.withColumn("_to", F.col("_below") + F.sum("_m").over(w))
    return h.filter((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_m"))).select(*own, "_k", (F.col("_to") - F.col("_m")).alias("_below"), F.col("_m").alias("_n"), "_lo", "_hi")


def _ranked(long: DataFrame, targets: DataFrame, own: list[str], rows: int) -> DataFrame:
    """(own, _k, _v): the value of each wanted rank."""
    done = None
    targets = cut(targets)
    while True:
        wide = (F.col("_n") > rows) & (F.col("_lo") != F.col("_hi"))
        ready = targets.filter(~wide)
        done = ready if done is None else done.unionByName(ready)
        targets = cut(targets.filter(wide))
        if targets.isEmpty():
            break
        targets = cut(_narrowed(long, targets, own))
    few = done.filter("_lo <> _hi")
    inside = join_keys(long, few, own, "inner").filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).groupBy(*own, "_k", "_below", "_x").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*own, "_k").orderBy("_x")  # at most ``rows`` rows
    inside = inside.withColumn("_to", F.col("_below") + F.sum("_m").over(w)).filter((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_m")))
    return done.filter("_lo = _hi").select(*own, "_k", F.col("_lo").alias("_v")).unionByName(inside.select(*own, "_k", F.col("_x").alias("_v")))


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, Sequence[float]], rows: int = ROWS) -> DataFrame:
    """``keys`` and for each wanted column an array of its percentiles, interpolated between the two nearest ranks as the built-in aggregate does; null values do not
    count, a group without values has null. One row a group; null keys are a group.

    Where no group has more than ``rows`` rows, the built-in aggregate sorts each in one task. Beyond that, the ranges that hold the wanted ranks are narrowed: a pass
    counts the rows of each of ``BUCKETS`` parts of a range, and the part that holds the rank is the next range, until it has ``rows`` rows at most, or one value. A
    pass shuffles only counts; values that repeat are counted, never gathered."""
    one = lambda c: F.col(c).cast("double")
    n = df.groupBy(*keys).agg(*[f(one(c)).alias(f"_{k}_{i}") for i, c in enumerate(wanted) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    largest = n.agg(*[F.max(f"_n_{i}") for i in range(len(wanted))]).first()
    if max((x or 0 for x in largest), default=0) <= rows:
        return df.groupBy(*keys).agg(*[F.percentile(one(c), F.array(*map(F.lit, p))).alias(c) for c, p in wanted.items()])
    n, own = cut(n), [*keys, "_c"]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), one(c).alias("_x")) for i, c in enumerate(wanted)])).alias("_s")).select(*keys, "_s.*").filter("_x is not null")
    pick = lambda k: F.element_at(F.array(*[F.col(f"_{k}_{i}") for i in range(len(wanted))]), F.col("_c") + 1)
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(j).alias("_j"), F.lit(float(p)).alias("_p")) for i, ps in enumerate(wanted.values()) for j, p in enumerate(ps)])).alias("_s")
    places = n.select("*", asked).select("*", "_s.*").select(*own, "_j", pick("n").alias("_n"), pick("lo").alias("_lo"), pick("hi").alias("_hi"), ((pick("n") - 1) * F.col("_p")).alias("_at")).filter("_n > 0")
    down, up = F.floor("_at").cast("long"), F.ceil("_at").cast("long")
    targets = places.select(*own, F.explode(F.array_distinct(F.array(down, up))).alias("_k"), F.lit(0).cast("long").alias("_below"), "_n", "_lo", "_hi").distinct()
    v = cut(_ranked(long, targets, own, rows))
    met = join_keys(join_keys(places.select(*own, "_j", "_at", down.alias("_d"), up.alias("_u")), v.withColumnRenamed("_k", "_d").withColumnRenamed("_v", "_a"), [*own, "_d"]), v.withColumnRenamed("_k", "_u").withColumnRenamed("_v", "_b"), [*own, "_u"])
    value: Column = F.when(F.col("_d") == F.col("_u"), F.col("_a")).otherwise((F.col("_u") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_d")) * F.col("_b"))
    cell = lambda i, j: F.max(F.when((F.col("_c") == i) & (F.col("_j") == j), value))
    arrays = [F.array(*[cell(i, j) for j in range(len(p))]).alias(c) for i, (c, p) in enumerate(wanted.items())]
    found = met.groupBy(*keys).agg(*arrays)
    out = join_keys(n.select(*keys), found, keys) if keys else found
    return out.select(*keys, *[F.when(reduce(lambda a, b: a | b, [F.col(f"`{c}`")[j].isNotNull() for j in range(len(p))]), F.col(f"`{c}`")).alias(c) for c, p in wanted.items()])
