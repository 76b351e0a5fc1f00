"""Row numbers and running minima over groups of any size: range partitions, and what each carries over to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_keys

#: Groups up to so many rows are ordered in one task.
ROWS = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` in range partitions by keys and order, numbered by _part, written so that the parts stay. Rows of one place in the order share a part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))


def carried(parts: DataFrame, keys: list[str], value: str, how, after: bool = False) -> DataFrame:
    """``parts`` (keys, _part, value), one row for each key and part, with ``_carry``: the aggregate over the parts before, or after."""
    w = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if after else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_part", how(value).over(w).alias("_carry"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, total: str | None = None, rows: int = ROWS) -> DataFrame:
    """``df`` with the number of each row in its group, from 1, by ``order`` (which should tell rows apart), and the group's size as ``total``."""
    if largest_group(df, keys) <= rows:
        part = Window.partitionBy(*keys)
        out = df.withColumn(name, F.row_number().over(part.orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count("*").over(part)) if total else out
    r = ranged(df, keys, order)
    n = cut(r.groupBy(*keys, "_part").agg(F.count("*").alias("_n")))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    out = join_keys(r.withColumn("_local", local), carried(n, keys, "_n", F.sum), [*keys, "_part"])
    out = out.withColumn(name, (F.col("_local") + F.coalesce("_carry", F.lit(0))).cast("long")).drop("_local", "_carry", "_part")
    return join_keys(out, n.groupBy(*keys).agg(F.sum("_n").alias(total)), keys) if total else out


def running_min(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, rows: int = ROWS) -> DataFrame:
    """``df`` with the least ``value`` from each row to the end of its group in ``order``."""
    ahead = lambda *k: Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    if largest_group(df, keys) <= rows:
        return df.withColumn(name, F.min(value).over(ahead(*keys)))
    r = ranged(df, keys, order)
    low = r.groupBy(*keys, "_part").agg(F.min(value).alias("_low"))
    out = join_keys(r.withColumn("_local", F.min(value).over(ahead(*keys, "_part"))), carried(low, keys, "_low", F.min, after=True), [*keys, "_part"])
    return out.withColumn(name, F.least("_local", "_carry")).drop("_local", "_carry", "_part")


def value_ranks(df: DataFrame, keys: list[str], x: str, counts: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """Each different value of ``x`` in its group with ``n`` rows, its rank with ties given their mean, and the sums of ``counts``. Rows that share a value are
    summed before anything is ordered."""
    v = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (counts or {}).items()])
    upto = lambda *k: F.sum("n").over(Window.partitionBy(*k).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    if largest_group(v, keys) <= rows:
        v = v.withColumn("_to", upto(*keys))
    else:
        r = ranged(v, keys, [F.col(x)])
        tails = r.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
        v = join_keys(r.withColumn("_local", upto(*keys, "_part")), carried(tails, keys, "_n", F.sum), [*keys, "_part"])
        v = v.withColumn("_to", F.col("_local") + F.coalesce("_carry", F.lit(0))).drop("_local", "_carry", "_part")
    return v.withColumn("rank", F.col("_to") - (F.col("n") - 1) / 2).drop("_to")


def blocks(df: DataFrame, order: list[str], n: int, name: str, rows: int = ROWS) -> DataFrame:
    """``df`` cut into ``n`` blocks of rows that follow each other, from 0; the first blocks have one row more where the number does not divide."""
    x = numbered(df, [], [*map(F.col, order)], "_i", "_n", rows)
    size, more = F.floor(F.col("_n") / n), F.col("_n") % n
    big = more * (size + 1)
    at = F.when(F.col("_i") <= big, F.floor((F.col("_i") - 1) / (size + 1))).otherwise(more + F.floor((F.col("_i") - 1 - big) / F.greatest(size, F.lit(1))))
    return x.withColumn(name, at.cast("long")).drop("_i", "_n")
