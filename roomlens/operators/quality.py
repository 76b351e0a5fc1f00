"""Row quality: complete rows, weights, training scales, bands, picks, prioritised definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import present
from .quantiles import percentiles


def complete(qualities: list[str], at: str | None = None, since: str | None = None) -> Column:
    """Every quality is above 0, and the time is not before ``since``; null is not above 0."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(q) > 0, F.lit(False)) for q in qualities])
    return ok & (F.col(at) >= F.lit(since).cast("timestamp_ntz")) if since else ok


def weights(values: list[str], qualities: list[str], binary: bool = False) -> list[Column]:
    """Weights of the values: 0 where a value is missing or not finite, else the quality, or whether it is above 0."""
    out = []
    for v, q in zip(values, qualities, strict=True):
        w = F.coalesce(F.when(present(F.col(v)).isNotNull(), F.col(q)), F.lit(0.0))
        out.append((w > 0).cast("double") if binary else w)
    return out


def row_weight(ws: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, ws) / len(ws)


def train_scaled(value: Column, weight: Column, center: Column, scale: Column) -> Column:
    """A value by the training rows' centre and scale; 0 where it is missing or has no weight."""
    return F.when((weight > 0) & present(value).isNotNull(), (value - center) / scale).otherwise(0.0)


def stable_band(df: DataFrame, key: str, x: str, low: float = 0.98, high: float = 1.02) -> DataFrame:
    """Keys whose value lies in a band around the median of all keys. ``df`` has one row a key."""
    m = percentiles(df, [], {x: (0.5,)}).select(F.col(x)[0].alias("_m"))
    return df.crossJoin(F.broadcast(m)).filter((F.col(x) / F.col("_m")).between(low, high)).select(key, x)  # one row


def truthy(*texts: Column) -> Column:
    """All texts say true, in any case."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.lower(F.trim(t.cast("string"))) == "true", F.lit(False)) for t in texts])


def picks(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first, the middle (from 0, half the number rounded down) and the last row of a bounded table."""
    n = df.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    at = F.floor(F.col("_n") / 2)
    name = F.array(F.when(F.col("_i") == 0, "minimum"), F.when(F.col("_i") == at, "median"), F.when(F.col("_i") == F.col("_n") - 1, "maximum"))
    return n.withColumn("pick", F.explode(F.filter(name, lambda x: x.isNotNull()))).drop("_i", "_n")


def first_defined(sources: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """One row for each key, from the first source that has it; within a source the first in ``order``."""
    all_of = reduce(lambda a, b: a.unionByName(b), [s.withColumn("priority", F.lit(k)) for k, s in enumerate(sources)])
    rest = [c for c in all_of.columns if c != key]
    best = all_of.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("priority", *order)).alias("_b"))
    return best.select(key, "_b.*")


def pooled(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Columns centred and scaled in each group by the sample deviation; rows with a null are left out."""
    v = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    s = v.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    x = v.join(s, group)
    return x.select(group, *[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in columns])


def sample_cap(df: DataFrame, keys: list[str], most: int, seed: int = 20260816) -> DataFrame:
    """At most ``most`` rows, those of least hash of the keys and the seed: the same rows in any order and partitioning."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).orderBy("_h", *keys).limit(most).drop("_h")
