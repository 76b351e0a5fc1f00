"""The folder that driver and executors share, cutting lineage there, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes, as ``byte_count`` has them, is broadcast; beyond it a shuffled join runs.
BROADCAST_BYTES = 24 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder of this machine in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return base or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same by a table in a new place of the shared folder: for rounds that join what they made, since a checkpoint keeps the estimated size, which each join multiplies."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def byte_count(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: 8 for each value, and what texts hold."""
    size = lambda n, kind: F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) + 8 if kind in ("string", "binary") else F.lit(8 * (1 + kind.count(":")))
    total: Column = sum((size(*x) for x in df.dtypes), F.lit(0)).cast("long")
    return df.select(total.alias("n")).agg(F.sum("n")).first()[0] or 0


def small_or_plain(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` bytes, else as it is."""
    return F.broadcast(df) if byte_count(df) <= limit else df


def join_keys(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``many`` with the other columns of ``one``, which has few rows for each of ``keys``, nulls equal; ``one`` is broadcast if small."""
    if not keys:
        return many.crossJoin(F.broadcast(one))  # one row
    own = small_or_plain(one.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in one.columns if c not in keys]))
    met = many.join(own, reduce(lambda a, b: a & b, [many[k].eqNullSafe(own[f"_key_{i}"]) for i, k in enumerate(keys)]), how)
    return met.drop(*[f"_key_{i}" for i in range(len(keys))])
