"""Bootstraps from sums: each replicate weighs rows by Poisson numbers, tasks add matrix products up, and replicates are summed over the tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import poisson_weights
from .shared import cut

#: Rows of one task; replicates of a block; of a result.
TASK_ROWS, STEP, OBSERVED = 20_000, 250, -1


def replicate_sums(df: DataFrame, columns: list[str], features: Callable[[pd.DataFrame], np.ndarray], replicates: int = 5000, seed: int = 7) -> DataFrame:
    """(r, sums): for each replicate r the weighted sum over all rows of the vectors that ``features`` makes of them; r = -1 has weights of one.

    Weights are hashes of a row's ``columns`` and the replicate, so neither order nor partitions matter, and rows should differ in them. A task holds one matrix of
    replicates by vector length and sends it once: the shuffle grows with the tasks, of ``TASK_ROWS`` rows each, not with rows times replicates."""
    rows = cut(df.select(*columns))
    parts = max(1, math.ceil(rows.count() / TASK_ROWS))
    rows = rows.withColumn("_id", F.xxhash64(*columns)).repartition(parts, "_id")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x, ids = features(pdf), pdf["_id"].to_numpy().view(np.uint64)
            if total is None:
                total = np.zeros((replicates + 1, x.shape[1]))
            total[0] += x.sum(0)
            for lo in range(0, replicates, STEP):
                hi = min(lo + STEP, replicates)
                total[1 + lo : 1 + hi] += poisson_weights(ids, lo, hi, seed).astype(float).T @ x
        for lo in range(0, 0 if total is None else replicates + 1, STEP):
            own = total[lo : lo + STEP]
            yield pd.DataFrame({"r": np.arange(lo, lo + len(own)) + OBSERVED, "sums": list(own)})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r, s in zip(pdf["r"], pdf["sums"], strict=True):
                total[r] = total[r] + s if r in total else np.array(s)
        if total:
            yield pd.DataFrame({"r": list(total), "sums": list(total.values())}).astype({"r": "int32"})

    shape = "r int, sums array<double>"
    return rows.mapInPandas(weigh, shape).repartition(8, "r").mapInPandas(add, shape)


def statistic_interval(sums: DataFrame, statistic: Callable[[np.ndarray], np.ndarray], names: list[str], interval: str) -> DataFrame:
    """One row: the observed ``names`` of the statistic (sums of several replicates in, a row of values for each out), the central 95 % of ``interval`` over the
    replicates where it is finite, as low and high, and the share of these with at most 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                with np.errstate(divide="ignore", invalid="ignore"):
                    v = statistic(np.array(pdf["sums"].tolist()))
                yield pd.DataFrame({"r": pdf["r"], **{n: v[:, k] for k, n in enumerate(names)}})

    v = sums.mapInPandas(run, ", ".join(["r int", *[f"{n} double" for n in names]]))
    drawn, x = F.col("r") != OBSERVED, F.col(interval)
    ok = F.when(drawn & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf), x)
    q = F.percentile(ok, F.array(F.lit(0.025), F.lit(0.975)))  # one value a replicate
    return v.agg(*[F.max(F.when(~drawn, F.col(n))).alias(n) for n in names], q[0].alias("low"), q[1].alias("high"), F.avg(F.when(ok.isNotNull(), (ok <= 0).cast("double"))).alias("at_most_zero"))
