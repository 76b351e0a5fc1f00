"""Streams of observations: sliding windows, gap sessions, and the step between successive distributions.

The reference behaviours are batch; these are the same rules over unbounded input, with late rows bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.zones import ZONES


def sliding_means(obs: DataFrame, window: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Count and mean of each session's value in sliding event-time windows."""
    w = obs.withWatermark("ts", late).groupBy("session_id", F.window("ts", window, slide).alias("w"))
    return w.agg(F.count("value").alias("n"), F.avg("value").alias("mean")).select("session_id", F.col("w.start").alias("window_start"), "n", "mean")


def gap_sessions(obs: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Segments of each session that end after a gap."""
    w = obs.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("segment_start"), F.col("w.end").alias("segment_end"), "n")


def distribution_steps(shares: DataFrame) -> DataFrame:
    """Total variation distance of each room's zone distribution to the one before it; the first is 0. State: the last
    distribution of each room. ``shares``: (room_id, ts, one column for each zone)."""
    cols = list(ZONES)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        rows = []
        for r in pdf.itertuples(index=False):
            now = [float(getattr(r, c)) for c in cols]
            rows.append((key[0], r.ts, 0.5 * sum(abs(a - b) for a, b in zip(now, last, strict=True)) if last else 0.0))
            last = now
        state.update(tuple(last))
        yield pd.DataFrame(rows, columns=["room_id", "ts", "transition"])

    kind = dict(shares.dtypes)["room_id"]
    return shares.groupBy("room_id").applyInPandasWithState(
        step, f"room_id {kind}, ts timestamp, transition double", ", ".join(f"{c} double" for c in cols), "append", GroupStateTimeout.NoTimeout)


def append_batches(df: DataFrame, path: str, checkpoint: str):
    """Write a stream to Parquet, batch by batch; a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
