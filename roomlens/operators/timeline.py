"""A replayable timeline: frames of zones by room, and checks of its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contract import ORDER
from .zones import phase, risk_level


def action_slice(offset: Column, length: Column, seconds: int = 10) -> tuple[Column, Column]:
    """[from, to) whole seconds of the middle of a window; at least one second."""
    start = F.floor(offset + F.greatest((length - seconds) / 2, F.lit(0.0)) + 1e-9)
    stop = F.ceil(offset + F.least((length + seconds) / 2, length) - 1e-9)
    return start.cast("long"), F.greatest(stop, start + 1).cast("long")


def frames(zone_rows: DataFrame, scores: DataFrame, room: str, at: str) -> DataFrame:
    """One frame for each room and time: ordinal, zones in order with share and count, score, phase, risk level."""
    per = zone_rows.groupBy(room, at).agg(F.map_from_entries(F.collect_list(F.struct("zone", "n"))).alias("m"), F.sum("n").alias("total"))
    zone = lambda z: F.struct(F.lit(z).alias("zone"), F.coalesce(F.col("m")[z], F.lit(0)).alias("n"), F.round(F.coalesce(F.col("m")[z], F.lit(0)) / F.col("total"), 6).alias("share"))
    x = per.join(scores, [room, at], "left")
    return x.select(room, at, (F.row_number().over(Window.partitionBy(room).orderBy(at)) - 1).cast("long").alias("ordinal"), F.array(*[zone(z) for z in ORDER]).alias("zones"),
                    F.round("risk", 6).alias("score"), phase(F.col("risk")).alias("phase"), risk_level(F.col("risk")).alias("level"))


def document(f: DataFrame, room: str) -> DataFrame:
    """One nested timeline for each room."""
    return f.groupBy(room).agg(F.sort_array(F.collect_list(F.struct("ordinal", "zones", "score", "phase", "level"))).alias("timeline"))


def faults(doc: DataFrame, room: str) -> DataFrame:
    """Broken rules of each timeline."""
    t = F.col("timeline")
    rules = {"empty": F.size(t) == 0, "ordinals": F.exists(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda k: (k <= F.size(t)) & (F.get(t, k - 1)["ordinal"] != k - 1)),
             "zones": F.exists(t, lambda x: F.size(x["zones"]) != len(ORDER)), "score": F.exists(t, lambda x: x["score"].isNotNull() & ((x["score"] < 0) | (x["score"] > 1)))}
    return doc.select(room, F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()).alias("faults"))
