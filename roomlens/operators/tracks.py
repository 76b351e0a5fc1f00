"""Track observations: display zones, room coordinates, evidence, behaviour mixes and summaries, snapshots, window joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import clamp

#: Behaviours in the order of a mix, source zones with the display zone of each, and the room's size in metres (fixed values).
BEHAVIORS = ("active", "feeding", "drinking", "idle", "preening", "perching", "wing_flapping")
DISPLAY = {"drinking_zone": "drinker", "feeding_zone": "feeder", "resting_zone": "resting", "open_movement_zone": "open_movement"}
ROOM_WIDTH, ROOM_DEPTH = 10.8, 16.4


def display_zone(source: Column) -> Column:
    """The display zone of a source zone, in any case and trimmed; open_movement if it has none."""
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    found = F.lit("open_movement")
    for k, v in DISPLAY.items():
        found = F.when(s == k, v).otherwise(found)
    return found


def world(x_norm: Column, y_norm: Column) -> tuple[Column, Column]:
    """Room coordinates around its middle, y turned over, of a place in the image."""
    return F.round(clamp(x_norm) * ROOM_WIDTH - ROOM_WIDTH * 0.5, 4), F.round((1 - clamp(y_norm)) * ROOM_DEPTH - ROOM_DEPTH * 0.5, 4)


def evidence(shares: dict[str, Column], behavior: Column) -> Column:
    """Map of the behaviours with a positive share; without one, the behaviour itself with 1; empty without either."""
    all_of = F.map_from_arrays(F.array(*map(F.lit, shares)), F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in shares.values()]))
    found = F.map_filter(all_of, lambda k, v: v > 0)
    alone = F.map_from_arrays(F.array(F.coalesce(behavior, F.lit(""))), F.array(F.lit(1.0)))
    none = F.map_filter(all_of, lambda k, v: F.lit(False))
    return F.when(F.size(found) > 0, found).when(F.coalesce(behavior, F.lit("")) != "", alone).otherwise(none)


def mix(df: DataFrame, keys: list[str], behavior: str) -> DataFrame:
    """(keys, place, behavior, label, count, value): every listed behaviour in order, 0 where it does not occur, then others by name."""
    n = df.filter(F.col(behavior).isNotNull()).groupBy(*keys, F.col(behavior).alias("behavior")).agg(F.count("*").alias("count"))
    listed = F.array(*map(F.lit, BEHAVIORS))
    totals = n.groupBy(*keys).agg(F.sum("count").alias("_total"), F.map_from_entries(F.collect_list(F.struct("behavior", "count"))).alias("_n"))  # a few labels a key
    names = F.concat(listed, F.array_sort(F.array_except(F.map_keys("_n"), listed)))
    x = totals.select(*keys, "_total", "_n", F.posexplode(names).alias("place", "behavior"))
    count = F.coalesce(F.try_element_at("_n", F.col("behavior")), F.lit(0)).cast("long")
    return x.select(*keys, "place", "behavior", F.initcap(F.replace(F.col("behavior"), F.lit("_"), F.lit(" "))).alias("label"), count.alias("count"), F.round(count / F.col("_total"), 6).alias("value"))


def summary(df: DataFrame, keys: list[str], second: str, track: str, behavior: str, confidence: str, seconds: int, first: str) -> DataFrame:
    """Records, tracks, mean tracks a second over ``seconds``, mean confidence, and the most frequent behaviour, at ties the one seen
    first in the order of ``first``."""
    per_second = df.groupBy(*keys, second).agg(F.countDistinct(track).alias("_t")).groupBy(*keys).agg(F.sum("_t").alias("_t"))
    labels = df.groupBy(*keys, behavior).agg(F.count("*").alias("_n"), F.min(first).alias("_f")).groupBy(*keys).agg(F.max_by(behavior, F.struct("_n", -F.col("_f"))).alias("dominant"))
    x = df.groupBy(*keys).agg(F.count("*").alias("records"), F.countDistinct(track).alias("tracks"), F.round(F.avg(confidence), 6).alias("mean_confidence"))
    return x.join(per_second, keys).join(labels, keys).select(*keys, "records", "tracks", F.round(F.col("_t") / seconds, 3).alias("mean_detected"), "mean_confidence", "dominant")


def snapshots(df: DataFrame, keys: list[str], at: list[str], sums: list[str], latest: list[str]) -> DataFrame:
    """For each track: how often it was seen, sums, and the last known values in the order of ``at``, which grows to later rows."""
    last = F.max_by(F.struct(*latest), F.struct(*at)).alias("_l")
    x = df.groupBy(*keys).agg(F.count("*").alias("count"), *[F.sum(c).alias(f"{c}_sum") for c in sums], F.max(at[0]).alias(f"latest_{at[0]}"), last)
    return x.select(*keys, "count", *[f"{c}_sum" for c in sums], f"latest_{at[0]}", *[F.col(f"_l.{c}").alias(f"latest_{c}") for c in latest])


def in_windows(rows: DataFrame, windows: DataFrame, keys: list[str], second: str, width: int = 60) -> DataFrame:
    """Rows of whole seconds in [floor(offset), ceil(offset + length)) of the windows of their video; both meet by key and a bucket
    of seconds, so a long video is many groups."""
    lo, hi = F.floor(F.col("offset")), F.ceil(F.col("offset") + F.greatest(F.col("length"), F.lit(1.0)))
    w = windows.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    r = rows.withColumn("_b", F.floor(F.col(second) / width))
    return r.join(w, [*keys, "_b"]).filter((F.col(second) >= F.col("_lo")) & (F.col(second) < F.col("_hi"))).withColumn("observed_seconds", F.greatest(F.lit(1), F.col("_hi") - F.col("_lo"))).drop("_b", "_lo", "_hi")


def zone_abnormal(zone: Column, normalized: Column, risk: Column) -> Column:
    """Whether a display zone's activity does not fit the risk: too low at feeder, drinker and in the open, too high at rest."""
    low = zone.isin("feeder", "drinker", "open_movement") & (risk >= 0.60) & (normalized < 0.28)
    return F.coalesce(low | ((zone == "resting") & (risk >= 0.55) & (normalized > 0.68)), F.lit(False))


def state_label(activity: Column, freedom: Column, imbalance: Column, drinking: Column, feeding: Column, open_: Column, resting: Column) -> Column:
    """What a room does, by seven rules in order; the last is that none holds (names and bounds are fixed values)."""
    return (
        F.when(activity <= 0.16, "localized_low_activity")
        .when((imbalance >= 0.60) | (clamp(1 - freedom) >= 0.60), "crowding_proxy")
        .when((feeding >= F.greatest(drinking, open_, resting)) & (feeding >= 0.20), "feeder_focused_activity")
        .when((drinking >= F.greatest(feeding, open_, resting)) & (drinking >= 0.14), "drinker_focused_activity")
        .when((resting >= F.greatest(open_, feeding, drinking)) & (resting >= 0.38), "resting_zone_dominant")
        .when((open_ >= F.greatest(resting, feeding, drinking)) & (open_ >= 0.30), "open_movement_dominant")
        .otherwise("balanced_room_activity")
    )
