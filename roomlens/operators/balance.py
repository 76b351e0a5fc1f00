"""Hour-balanced daily series and weekly means. The three balance rules differ on purpose and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import reaches, weighted_mean
from ..functions.time import is_daylight, week_ending_monday, week_start

#: An hour counts if its qualities sum to this at least; a day without sessions needs this many hours.
HOUR_WEIGHT, DAY_HOURS = 2.0, 2


def _hours(df: DataFrame, keys: list[str]) -> list[Column]:
    return [*map(F.col, keys), F.col("start_dt").cast("date").alias("date"), F.hour("start_dt").alias("hour")]


def by_session(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Daylight rows outside caretaker overlap; only rows with a value and quality count towards the floor."""
    keys = keys or ["session_id"]
    f = obs.filter(is_daylight(F.col("start_dt")) & ~F.coalesce("caretaker", F.lit(False)) & F.col("metric").isNotNull() & (F.col("quality") > 0))
    hourly = f.groupBy(*_hours(f, keys)).agg(weighted_mean(F.col("metric"), F.col("quality"), HOUR_WEIGHT).alias("m")).filter("m is not null")
    return hourly.groupBy(*keys, "date").agg(F.avg("m").alias("daily_mean"), F.count("*").alias("hour_bins"))


def by_session_all_rows(obs: DataFrame) -> DataFrame:
    """As above without filters on overlap; rows without a value count towards the floor (quality clipped to 0..1)."""
    f = obs.filter(is_daylight(F.col("start_dt")))
    q = F.least(F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    hourly = f.groupBy(*_hours(f, ["session_id"])).agg(weighted_mean(F.col("metric"), q).alias("m"), F.sum(q).alias("w")).filter(reaches(F.col("w"), HOUR_WEIGHT))
    return hourly.groupBy("session_id", "date").agg(F.avg("m").alias("daily_mean"), F.count("*").alias("hour_bins"))


def by_date(obs: DataFrame) -> DataFrame:
    """One series without sessions; days need ``DAY_HOURS`` hours; window counts are kept."""
    f = obs.filter(is_daylight(F.col("start_dt")) & F.col("metric").isNotNull() & (F.col("quality") > 0))
    hourly = f.groupBy(*_hours(f, [])).agg(weighted_mean(F.col("metric"), F.col("quality"), HOUR_WEIGHT).alias("m"), F.count("*").alias("n")).filter("m is not null")
    daily = hourly.groupBy("date").agg(F.avg("m").alias("daily_mean"), F.count("*").alias("hour_bins"), F.sum("n").alias("windows"))
    return daily.filter(F.col("hour_bins") >= DAY_HOURS)


def weekly(daily: DataFrame, keys: list[str], ending_monday: bool = False) -> DataFrame:
    week = (week_ending_monday if ending_monday else week_start)(F.col("date"))
    return daily.groupBy(*keys, week.alias("week")).agg(F.avg("daily_mean").alias("weekly_mean"), F.count("*").alias("days"))
