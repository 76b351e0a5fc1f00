"""Regions of activity on a raster of days by times of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import minute_of_day
from ..operators import pixels
from ..operators.shared import cut
from .adapters import obs
from .registry import query

#: Minutes of a column of the raster; rows that make a pixel active.
COLUMN, ACTIVE = 20, 2


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, x, y, n): rows of a session by day, from its first, and by time of day."""
    o = obs(spark, sf_dir).filter("zone in ('feeding', 'open_movement', 'drinking')")
    d = o.select(F.col("session_id").alias("image"), F.datediff("start_dt", F.lit("2024-01-01")).alias("y"), F.floor(minute_of_day(F.col("start_dt")) / COLUMN).cast("int").alias("x"))
    return d.groupBy("image", "x", "y").agg(F.count("*").alias("n"))


@query()
def activity_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of activity that touch each other from day to day: the raster's active pixels are closed by a step and split into components, corners included."""
    r = cut(raster(spark, sf_dir))
    sizes = r.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    mask = r.filter(F.col("n") >= ACTIVE).filter("x >= 0 and y >= 0").select("image", "x", "y")
    return pixels.regions(pixels.labelled_runs(pixels.closed(mask, sizes), diagonal=True))
