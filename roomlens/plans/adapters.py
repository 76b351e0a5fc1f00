"""Room-telemetry views of the given tables; each with the SQL text of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE_OF = {"view": "drinking", "click": "feeding", "purchase": "resting", "signup": "open_movement"}

OBS_SQL = """obs AS (SELECT user_id % 3 AS session_id, user_id, event_id AS window_id, ts AS start_dt, value AS metric,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0 AS quality,
 CASE event_type WHEN 'view' THEN 'drinking' WHEN 'click' THEN 'feeding' WHEN 'purchase' THEN 'resting'
  WHEN 'signup' THEN 'open_movement' ELSE 'outside' END AS zone, event_type = 'error' AS caretaker, epoch_us(ts) / 1e6 AS secs FROM events)"""

#: Four positive area shares for each user, made from its number.
GEOM_SQL = """geom AS (SELECT u AS geometry_id, zone, (1 + (u * p) % 7) * 1.0 / SUM(1 + (u * p) % 7) OVER (PARTITION BY u) AS area
 FROM (SELECT DISTINCT user_id % 50 AS u FROM events), (VALUES ('drinking', 3), ('feeding', 5), ('resting', 11), ('open_movement', 13)) z(zone, p))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of three sessions."""
    e = table(spark, sf_dir, "events")
    zone = F.lit("outside")
    for k, v in ZONE_OF.items():
        zone = F.when(F.col("event_type") == k, v).otherwise(zone)
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("double")
    return e.select((F.col("user_id") % 3).alias("session_id"), "user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("start_dt"),
                    F.col("value").alias("metric"), (k / 100.0).alias("quality"), zone.alias("zone"), (F.col("event_type") == "error").alias("caretaker"),
                    (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("secs"))


def geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geometry_id, zone, area) of at most 50 geometries."""
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("geometry_id")).distinct()
    parts = F.array(*[F.struct(F.lit(z).alias("zone"), (1 + (F.col("geometry_id") * p) % 7).alias("part")) for z, p in (("drinking", 3), ("feeding", 5), ("resting", 11), ("open_movement", 13))])
    x = users.select("geometry_id", parts.alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, b: a + b["part"])
    return x.select("geometry_id", F.explode("parts").alias("z"), total.alias("total")).select("geometry_id", "z.zone", (F.col("z.part") / F.col("total")).alias("area"))
