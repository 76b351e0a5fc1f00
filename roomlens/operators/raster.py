"""Zone masks over a pixel grid, as joins of an exploded grid with polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """One row for each pixel centre."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))


def contains(px: Column, py: Column, polygon: Column) -> Column:
    """Even-odd test of a point against an array<array<double>> column of corners."""
    n = F.size(polygon)

    def cross(k: Column) -> Column:
        a, b = polygon[k], polygon[(k + 1) % n]
        slope = F.try_divide((b[0] - a[0]) * (py - a[1]), b[1] - a[1])
        return F.when((a[1] > py) != (b[1] > py), px < slope + a[0]).otherwise(False)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda acc, k: acc != cross(k))


def masks(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, x, y) of pixels inside a zone's polygon. ``zones`` is a small dimension (zone_id, polygon)."""
    z = F.broadcast(zones)
    return pixels.join(z, contains(F.col("x") + 0.5, F.col("y") + 0.5, F.col("polygon"))).select("zone_id", "x", "y")


def mask_report(mask: DataFrame) -> DataFrame:
    """Pixels of each zone, and how many of them are in another zone too."""
    shared = mask.groupBy("x", "y").agg(F.count("*").alias("k"))
    return mask.join(shared, ["x", "y"]).groupBy("zone_id").agg(F.count("*").alias("pixels"), F.count(F.when(F.col("k") > 1, 1)).alias("overlap"))


def scale(polygon: Column, fx: float, fy: float) -> Column:
    """Corners scaled and rounded half to even."""
    return F.transform(polygon, lambda p: F.array(F.rint(p[0] * fx), F.rint(p[1] * fy)))


def polygons(many: Column, one: Column) -> Column:
    """The polygons of a zone: its list without empty ones, or if there is none its single polygon, or none."""
    some = F.filter(many, lambda p: p.isNotNull() & (F.size(p) > 0))
    none = F.filter(F.array(one), lambda p: F.lit(False))
    return F.when(F.size(many) > 0, some).when(F.size(one) > 0, F.array(one)).otherwise(none)


def usable(found: Column) -> Column:
    """Polygons with at least three corners, rounded half to even."""
    return F.transform(F.filter(found, lambda p: F.size(p) >= 3), lambda p: F.transform(p, lambda c: F.transform(c, lambda x: F.rint(x))))


def by_type(zones: DataFrame, kinds: tuple[str, ...] = ("drinking", "feeding", "resting", "open_movement")) -> DataFrame:
    """(kind, polygon) of zones (semantic_type, zone_id, polygons, polygon): the type, else the id, without "_zone"."""
    kind = F.replace(F.coalesce(F.nullif(F.col("semantic_type"), F.lit("")), F.col("zone_id")), F.lit("_zone"), F.lit(""))
    p = F.explode(usable(polygons(F.col("polygons"), F.col("polygon"))))
    return zones.select(kind.alias("kind"), p.alias("polygon")).filter(F.col("kind").isin(*kinds))


def assigned(pixels: DataFrame, zones: DataFrame, order: tuple[str, ...] = ("drinking", "feeding", "resting", "open_movement"), grow: int = 0) -> DataFrame:
    """(x, y, code) of every pixel: the number, from 1, of the first kind in ``order`` that holds it, 0 outside. ``grow`` above 0 spreads each
    kind by a disc of so many pixels, below 0 takes that from it; pixels beyond the image do not count against a kind."""
    code = F.array_position(F.array(*map(F.lit, order)), F.col("kind")).cast("int")
    m = masks(pixels, zones.select(code.alias("zone_id"), "polygon")).distinct()
    r = abs(grow)
    if r:
        disc = [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r]
        around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc])).alias("d")
        move = lambda df: df.select("*", around).withColumn("x", F.col("x") + F.col("d.dx")).withColumn("y", F.col("y") + F.col("d.dy")).drop("d")
        if grow > 0:
            m = move(m).distinct().join(pixels, ["x", "y"], "left_semi")
        else:
            # a pixel goes if one of the disc around it lies in the image but not in the kind
            kinds = m.select("zone_id").distinct()
            out = pixels.join(F.broadcast(kinds)).join(m, ["zone_id", "x", "y"], "left_anti")
            m = m.join(move(out).distinct(), ["zone_id", "x", "y"], "left_anti")
    first = m.groupBy("x", "y").agg(F.min("zone_id").alias("code"))
    return pixels.join(first, ["x", "y"], "left").select("x", "y", F.coalesce("code", F.lit(0)).alias("code"))
