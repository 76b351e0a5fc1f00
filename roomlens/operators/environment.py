"""Daily environment readings: means that skip nulls, ranges and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean a missing reading.
MISSING = ("NA", "N/A", "na", "n/a", "")


def reading(text: Column) -> Column:
    """A number, null for missing marks and bad text."""
    return F.when(~F.trim(text).isin(*MISSING), F.trim(text).try_cast("double"))


def row_mean(*columns: Column) -> Column:
    """Mean of the columns that have a value."""
    x = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), F.size(x))


def checked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with exactly the columns of ``names``, renamed and in their order; raises if one is missing. Header texts are
    compared after trimming."""
    have = {c.strip(): c for c in df.columns}
    missing = [c for c in names if c not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{have[c]}`").alias(n) for c, n in names.items()])


def normalise(df: DataFrame) -> DataFrame:
    """am_mean, daily, rh_daily, temp_range and flag from date, am_min, am_max, pm, rh_am, rh_pm. The flag asks for the two daily
    means, so one reading of a day is enough for each."""
    am = row_mean(F.col("am_min"), F.col("am_max"))
    df = df.withColumn("am_mean", am).withColumn("daily", row_mean(am, F.col("pm"))).withColumn("rh_daily", row_mean(F.col("rh_am"), F.col("rh_pm")))
    no_temp, no_rh = F.col("daily").isNull(), F.col("rh_daily").isNull()
    flag = F.when(F.col("date").isNull(), "date_parse_failed").when(no_temp & no_rh, "missing_temp_and_rh").when(no_temp | no_rh, "partial").otherwise("ok")
    return df.withColumn("temp_range", F.col("am_max") - F.col("am_min")).withColumn("flag", flag)


def merged_status(activity: Column, video: Column, sound: Column, env: Column, upstream: Column) -> Column:
    """Status of a merged window by six rules, the first that holds: no activity, failed video, a sound flag other than ok or the
    known absence of sound, an environment flag other than ok, the upstream status if it says so, a video warning."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(activity.isNull() | F.isnan(activity), "failed")
        .when(low(video) == "failed", "failed")
        .when(~low(sound).isin("", "ok", "manifest_has_audio_false"), "warning")
        .when(~low(env).isin("", "ok"), "warning")
        .when(low(upstream).isin("warning", "failed"), upstream)
        .when(low(video) == "warning", "warning")
        .otherwise("ok")
    )


def worst_status(status: Column) -> Column:
    """Aggregate: failed if a row is, else warning if one is, else ok."""
    level = F.max(F.when(status == "failed", 2).when(status == "warning", 1).otherwise(0))
    return F.when(level == 2, "failed").when(level == 1, "warning").otherwise("ok")
