"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a time without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def is_daylight(ts: Column, first: int = 7, last: int = 16) -> Column:
    return F.hour(ts).between(first, last)


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", d).cast("date")


def week_ending_monday(d: Column) -> Column:
    """First day (Tuesday) of the week that ends on a Monday."""
    return F.date_add(F.date_trunc("week", F.date_sub(d.cast("date"), 1)).cast("date"), 1)


def minute_of_day(t: Column) -> Column:
    """Minutes since midnight, with the whole seconds as their fraction."""
    return F.hour(t) * 60 + F.minute(t) + F.second(t) / 60


def clock_distance(a: Column, b: Column) -> Column:
    """Minutes between two times of day, over midnight if that is nearer."""
    d = F.abs(minute_of_day(a) - minute_of_day(b))
    return F.least(d, 1440 - d)


def local_date(iso: Column) -> Column:
    """The wall-clock date of an ISO text with offset."""
    return F.substring(iso, 1, 10).try_cast("date")


def is_morning(iso: Column) -> Column:
    return F.substring(iso, 12, 2).try_cast("int") < 12


def excel_date(text: Column) -> Column:
    """A date from a day serial or a date text."""
    n = text.try_cast("double")
    return F.when(n.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))).otherwise(text.try_cast("date"))


def parse_time(text: Column) -> Column:
    """A timestamp from ISO or camera text (colons in the date, Z for zero offset); null if neither."""
    t = F.regexp_replace(F.trim(text), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    return F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))


def with_offset(local: Column, zone: str) -> Column:
    """ISO text of a wall-clock time with the offset that the zone has then."""
    minutes = F.round((F.unix_micros(local.cast("timestamp")) - F.unix_micros(F.to_utc_timestamp(local.cast("timestamp"), zone))) / 6e7).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60))


def sampled(seconds: Column, every: float = 10.0, near: float = 1e-6) -> Column:
    """Whether a time is a multiple of ``every``, up to ``near`` above it."""
    return F.pmod(seconds, F.lit(every)) <= near


def candidate_slot(ts: Column) -> Column:
    """The first half minute of every fifth minute."""
    return (F.minute(ts) % 5 == 0) & (F.second(ts) < 30)
