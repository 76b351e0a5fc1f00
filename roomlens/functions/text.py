"""Text expressions: names, labels, ranges, fractions, warning lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOM = r"(?i)(?<![A-Za-z0-9])room[\s_]*([0-9]+)(?![0-9])"


def room_id(text: Column) -> Column:
    """room_N from the first "room N" in a text, hyphens read as spaces, without leading zeros; else unknown_room."""
    n = F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(" ")), ROOM, 1)
    return F.when(n == "", F.lit("unknown_room")).otherwise(F.concat(F.lit("room_"), F.regexp_replace(n, "^0+(?=[0-9])", "")))


def slugify(text: Column) -> Column:
    """Lower-case letters and digits joined by single underscores; unknown if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def compare_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def merge_warnings(*texts: Column) -> Column:
    """Distinct entries of semicolon lists in order of first appearance; empty entries and "nan" go."""
    parts = F.flatten(F.array(*(F.transform(F.split(F.coalesce(t, F.lit("")), ";"), lambda x: F.trim(x)) for t in texts)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))), ";")


def merge_warning_items(items: Column) -> Column:
    """As ``merge_warnings`` for a list whose items are not split again and may say "nan"."""
    return F.array_join(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), ";")


def fraction(text: Column) -> Column:
    """"30000/1001" as a number; null for a zero denominator or bad text."""
    p = F.split(text, "/")
    return F.try_divide(F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double"))


def value_range(text: Column) -> tuple[Column, Column]:
    """(low, high) of "3~5", "5-3" or "4"."""
    p = F.transform(F.split(F.regexp_replace(text, "[~–-]", "~"), "~"), lambda x: F.trim(x).try_cast("double"))
    return F.array_min(p), F.array_max(p)


def first_label(text: Column) -> Column:
    return F.lower(F.trim(F.get(F.split(text, "/"), F.lit(0))))


def video_key(session: Column, video: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(session)), F.lower(F.trim(video)))


def safe_folder(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), r"[. ]+$", "")


def title_label(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
