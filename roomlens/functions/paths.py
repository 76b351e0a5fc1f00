"""Names from paths of recordings: rooms, sessions, folders; tolerant scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import room_id, safe_folder, slugify

UNKNOWN = "unknown_room"


def parts(path: Column) -> Column:
    """The parts of a path, without empty ones."""
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")


def room_of_path(path: Column) -> Column:
    """The room of the last part that names one; else unknown_room."""
    rooms = F.filter(F.transform(F.reverse(parts(path)), room_id), lambda x: x != UNKNOWN)
    return F.coalesce(F.get(rooms, F.lit(0)), F.lit(UNKNOWN))


def session_of_path(path: Column, room: Column) -> Column:
    """Slug of the folders below the room folder that follows "video" (of the room folder itself if none is below it), or of
    all folders without "video"; the room stands before it unless the slug begins with it."""
    p = parts(path)
    at, n = F.array_position(p, "video").cast("int"), F.size(p)
    below = F.when(n > at + 2, F.slice(p, at + 2, F.greatest(n - at - 2, F.lit(0)))).otherwise(F.slice(p, at + 1, F.greatest(n - at - 1, F.lit(0))))
    own = F.when(at > 0, below).otherwise(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))))
    text = F.when(F.size(own) > 0, F.array_join(own, "_")).otherwise(F.coalesce(F.get(p, n - 2), F.lit("")))
    slug = slugify(text)
    return F.when((room != UNKNOWN) & ~slug.startswith(room), F.concat_ws("_", room, slug)).otherwise(slug)


def display_room(name: Column, room: Column) -> Column:
    """The display name if there is one, else "Room N" of room_N, else the room."""
    number = F.regexp_extract(room, "^room_0*([0-9]+)$", 1)
    return F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.trim(name)).when(number != "", F.concat(F.lit("Room "), number)).otherwise(room)


def folders_of_path(path: Column, name: Column, room: Column, session: Column) -> tuple[Column, Column]:
    """(room folder, session folder): the two parts after "video" in any case, if there are so many, else display names."""
    p = parts(path)
    at, n = F.array_position(F.transform(p, F.lower), "video").cast("int"), F.size(p)
    shown = display_room(name, room)
    first = F.when((at > 0) & (n > at), F.get(p, at)).otherwise(shown)
    second = F.when((at > 0) & (n > at + 2), F.get(p, at + 1)).when((at > 0) & (n > at + 1), F.get(p, at)).otherwise(session)
    return safe_folder(first), safe_folder(second)


def optional_text(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def safe_float(text: Column, default: float | None = None) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default).cast("double"))


def safe_int(text: Column, default: int | None = None) -> Column:
    """A whole number; text with a fraction is none."""
    return F.coalesce(F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("long")), F.lit(default).cast("long"))


def relative_path(path: Column, root: Column, style: str) -> Column:
    """``path`` below ``root`` if style is relative and it lies there, else as it is."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    if style == "absolute":
        return path
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
