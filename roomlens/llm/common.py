"""Helpers shared by the corpus operators: shared folders, checked broadcasts, word splitting."""

from __future__ import annotations

import ctypes
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint_dir

#: A side of at most so many bytes, as ``byte_count`` has them, is broadcast; beyond it a plain join runs.
BROADCAST_BYTES = 24 * 1024 * 1024

#: Arrow batches handed to Python hold at most so many rows and bytes, so a worker's memory is bounded.
BATCH_ROWS, BATCH_BYTES = 400, 8 * 1024 * 1024

_WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one in local mode (tests), an error on a cluster."""
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches given to Python by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def trim() -> None:
    """Give memory back to the system where a partition ends: Python workers are reused in turn by later stages and would keep the
    most that any stage needed; so idle workers hold no tokenizer, whose table is made anew for each partition."""
    tokens = sys.modules.get("roomlens.llm.tokens")
    if tokens is not None:
        tokens._OPEN.clear()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def byte_count(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: 8 for each value, and what texts, bytes and arrays hold."""
    def size(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if kind.startswith("array<"):
            inner = kind[6:-1]
            one = F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 8) if inner in ("string", "binary") else F.size(c) * 8 * (1 + inner.count(":"))
            return F.greatest(F.coalesce(one, F.lit(0)), F.lit(0)) + 8
        return F.lit(8 * (1 + kind.count(":")))

    return df.select(sum((size(*x) for x in df.dtypes), F.lit(0)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` may be broadcast: it has at most ``limit`` bytes."""
    return byte_count(df) <= limit


def small_or_plain(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` bytes, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if small(df, limit) else df


def join_hot(many: DataFrame, one: DataFrame, key: str, how: str = "inner", spread: int = 32) -> DataFrame:
    """``many`` joined with ``one``, which has one row for each ``key``, where a key may have a great share of the rows of
    ``many``: ``one`` is broadcast if it is small, else each of its rows stands ``spread`` times and the rows of a key are dealt
    over these."""
    if small(one):
        return many.join(F.broadcast(one), key, how)
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.lit(spread)))
    return dealt.join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).cast("long")), [key, "_salt"], how).drop("_salt")


def utf8(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes; null becomes the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def held_out(id_col: str) -> Column:
    """True for rows whose crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def alnum_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """CRC-32 of each word as uint64."""
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` consecutive items of ``h``."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:size].copy()
        for k in range(1, n):
            out *= np.uint64(0x100000001B3 * 2 + 1)
            out += h[k : k + size]
    return mix(out)
