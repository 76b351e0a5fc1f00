"""Best-fit packing by minimum bin slack.

Documents become token ids with an end id; those over ``capacity`` are cut into pieces of that length (the last may be
shorter). What must be packed is the table of lengths: at most ``capacity`` rows (length, how many), whatever the number
of documents. Per bin, a subset-sum over bitsets finds the fullest combination of available lengths around the largest
one that is left, which is then removed, at once as often as the counts allow. The table of combinations (a bounded number
of rows) goes back to the pieces: each piece has a rank among those of its length and takes the place of that rank.

Ranks come from counts for each (partition, length) and a running number in the partition, so no length, however common,
meets in one task. Pieces that fill a sequence need no rank.

Cases: null is the empty text, which is one end id; repeated rows are separate pieces; an empty table gives no rows; extra
columns are left out; ties (pieces of one length) take places in the order of partition and row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, trim
from .tokens import tokenizer, with_end

CAPACITY, END_ID = 2048, 0


def fullest(first: int, counts: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths that leaves least slack with ``first`` in the bin; long pieces first."""
    left = room - first
    chosen = {first: 1}
    if left <= 0:
        return chosen
    full, reach, steps = (1 << (left + 1)) - 1, 1, []
    for size in range(left, 0, -1):
        have = counts[size] - (size == first)
        n = min(have, left // size)
        k = 1
        while n > 0:
            k = min(k, n)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & full
            n -= k
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] = chosen.get(size, 0) + k
            at -= size * k
    return chosen


def plan(table: dict[int, int], room: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, bins) from the counts of lengths below ``room``."""
    counts = [0] * (room + 1)
    for size, n in table.items():
        counts[size] = n
    out = []
    for first in range(room, 0, -1):
        while counts[first]:
            chosen = fullest(first, counts, room)
            times = min(counts[s] // k for s, k in chosen.items())
            for s, k in chosen.items():
                counts[s] -= k * times
            out.append((chosen, times))
    return out


def places(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first bin, pieces a bin, offset) for each length of each combination."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for chosen, times in plans:
        offset = 0
        for size, k in sorted(chosen.items(), reverse=True):
            lo = used.get(size, 0)
            rows.append((size, lo, lo + k * times - 1, base, k, offset))
            used[size] = lo + k * times
            offset += size * k
        base += times
    return rows


def pieces(docs: DataFrame, path: str, *, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece, with its partition and its running number among the partition's pieces of its length."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, ends = with_end(*tok.encode(b.column(1)), end_id)
            tokens = np.diff(ends, prepend=0)
            n = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(b)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            size = np.minimum(tokens[doc] - start, capacity)
            lo = (ends - tokens)[doc] + start
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a : a + k]) for a, k in zip(lo.tolist(), size.tolist(), strict=True)]
            # running number among the pieces of one length: those before this batch, and those before it in here
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], size[order])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first
            rank += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int64()), pa.array(rank, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32", "part", "at"])
        trim()

    base = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kind = f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, part long, at long"
    return base.mapInArrow(run, kind)


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id))
    full = cutted.filter(F.col("length") == capacity)
    rest = cutted.filter(F.col("length") < capacity)
    by_part = rest.groupBy("part", "length").agg(F.count("*").alias("n"))
    table = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "lo", "hi", "base", "k", "off")])
    plans = plan(table, capacity)
    runs = spark.createDataFrame(places(plans), schema)
    # one array for each length, at most ``capacity`` of them
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "k", "off"))).alias("runs"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = rest.join(before, ["part", "length"]).join(F.broadcast(runs), "length").withColumn("rank", F.col("before") + F.col("at"))

    hit = F.filter("runs", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") <= x["hi"]))[0]
    done = ranked.withColumn("x", hit).withColumn("step", F.col("rank") - F.col("x.lo"))
    cols = [id_col, "piece", "start", "length", "ids_crc32"]
    short = done.select(*cols, (F.col("x.base") + F.floor(F.col("step") / F.col("x.k"))).alias("sequence_id"), (F.col("x.off") + F.col("step") % F.col("x.k") * F.col("length")).alias("offset"))
    # a piece that fills a sequence is numbered below zero by its partition and running number
    whole = full.select(*cols, (-(F.shiftleft("part", 40) + F.col("at")) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(whole)
