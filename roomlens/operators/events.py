"""Operational events against observations: overlap joins, phase means, differences, matching."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import weighted_mean
from ..functions.time import clock_distance, minute_of_day
from .shared import BROADCAST_BYTES, cut, small_or_plain


def buckets(lo: Column, hi: Column, width: int) -> Column:
    """Time buckets that an interval touches; an equi key for range joins."""
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def overlap_join(rows: DataFrame, events: DataFrame, key: str, how: str, width: int = 86400) -> DataFrame:
    """Rows (key, row_id, lo, hi) that overlap (semi) or do not overlap (anti) an event (key, event_id, e_lo, e_hi) with
    another id; half-open on both sides. Both meet by key and time bucket, so a busy key is many groups."""
    e = events.select(F.col(key).alias("_k"), "event_id", "e_lo", "e_hi", F.explode(buckets(F.col("e_lo"), F.col("e_hi"), width)).alias("_b"))
    r = rows.select(key, "row_id", "lo", "hi", F.explode(buckets(F.col("lo"), F.col("hi"), width)).alias("_b"))
    met = r.alias("r").join(e.alias("e"), (r[key] == e["_k"]) & (r["_b"] == e["_b"]) & (F.col("lo") < F.col("e_hi")) & (F.col("hi") > F.col("e_lo")) & (F.col("row_id") != F.col("event_id")), "left_semi")
    ids = met.select(F.col("row_id").alias("_hit")).distinct()
    return rows.join(ids, rows["row_id"] == ids["_hit"], how)


def phase_rows(rows: DataFrame, anchors: DataFrame, key: str, phases: Sequence[tuple], width: int) -> DataFrame:
    """Rows (key, secs, value, weight) inside [anchor + left, anchor + right) of each phase (name, left, right); a phase (name, left, right, column)
    counts from that column of ``anchors`` instead."""
    at = lambda p: F.col(p[3] if len(p) > 3 else "anchor")
    spans = F.explode(F.array(*[F.struct(F.lit(p[0]).alias("phase"), (at(p) + float(p[1])).alias("lo"), (at(p) + float(p[2])).alias("hi")) for p in phases])).alias("p")
    x = anchors.select("event_id", F.col(key).alias("_k"), spans).select("event_id", "_k", "p.phase", "p.lo", "p.hi")
    x = x.withColumn("_b", F.explode(buckets(F.col("lo"), F.col("hi"), width)))
    r = rows.withColumn("_b", F.floor(F.col("secs") / width).cast("long"))
    return r.join(x, (r[key] == x["_k"]) & (r["_b"] == x["_b"]) & (F.col("secs") >= F.col("lo")) & (F.col("secs") < F.col("hi"))).drop("_b", "_k")


def phase_means(rows: DataFrame, anchors: DataFrame, key: str, phases: Sequence[tuple], every: float, share: float = 0.25, least_weight: float = 1.0, width: int = 86400,
                by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of each event and phase (and of each ``by``), and n, the rows with a value and a positive weight. Null below ``share`` of the rows that a
    phase of its length has when one stands every ``every`` seconds, below one row, and below ``least_weight``. With ``order``, columns of ``rows``, a phase's rows are
    summed one after the other in that order and the weights compared as they come out, so the last bits are those of SQL that reads its table in that order."""
    p = phase_rows(rows, anchors, key, phases, width)
    v, w = F.col("value"), F.col("weight")
    valid = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (w > 0)
    need = F.coalesce(*[F.when(F.col("phase") == x[0], max(math.ceil(share * max(round((x[2] - x[1]) / every), 1)), 1)) for x in phases])
    keys, n = ["event_id", "phase", *by], F.count(F.when(valid, 1)).alias("n")
    if order:
        own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        p = p.select("*", F.sum(F.when(valid, w)).over(own).alias("_w"), F.sum(F.when(valid, v * w)).over(own).alias("_x"))
        m = p.groupBy(*keys).agg(F.when(F.first("_w") >= least_weight, F.first("_x") / F.first("_w")).alias("mean"), n)
    else:
        m = p.groupBy(*keys).agg(weighted_mean(F.when(valid, v), w, least_weight).alias("mean"), n)
    return m.withColumn("mean", F.when(F.col("n") >= need, F.col("mean")))


def differences(means: DataFrame) -> DataFrame:
    """before, during, after and the two differences of each event."""
    one = lambda n: F.max(F.when(F.col("phase") == n, F.col("mean"))).alias(n)
    w = means.groupBy("event_id").agg(one("before"), one("during"), one("after"))
    return w.select("*", (F.col("during") - F.col("before")).alias("immediate"), (F.col("after") - F.col("before")).alias("recovery"))


#: Of a day, slots in which events and their candidates meet; clock minutes of each.
SLOT_MINUTES, SLOTS = 5, 288
#: Rows that a control must have (name, seconds from, seconds to, column, least): eight minutes before, two behind its end, eight further.
COVERAGE = (("before", -600.0, -120.0, "anchor", 4), ("during", 0.0, 120.0, "end", 1), ("after", 120.0, 600.0, "end", 4))


def control_pairs(events: DataFrame, candidates: DataFrame, operations: DataFrame, rows: DataFrame, key: str, *, clock_limit: float = 120.0, least_distance: float = 1800.0,
                  margin: tuple[float, float] = (600.0, 900.0), coverage: Sequence[tuple] = COVERAGE, width: int = 3600) -> DataFrame:
    """Events (key, event_id, start_dt, secs, length) with each candidate (key, row_id, start_dt, secs; one row for a start) that may be their control: at most
    ``clock_limit`` minutes off by the clock, ``least_distance`` seconds away, free of operations (key, lo, hi) from ``margin`` before its start to behind its
    end, and with rows (key, secs) enough. The score is the clock minutes, 60 on the same date, and 0.1 for each day between.

    Candidates are judged before they meet an event, so what is paired is what stays: of a candidate, the first operation that is not over ``margin`` before its start
    bounds the lengths that it has room for, and coverage is counted for the lengths of the key's events. Events and candidates then meet by key, length and five-minute slot of
    the day, so a busy key is many groups and the rest of the day is never paired."""
    lengths = cut(events.select(F.col(key).alias("_k"), "length").distinct())
    spread = lengths.agg(F.min("length").alias("_short"), F.max("length").alias("_long"))
    c = candidates.select(key, "row_id", F.col("start_dt").alias("c_dt"), "secs").crossJoin(F.broadcast(spread))  # one row
    o = operations.groupBy(F.col(key).alias("_k"), F.col("lo").alias("_lo")).agg(F.max("hi").alias("_hi")).withColumn("_b", F.explode(buckets(F.col("_lo"), F.col("_hi"), width)))

    def meet(own: DataFrame, length: str, how: str) -> DataFrame:
        lo, hi = F.col("secs") - margin[0], F.col("secs") + F.col(length) + margin[1]
        r = own.withColumn("_c", F.explode(buckets(lo, hi, width)))
        return r.join(o, (r[key] == o["_k"]) & (F.col("_c") == F.col("_b")) & (F.col("_lo") < hi) & (F.col("_hi") > lo), how)

    # most candidates have no room for the shortest event; a semi-join ends at the first operation that it finds
    own = c.select(key, "secs", "_short", "_long").distinct()
    room = cut(own.join(meet(own, "_short", "left_semi").select(key, "secs").distinct(), [key, "secs"], "left_anti"))
    first = meet(room, "_long", "inner").groupBy(key, "secs").agg(F.min("_lo").alias("_first"))
    spans = room.join(first, [key, "secs"], "left").join(small_or_plain(lengths), F.col(key) == F.col("_k"))
    spans = spans.filter(F.col("_first").isNull() | (F.col("_first") >= F.col("secs") + F.col("length") + margin[1])).select(key, "secs", "length")
    free = cut(spans.select(F.struct(key, "secs", "length").alias("event_id"), key, F.col("secs").alias("anchor"), (F.col("secs") + F.col("length")).alias("end")))
    good = phase_counts(rows, small_or_plain(free, BROADCAST_BYTES // 8), key, coverage, width).filter("covered").select("event_id.*")
    c = candidates.select(key, "row_id", F.col("start_dt").alias("c_dt"), "secs", F.floor(minute_of_day(F.col("start_dt")) / SLOT_MINUTES).cast("int").alias("_t"))
    c = small_or_plain(cut(c.join(good, [key, "secs"])))
    m = minute_of_day(F.col("e_dt"))
    e = events.select(F.col(key).alias("_k"), "event_id", F.col("start_dt").alias("e_dt"), F.col("secs").alias("e_secs"), F.col("length").alias("_length"))
    slots = F.sequence(F.floor((m - clock_limit) / SLOT_MINUTES).cast("int"), F.floor((m + clock_limit) / SLOT_MINUTES).cast("int"))
    e = e.withColumn("_s", F.explode(F.array_distinct(F.transform(slots, lambda s: F.pmod(s, F.lit(SLOTS))))))
    clock, days = clock_distance(F.col("e_dt"), F.col("c_dt")), F.abs(F.datediff("c_dt", "e_dt"))
    x = e.join(c, (c[key] == e["_k"]) & (c["length"] == e["_length"]) & (F.col("_t") == F.col("_s")) & (clock <= clock_limit) & (F.abs(F.col("secs") - F.col("e_secs")) >= least_distance))
    x = x.select(key, "event_id", "e_secs", "length", "row_id", "secs", clock.alias("clock"), days.alias("days"))
    return x.withColumn("score", F.col("clock") + F.when(F.col("days") == 0, 60.0).otherwise(0.0) + 0.1 * F.col("days"))


def match_ranked(pairs: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy("score", "secs", "row_id")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


#: Pairs of a key that one task of a round settles, and the seconds of event starts that go together.
PAIRS_A_ROUND, ROUND_STEP = 500_000, 3600


def match_greedy(pairs: DataFrame, key: str, radius: float, most: int = PAIRS_A_ROUND) -> DataFrame:
    """One control for each event: in the order of their starts, events take the best of their pairs that is ``radius`` seconds or more from all taken before in the key.

    In rounds: of each key, the first events that have ``most`` pairs together (those of one hour at least) are settled one after the other in a task; then all pairs of later
    events within ``radius`` of what was taken go. So no task holds a key, a round leaves less for the next, and rounds are at most a key's pairs over ``most`` and its hours."""
    rest = cut(pairs.withColumn("_b", F.floor(F.col("secs") / radius).cast("long")).withColumn("_h", F.floor(F.col("e_secs") / ROUND_STEP).cast("long")))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, list[float]] = {}
        keep, event = [], None
        x = pdf.sort_values(["e_secs", "event_id", "score", "secs", "row_id"])
        for k, (e, at, b) in enumerate(zip(x["event_id"], x["secs"], x["_b"], strict=True)):
            if e != event and all(abs(at - u) >= radius for d in (b - 1, b, b + 1) for u in taken.get(d, ())):
                taken.setdefault(b, []).append(at)
                keep.append(k)
                event = e
        return x.iloc[keep]

    picks = []
    while True:
        n = rest.groupBy(key, "_h").agg(F.count("*").alias("_n")).withColumn("_to", F.sum("_n").over(Window.partitionBy(key).orderBy("_h")))  # the hours of a key
        last = cut(n.filter((F.col("_to") <= most) | (F.col("_to") == F.col("_n"))).groupBy(F.col(key).alias("_k")).agg(F.max("_h").alias("_last")))
        if last.isEmpty():
            return reduce(DataFrame.unionByName, picks, rest).drop("_b", "_h")
        met = rest.join(small_or_plain(last), F.col(key) == F.col("_k"))
        now = cut(met.filter(F.col("_h") <= F.col("_last")).select(*rest.columns).groupBy(key).applyInPandas(settle, rest.schema))
        picks.append(now)
        near = F.explode(F.array(*[F.col("_b") + d for d in (-1, 0, 1)])).alias("_near")
        taken = small_or_plain(now.select(F.col(key).alias("_t"), F.col("secs").alias("_at"), near))
        later = met.filter(F.col("_h") > F.col("_last")).select(*rest.columns)
        rest = cut(later.join(taken, (later[key] == taken["_t"]) & (later["_b"] == taken["_near"]) & (F.abs(later["secs"] - taken["_at"]) < radius), "left_anti"))


def phase_counts(rows: DataFrame, anchors: DataFrame, key: str, phases: Sequence[tuple], width: int = 86400) -> DataFrame:
    """(event_id, covered): whether each phase, as ``phase_rows`` has them with the least number of rows behind, holds so many."""
    p = phase_rows(rows, anchors, key, [x[:-1] for x in phases], width).groupBy("event_id").agg(*[F.count(F.when(F.col("phase") == n, 1)).alias(n) for n, *_ in phases])
    ok = [F.coalesce(F.col(n), F.lit(0)) >= least for n, *_, least in phases]
    return anchors.select("event_id").join(p, "event_id", "left").select("event_id", (F.size(F.filter(F.array(*ok), lambda x: ~x)) == 0).alias("covered"))


def paired(true: DataFrame, pseudo: DataFrame, by: Sequence[str] = (), phases: tuple[str, str, str] = ("before", "during", "after")) -> DataFrame:
    """Differences in differences: ``true`` and ``pseudo`` are phase means (event_id, phase, mean, and ``by``) of the events and of their controls,
    under the event's id. immediate and recovery of each side against its own first phase, and their differences."""
    sides = true.withColumn("side", F.lit("true")).unionByName(pseudo.withColumn("side", F.lit("pseudo")))
    one = lambda s, p: F.max(F.when((F.col("side") == s) & (F.col("phase") == p), F.col("mean")))
    w = sides.groupBy("event_id", *by).agg(*[(one(s, p) - one(s, phases[0])).alias(f"{s}_{n}") for s in ("true", "pseudo") for p, n in zip(phases[1:], ("immediate", "recovery"), strict=True)])
    return w.select("*", *[(F.col(f"true_{n}") - F.col(f"pseudo_{n}")).alias(f"{n}_difference") for n in ("immediate", "recovery")])
