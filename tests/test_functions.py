"""Hand-computed cases of the function library and operators."""

import itertools
import math
import random

import duckdb
from pyspark.sql import functions as F

from roomlens.functions import num, text, time
from roomlens.operators import audio, environment, events, stats, windows, zones


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_room_names(spark):
    cases = {"Room 1": "room_1", "room_3": "room_3", "room1_aug16_17_reference.png": "room_1", "Combined Room 2.xlsx": "room_2", "mystery_file.mp4": "unknown_room", "bathroom 2": "unknown_room", "Room-4": "room_4"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", text.room_id(F.col("t")).alias("r")).collect()} == cases


def test_texts(spark):
    r = one(spark, a=text.slugify(F.lit("  Room 1 (16, 17 Aug)  ")), b=text.slugify(F.lit("--")), c=text.merge_warnings(F.lit("a;b"), F.lit("b;c; nan")),
            d=text.merge_warning_items(F.array(F.lit("a;b"), F.lit("a"))), e=text.fraction(F.lit("30000/1001")), f=text.fraction(F.lit("5/0")), g=text.fraction(F.lit("N/A")),
            h=text.video_key(F.lit(" S1 "), F.lit("V.MP4")), i=text.safe_folder(F.lit('a<b>:"c. ')), j=text.first_label(F.lit(" Feeding/Other")))
    assert r["a"] == "room_1_16_17_aug" and r["b"] == "unknown" and r["c"] == "a;b;c" and r["d"] == "a;b;a"
    assert abs(r["e"] - 29.97002997) < 1e-6 and r["f"] is None and r["g"] is None
    assert r["h"] == "s1|v.mp4" and r["i"] == "a_b___c" and r["j"] == "feeding"


def test_ranges(spark):
    low, high = text.value_range(F.lit("5-3"))
    assert one(spark, low=low, high=high) == {"low": 3.0, "high": 5.0}
    assert one(spark, e=num.interval_error(F.lit(7.0), F.lit(3.0), F.lit(5.0)))["e"] == 2.0


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = one(spark, d=time.clock_distance(ts("2025-01-01 23:50:00"), ts("2025-01-05 00:10:00")), e=time.excel_date(F.lit("45984")), f=time.excel_date(F.lit("bad")),
            g=time.local_date(F.lit("2025-08-16T23:30:00-03:00")), h=time.is_morning(F.lit("2025-08-16T06:00:00-03:00")), i=time.week_ending_monday(F.lit("2025-08-18").cast("date")))
    assert r["d"] == 20 and str(r["e"]) == "2025-11-23" and r["f"] is None and str(r["g"]) == "2025-08-16" and r["h"] is True and str(r["i"]) == "2025-08-12"


def test_shares(spark):
    for z, share, ent, imb in (([1, 1, 1, 1], [0.25] * 4, 1.0, 0.0), ([1, 0, 0, 0], [1, 0, 0, 0], 0.0, 0.75), ([0, 0, 0, 0], [0.25] * 4, 1.0, 0.0)):
        d = num.distribution([F.lit(float(x)) for x in z])
        r = one(spark, s=F.array(*d), e=num.entropy(d), i=num.imbalance(d))
        assert r["s"] == share and abs(r["e"] - ent) < 1e-12 and abs(r["i"] - imb) < 1e-12


def test_min_max(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", None), ("b", 3.0), ("b", 3.0), ("c", 0.0)], "k string, x double")
    from pyspark.sql import Window

    w = Window.partitionBy("k")
    got = sorted((r["k"], r["v"]) for r in df.select("k", num.min_max(F.col("x"), F.min("x").over(w), F.max("x").over(w)).alias("v")).collect())
    assert got[-3:] == [("b", 0.5), ("b", 0.5), ("c", 0.0)] and ("a", 1.0) in got


def test_step_up(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r["i"]: r["q"] for r in stats.step_up(df, [], "p", ["i"]).collect()}
    assert abs(got[1] - 0.03) < 1e-12 and abs(got[2] - 0.04) < 1e-12 and abs(got[3] - 0.04) < 1e-12 and got[4] is None


def test_robust_scale(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 100)], "k int, x double")
    r = stats.robust_center_scale(df, ["k"], "x").first()
    assert r["center"] == 3 and abs(r["scale"] - 39.0128) < 1e-3


def test_gaps_and_runs(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, k, bool(m)) for k, m in enumerate((1, 0, 1, 0, 0, 1))], "k int, o int, m boolean")
    got = [r["c"] for r in df.withColumn("c", windows.close_gaps(F.col("m"), Window.partitionBy("k").orderBy("o"))).orderBy("o").collect()]
    assert got == [True, True, True, False, False, True]
    df = spark.createDataFrame([(1, k, bool(m)) for k, m in enumerate((1, 1, 0, 1))], "k int, o int, m boolean")
    assert sorted(r["rows"] for r in windows.runs(df, "k", ["o"], "m").collect()) == [1, 2]


def test_sliding_windows(spark):
    df = spark.createDataFrame([("a", 65.0), ("b", 0.0), ("c", 12.0), ("d", None)], "media_id string, duration double")
    got = {}
    for r in windows.sliding(df).orderBy("media_id", "window_no").collect():
        got.setdefault(r["media_id"], []).append((r["window_no"], r["start_offset"], r["length"], r["warnings"]))
    assert [x[1] for x in got["a"]] == [0.0, 10.0, 20.0, 30.0] and got["a"][0][0] == "w0001"
    assert got["b"] == got["d"] == [("w0001", 0.0, 30.0, "missing_or_zero_duration")]
    assert got["c"] == [("w0001", 0.0, 12.0, "short_media_partial_window")]


def test_environment(spark):
    df = spark.createDataFrame([("d", 20.0, 24.0, 25.0, 50.0, None), ("d", None, None, None, None, None), ("d", 20.0, None, None, 1.0, None), ("d", 20.0, None, None, None, None)],
                               "date string, am_min double, am_max double, pm double, rh_am double, rh_pm double")
    got = [(r["am_mean"], r["daily"], r["flag"]) for r in environment.normalise(df).collect()]
    assert got == [(22.0, 23.5, "ok"), (None, None, "missing_temp_and_rh"), (20.0, 20.0, "ok"), (20.0, 20.0, "partial")]
    assert one(spark, a=environment.reading(F.lit("n/a")), b=environment.reading(F.lit("x")), c=environment.reading(F.lit(" 2.5 "))) == {"a": None, "b": None, "c": 2.5}


def test_even_odd(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    r = one(spark, a=zones.even_odd(F.lit(1.0), F.lit(1.0), square), b=zones.even_odd(F.lit(3.0), F.lit(1.0), square))
    assert r == {"a": True, "b": False}


def test_weighted_mean_floor(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 5.0), (9.0, 0.0)], "x double, w double")
    r = df.agg(num.weighted_mean(F.col("x"), F.col("w"), 2.0).alias("a"), num.weighted_mean(F.col("x"), F.col("w"), 2.1).alias("b")).first()
    assert r["a"] == 2.0 and r["b"] is None


def test_masks_are_summed_without_a_row_for_each(spark):
    r = random.Random(3)
    rows = [(k, i, r.random() < 0.7, r.choice([True, False, None])) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, a boolean, b boolean")
    s = audio.mask_summary(df, ["k"], ["i"], ["a", "b"], 0.1, 30.0, {"brief": ("a", 5)})
    assert "Generate" not in s._jdf.queryExecution().optimizedPlan().toString()
    for x in s.collect():
        for name, at, most in (("a", 2, 99), ("b", 3, 99), ("brief", 2, 5)):
            sizes = [n for on, g in itertools.groupby(row[at] for row in rows if row[0] == x["k"]) if on and (n := len(list(g))) <= most]
            assert math.isclose(x[f"{name}_occupancy"], sum(sizes) * 0.1 / 30) and math.isclose(x[f"{name}_rate"], len(sizes) * 2)
            assert math.isclose(x[f"{name}_mean_duration"], sum(sizes) * 0.1 / len(sizes) if sizes else 0.0)


def test_weights_that_sum_to_the_floor_reach_it_in_any_order(spark):
    assert 0.06 + 0.57 + 0.37 < 1.0 <= 0.57 + 0.37 + 0.06  # the last bit hangs on the order
    for weights in itertools.permutations((0.06, 0.57, 0.37)):
        df = spark.createDataFrame([(8.0, w) for w in weights], "x double, w double").coalesce(1)
        r = df.agg(num.weighted_mean(F.col("x"), F.col("w"), 1.0).alias("a"), num.weighted_mean(F.col("x"), F.col("w"), 1.001).alias("b")).first()
        assert abs(r["a"] - 8.0) < 1e-9 and r["b"] is None


PAIR = "k int, event_id int, row_id int, score double, secs double, e_secs double, length double, clock double, days int"


def test_greedy_matching_keeps_its_distance(spark):
    rows = [(1, e, 10 + e, float(p), 60.0 * m, float(e), 0.0, 0.0, 0) for e, p, m in ((1, 1, 0), (1, 2, 40), (2, 1, 5), (2, 2, 45), (3, 1, 10))]
    got = {(r["event_id"], r["score"]) for r in events.match_greedy(spark.createDataFrame(rows, PAIR), "k", 1200.0).collect()}
    assert got == {(1, 1.0), (2, 2.0)}


def test_greedy_matching_goes_on_past_fifty_excluded_candidates(spark):
    """60 candidates lie within the radius of the first pick; the second event gets the one far away."""
    secs = lambda df: df.withColumn("secs", F.unix_micros("start_dt") / 1e6)
    ev = secs(spark.sql("SELECT 1L AS k, id AS event_id, timestamp'2024-01-02 10:00:00' AS start_dt, 60D AS length FROM range(1, 3)"))
    ca = secs(spark.sql("SELECT 1L AS k, 100 + id AS row_id, timestamp'2024-01-03 10:00:00' + make_dt_interval(0, 0, 0, id) AS start_dt FROM range(60) UNION ALL SELECT 1L, 900L, timestamp'2024-01-05 11:00:00'"))
    ops = ev.select("k", F.col("secs").alias("lo"), (F.col("secs") + 60).alias("hi"))
    pairs = events.control_pairs(ev, ca, ops, ca.select("k", "secs"), "k", coverage=[("own", 0.0, 1.0, "anchor", 1)])
    got = [tuple(r) for r in events.match_greedy(pairs, "k", 1200.0).orderBy("event_id").select("k", "event_id", "row_id", "score").collect()]
    assert got == [(1, 1, 100, 0.1), (1, 2, 900, 60 + 0.1 * 3)]


def test_greedy_matching_in_rounds_is_the_sequential_choice(spark):
    """Random tables with chains of dependent events, ties of scores and starts, and three keys."""
    rng = random.Random(5)
    for n_events, n_rows, span in ((1, 1, 100), (12, 9, 6000), (40, 60, 30_000), (60, 20, 3000)):
        rows = []
        for k in range(3):
            starts, at = [float(rng.randrange(20)) for _ in range(n_events)], [float(rng.randrange(span)) for _ in range(n_rows)]
            rows += [(k, 1000 * k + e, 5000 * k + r, float(rng.randrange(6)), at[r], starts[e], 60.0, 0.0, 1) for e in range(n_events) for r in range(n_rows) if rng.random() < 0.6]
        want, used = set(), {}
        for k, e, start in sorted({(k, e, start) for k, e, _, _, _, start, *_ in rows}, key=lambda x: (x[0], x[2], x[1])):
            free = [(score, at, r) for k2, e2, r, score, at, *_ in rows if e2 == e and all(abs(at - u) >= 1200.0 for u in used.get(k, []))]
            if free:
                want.add((e, min(free)[2]))
                used.setdefault(k, []).append(min(free)[1])
        got = {(r["event_id"], r["row_id"]) for r in events.match_greedy(spark.createDataFrame(rows, PAIR), "k", 1200.0).collect()}
        assert got == want


def sequential(rows):
    want, used = set(), {}
    for k, e, start in sorted({(r[0], r[1], r[5]) for r in rows}, key=lambda x: (x[0], x[2], x[1])):
        free = [(r[3], r[4], r[2]) for r in rows if r[1] == e and all(abs(r[4] - u) >= 1200.0 for u in used.get(k, []))]
        if free:
            want.add((e, min(free)[2]))
            used.setdefault(k, []).append(min(free)[1])
    return want


def test_greedy_matching_in_rounds_of_any_size(spark):
    r = random.Random(5)
    slots = [[600.0 * s for s in r.sample(range(60), 12)] for _ in range(2)]
    rows = [(e % 2, e, 1000 * e + j, float(r.randrange(40)), at, 900.0 * (e // 3), 0.0, 0.0, 0) for e in range(80) for j, at in enumerate(r.sample(slots[e % 2], 5))]
    pairs = spark.createDataFrame(rows, PAIR)
    for most in (1, 40, 1000):
        assert {(x["event_id"], x["row_id"]) for x in events.match_greedy(pairs, "k", 1200.0, most).collect()} == sequential(rows)
    assert events.match_greedy(pairs.limit(0), "k", 1200.0).count() == 0


def test_candidates_without_room_meet_no_event(spark):
    def shuffled():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(found.apply(k).shuffleWriteRecords() for k in range(found.size()))

    at = F.timestamp_seconds("secs")
    e = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("event_id"), (F.col("id") * 40.0).alias("secs"), F.lit(300.0).alias("length")).withColumn("start_dt", at)
    c = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("row_id"), (F.col("id") * 300.0).alias("secs")).withColumn("start_dt", at)
    before = shuffled()
    got = events.control_pairs(e, c, e.select("k", F.col("secs").alias("lo"), (F.col("secs") + 300.0).alias("hi")), c.select("k", "secs"), "k").collect()
    assert got == [] and shuffled() - before < 50_000  # the 2,000 events and 400 candidates have over 100,000 pairs by the clock alone


def test_phase_means_need_a_quarter_of_the_rows(spark):
    rows = spark.createDataFrame([(1, 10.0 * j, v, w) for j, (v, w) in enumerate([(1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (3.0, 1.0), (9.0, 0.0), (5.0, None)])], "k int, secs double, value double, weight double")
    a = spark.createDataFrame([(7, 1, 0.0, 30.0)], "event_id int, k int, anchor double, end double")
    one = lambda every: events.phase_means(rows, a, "k", [("all", 0.0, 80.0), ("tail", 0.0, 30.0, "end")], every).orderBy("phase").collect()
    assert [tuple(r) for r in one(10.0)] == [(7, "all", 2.0, 2), (7, "tail", 3.0, 1)]
    assert [r["mean"] for r in one(5.0)] == [None, None]  # 2 of 16 rows and 1 of 6 are less than a quarter


def test_phase_means_sum_in_the_order_given(spark):
    """Weights that are 1.0 by their decimals reach it or not by the order in which they are added; so do the last bits of a mean."""
    weights = (0.06, 0.57, 0.37)
    a = spark.createDataFrame([(7, 1, 0.0)], "event_id int, k int, anchor double")
    for order in itertools.permutations(range(3)):
        own = [weights[j] for j in order]
        rows = spark.createDataFrame([(1, float(j), j, 8.1 + j, w) for j, w in enumerate(own)], "k int, secs double, id int, value double, weight double").repartition(3, "secs")
        r = events.phase_means(rows, a, "k", [("all", 0.0, 80.0)], 40.0, order=["id"]).first()
        total, x = 0.0, 0.0
        for j, w in enumerate(own):
            total, x = total + w, x + (8.1 + j) * w
        assert r["n"] == 3 and r["mean"] == (x / total if total >= 1.0 else None)


def test_rounded_is_that_of_the_product(spark):
    x = [17.0615625, 17.061562499999998, -0.0000025, 2.5e-7, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(num.rounded(F.col("x"))).collect()]
    assert got == [v if v is None else math.copysign(math.floor(abs(v * 1e6) + 0.5), v) / 1e6 for v in x]
    assert got == [duckdb.sql(f"SELECT ROUND(CAST({'NULL' if v is None else repr(v)} AS DOUBLE), 6)").fetchall()[0][0] for v in x]


def test_safe_corr_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(num.safe_corr(F.col("x"), F.col("y")).alias("r")).first()["r"] is None
    assert math.isclose(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double").agg(num.safe_corr(F.col("x"), F.col("y")).alias("r")).first()["r"], 1.0)
