"""Hand-computed cases of statuses, names, sound rules, tracks and row quality."""

import pytest
from pyspark.sql import functions as F

from roomlens.functions import paths, text, time
from roomlens.operators import audio, environment, events, models, quality, tracks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_room_numbers_have_no_leading_zeros(spark):
    r = one(spark, a=text.room_id(F.lit("Room 01")), b=text.room_id(F.lit("room_000")), c=text.room_id(F.lit("Room\t7x")), d=text.room_id(F.lit(None).cast("string")))
    assert r == {"a": "room_1", "b": "room_0", "c": "room_7", "d": "unknown_room"}


def test_paths(spark):
    rows = [("a/video/Room 1/Day 1/x.mp4", "room_1", "room_1_day_1"), ("video/Room 2/x.mp4", "room_2", "room_2"), ("Room 3/b/room4.mp4", "room_4", "room_4_room_3_b"), ("x.mp4", "unknown_room", "unknown"), (None, "unknown_room", "unknown")]
    p = F.col("p")
    got = spark.createDataFrame(rows, "p string, room string, session string").select("room", "session", paths.room_of_path(p).alias("r"), paths.session_of_path(p, paths.room_of_path(p)).alias("s")).collect()
    assert [(g["r"], g["s"]) for g in got] == [(g["room"], g["session"]) for g in got]
    a, b = paths.folders_of_path(F.lit("x/VIDEO/Room 1/Day: 2/c.mp4"), F.lit(None).cast("string"), F.lit("room_1"), F.lit("s"))
    c, d = paths.folders_of_path(F.lit("x/c.mp4"), F.lit(None).cast("string"), F.lit("room_07"), F.lit("s"))
    r = one(spark, a=a, b=b, c=c, d=d, e=paths.optional_text(F.lit("  ")), f=paths.safe_float(F.lit("x"), 2.0), g=paths.safe_int(F.lit(" 7 ")), h=paths.safe_int(F.lit("7.5"), 1), i=paths.relative_path(F.lit("/r/a/b"), F.lit("/r/"), "relative"), j=paths.relative_path(F.lit("/q/b"), F.lit("/r"), "relative"))
    assert r == {"a": "Room 1", "b": "Day_ 2", "c": "Room 7", "d": "s", "e": None, "f": 2.0, "g": 7, "h": 1, "i": "a/b", "j": "/q/b"}


def test_environment_days(spark):
    rows = [("2025-07-03", 20.0, 24.0, 26.0, 50.0, 60.0), ("2025-07-04", None, 24.0, None, 50.0, None), ("2025-07-05", None, None, None, None, None), ("2025-07-06", None, None, None, 50.0, None), (None, 20.0, 24.0, 26.0, 50.0, 60.0)]
    n = environment.normalise(spark.createDataFrame(rows, "date string, am_min double, am_max double, pm double, rh_am double, rh_pm double")).collect()
    assert [r["flag"] for r in n] == ["ok", "ok", "missing_temp_and_rh", "partial", "date_parse_failed"]
    assert (n[0]["am_mean"], n[0]["daily"], n[0]["rh_daily"], n[0]["temp_range"]) == (22.0, 24.0, 55.0, 4.0) and (n[1]["daily"], n[1]["temp_range"]) == (24.0, None)
    df = spark.createDataFrame([(1, 2)], ["Date ", "x"])
    assert environment.checked(df, {"Date": "date"}).columns == ["date"]
    with pytest.raises(ValueError, match="pm"):
        environment.checked(df, {"Date": "date", "pm": "pm"})


def test_statuses(spark):
    rows = [(None, "ok", "ok", "ok", "ok", "failed"), (1.0, " FAILED", "ok", "ok", "ok", "failed"), (1.0, "ok", "bad", "ok", "ok", "warning"), (1.0, "ok", "manifest_has_audio_false", None, None, "ok"), (1.0, "ok", "", "partial", "ok", "warning"),
            (1.0, "warning", "ok", "ok", "failed", "failed"), (1.0, "Warning", "ok", "ok", "ok", "warning"), (1.0, None, None, None, None, "ok")]
    df = spark.createDataFrame(rows, "a double, v string, s string, e string, u string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", environment.merged_status(*map(F.col, "avseu")).alias("got")).collect())
    w = spark.createDataFrame([(1, "ok"), (1, "warning"), (2, "failed"), (2, "warning"), (3, "ok"), (4, None)], "k int, s string").groupBy("k").agg(environment.worst_status(F.col("s")).alias("w"))
    assert {r["k"]: r["w"] for r in w.collect()} == {1: "warning", 2: "failed", 3: "ok", 4: "ok"}


def test_event_hints(spark):
    cases = [((0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.04), "background_quiet"), ((0.3, 0.3, 0.1, 0.1, 0.1, 0.0, 0.5), "bird_dominant_dense"), ((0.3, 0.2, 0.17, 0.1, 0.1, 0.0, 0.5), "bird_dominant_with_sparse_component"),
             ((0.1, 0.05, 0.09, 0.08, 0.0, 0.0, 0.5), "bird_dominant_sparse"), ((0.05, 0.05, 0.0, 0.2, 0.1, 0.1, 0.5), "background_with_lowfreq_uncertain_events"), ((0.05, 0.05, 0.0, 0.2, 0.11, 0.1, 0.5), "background_with_transient_disturbance"),
             ((0.06, 0.06, 0.0, 0.05, 0.0, 0.0, 0.5), "mixed_bird_and_disturbance"), ((0.06, 0.06, 0.0, 0.0, 0.0, 0.0, 0.5), "background_with_bird_events"), ((0.0, 0.0, 0.0, 0.06, 0.0, 0.0, 0.5), "background_with_nonbird_events"), ((0.0,) * 6 + (0.5,), "background_low_level_activity")]
    df = spark.createDataFrame([(*v, w) for v, w in cases], "a double, b double, c double, d double, e double, f double, g double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", audio.event_hint(*map(F.col, "abcdefg")).alias("got")).collect())


def test_mask_summaries(spark):
    on = "0110111100"
    df = spark.createDataFrame([("w", k, c == "1") for k, c in enumerate(on)] + [("v", 0, False)], "win string, frame int, m boolean")
    got = {r["win"]: r for r in audio.mask_summary(df, ["win"], ["frame"], ["m"], 0.1, 1.0, {"short": ("m", 2)}).collect()}
    w, v = got["w"], got["v"]
    assert abs(w["m_occupancy"] - 0.6) < 1e-9 and w["m_rate"] == 120 and abs(w["m_mean_duration"] - 0.3) < 1e-9 and abs(w["short_occupancy"] - 0.2) < 1e-9 and w["short_rate"] == 60
    assert (v["m_occupancy"], v["m_rate"], v["m_mean_duration"]) == (0.0, 0.0, 0.0)


def test_tracks(spark):
    x, z = tracks.world(F.lit(0.25), F.lit(1.5))
    r = one(spark, x=x, z=z, d=tracks.display_zone(F.lit(" Feeding_Zone")), o=tracks.display_zone(F.lit(None).cast("string")), e=tracks.evidence({"idle": F.lit(0.2), "active": F.lit(0.0)}, F.lit("idle")),
            f=tracks.evidence({"idle": F.lit(None).cast("double")}, F.lit("idle")), g=tracks.evidence({"idle": F.lit(0.0)}, F.lit(None).cast("string")))
    assert r == {"x": -2.7, "z": -8.2, "d": "feeder", "o": "open_movement", "e": {"idle": 0.2}, "f": {"idle": 1.0}, "g": {}}
    df = spark.createDataFrame([("a", "idle"), ("a", "idle"), ("a", "zzz"), ("a", None)], "k string, b string")
    m = tracks.mix(df, ["k"], "b").orderBy("place").collect()
    assert [r["behavior"] for r in m] == [*tracks.BEHAVIORS, "zzz"] and [r["count"] for r in m] == [0, 0, 0, 2, 0, 0, 0, 1] and m[3]["value"] == 0.666667 and m[6]["label"] == "Wing Flapping"
    rows = spark.createDataFrame([("v", s, s % 2) for s in range(12)], "v string, second long, track long")
    w = spark.createDataFrame([("v", 0, 2.5, 3.2), ("v", 1, 9.0, 0.0)], "v string, k int, offset double, length double")
    got = sorted((r["k"], r["second"], r["observed_seconds"]) for r in tracks.in_windows(rows, w, ["v"], "second", width=4).collect())
    assert got == [(0, 2, 4), (0, 3, 4), (0, 4, 4), (0, 5, 4), (1, 9, 1)]
    labels = [((0.1, 1.0, 0.0, 0.3, 0.3, 0.2, 0.2), "localized_low_activity"), ((0.5, 0.3, 0.0, 0.3, 0.3, 0.2, 0.2), "crowding_proxy"), ((0.5, 1.0, 0.0, 0.3, 0.3, 0.2, 0.2), "feeder_focused_activity"), ((0.5, 1.0, 0.0, 0.4, 0.2, 0.2, 0.2), "drinker_focused_activity"),
              ((0.5, 1.0, 0.0, 0.1, 0.1, 0.3, 0.5), "resting_zone_dominant"), ((0.5, 1.0, 0.0, 0.1, 0.1, 0.45, 0.35), "open_movement_dominant"), ((0.5, 1.0, 0.0, 0.1, 0.1, 0.1, 0.2), "balanced_room_activity")]
    df = spark.createDataFrame([(*v, n) for v, n in labels], "a double, b double, c double, d double, e double, f double, g double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", tracks.state_label(*map(F.col, "abcdefg")).alias("got")).collect())


def test_times(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    r = one(spark, a=time.with_offset(t("2025-07-03 12:00:00"), "America/Halifax"), b=time.with_offset(t("2025-12-03 12:00:00"), "America/Halifax"), c=time.sampled(F.lit(20.0000005)), d=time.sampled(F.lit(19.9999)), e=time.candidate_slot(t("2025-01-01 10:05:29")), f=time.candidate_slot(t("2025-01-01 10:05:30")))
    assert r == {"a": "2025-07-03T12:00:00-03:00", "b": "2025-12-03T12:00:00-04:00", "c": True, "d": False, "e": True, "f": False}


def test_row_quality(spark):
    df = spark.createDataFrame([(1, float("nan"), 0.5), (2, 3.0, 0.5), (3, None, 1.0), (4, 5.0, 0.0)], "k int, v double, q double")
    w = quality.weights(["v"], ["q"])[0]
    got = {r["k"]: (r["w"], r["s"]) for r in df.select("k", w.alias("w"), quality.train_scaled(F.col("v"), w, F.lit(1.0), F.lit(2.0)).alias("s")).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.5, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}
    assert {r["pick"]: r["k"] for r in quality.picks(df, [F.col("k")]).collect()} == {"minimum": 1, "median": 3, "maximum": 4}
    assert [r["pick"] for r in quality.picks(df.limit(1), [F.col("k")]).collect()] == ["minimum", "median", "maximum"]
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "b"), (2, "d"), (2, "c")]))
    assert sorted((r["k"], r["v"], r["priority"]) for r in quality.first_defined([a, b], "k", ["v"]).collect()) == [(1, "a", 0), (2, "c", 1)]
    p = quality.pooled(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "g string, x double"), "g", ["x"]).collect()
    assert sorted((r["g"], round(r["x"], 6) if r["x"] is not None else None) for r in p) == [("a", -0.707107), ("a", 0.707107), ("b", None)]


def test_pairs_and_coverage(spark):
    m = lambda b, d, a: spark.createDataFrame([("e", "before", b), ("e", "during", d), ("e", "after", a)], "event_id string, phase string, mean double")
    r = events.paired(m(1.0, 4.0, 2.0), m(1.0, 2.0, None)).first()
    assert (r["true_immediate"], r["pseudo_immediate"], r["immediate_difference"], r["true_recovery"], r["recovery_difference"]) == (3.0, 1.0, 2.0, 1.0, None)
    rows = spark.createDataFrame([("u", float(s)) for s in (-5, -4, 1, 7)], "user_id string, secs double")
    a = spark.createDataFrame([("u", 1, 0.0), ("u", 2, 100.0)], "user_id string, event_id int, anchor double")
    got = {r["event_id"]: r["covered"] for r in events.phase_counts(rows, a, "user_id", (("before", -10.0, 0.0, 2), ("during", 0.0, 5.0, 1), ("after", 5.0, 10.0, 1))).collect()}
    assert got == {1: True, 2: False}
    c = models.cluster_bootstrap(spark.createDataFrame([("k", "s", 1.0), ("k", "s", 2.0)], "k string, c string, x double"), ["k"], "c", "x", replicates=50).first()
    assert c["clusters"] == 1 and c["mean"] == 1.5 and c["low"] is None
