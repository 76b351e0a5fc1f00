"""Sources, sinks, records, timelines, rasters and streams on small inputs."""

import json
import wave

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomlens.operators import audio, contract, models, raster, timeline
from roomlens.sources import pcm, tables
from roomlens.streaming import live


def test_listing_and_limits(spark, tmp_path):
    for p in ("Room 1/b.mp4", "Room 1/A.mp4", "room_2/c.mp4", "other/d.mp4", "Room 1/x.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = [(r["media_id"], r["path"].rsplit("/", 1)[1], r["room_id"]) for r in tables.list_files(spark, str(tmp_path), "*.mp4", exclude=["unknown_room"]).orderBy("media_id").collect()]
    assert got == [("media_000001", "A.mp4", "room_1"), ("media_000002", "b.mp4", "room_1"), ("media_000003", "c.mp4", "room_2")]
    assert tables.list_files(spark, str(tmp_path), "*.mp4", include=["room_2"]).count() == 1


def test_missing_tables_and_columns(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    assert tables.read_if_exists(spark, str(tmp_path / "none"), schema).count() == 0
    df = tables.conform(spark.createDataFrame([(float("nan"),)], "b double"), schema)
    assert df.columns == ["a", "b"] and tables.nan_to_null(df).first()["b"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Room 1", "a:b", None), ("Room 2", "c", 2.0)], "room string, session string, v double")
    tables.write_partitioned(df, str(tmp_path / "p"), "room", "session")
    assert (tmp_path / "p" / "room_folder=Room 1" / "session_folder=a_b").exists()
    tables.write_records(df, str(tmp_path / "r"))
    assert '"v":null' in "".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect())
    tables.write_table(df, str(tmp_path / "t"), csv=True)
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2 == spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count()


def test_config_and_stages(spark, tmp_path):
    c = tables.RunConfig.load('{"window_seconds": 5, "rooms": ["room_1"], "unknown": 1}', max_media=2, max_windows=None)
    assert (c.window_seconds, c.stride_seconds, c.rooms, c.max_media, c.max_windows) == (5, 10.0, ("room_1",), 2, None)
    assert tables.stages({"video"}) == ["index", "zones", "video"] and tables.stages({"all"})[-1] == "merge"
    f = tmp_path / "c.json"
    f.write_text(json.dumps([{"session_id": "a", "w": 1}, {"session_id": "b", "w": 2}]))
    assert tables.read_config(spark, str(f), "b").first()["w"] == 2


def test_wave_frames_and_spectrum(spark, tmp_path):
    rate = 8000
    x = (np.sin(2 * np.pi * 1000 * np.arange(rate * 2 + 100) / rate) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    f = pcm.frames(spark, str(tmp_path / "a.wav"))
    assert f.count() == 3
    s = audio.spectral(f, rate).orderBy("frame").first()
    assert abs(s["centroid"] - 1000) < 5 and abs(s["rolloff"] - 1000) < 5 and abs(s["rms"] - 20000 / 32768 / np.sqrt(2)) < 1e-3 and abs(s["zero_crossing"] - 0.25) < 0.01


def test_record_errors_and_json(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "drinking", 3, 2.0), (1, "2024-01-01", "resting", 1, 6.0)], "session_id long, date string, zone string, n long, mean double")
    r = contract.records(df, ["session_id", "date"])
    one = r.select(contract.to_text(F.col("record")).alias("t"), contract.errors(F.col("record")).alias("e"), "record").first()
    assert json.loads(one["t"])["zones"][1] == {"zone": "feeding", "share": None, "n": None} and one["e"] == [] and one["record"]["mean"] == 3.0
    bad = r.withColumn("record", F.col("record").withField("version", F.lit("x")).withField("date", F.lit("no")))
    assert bad.select(contract.errors(F.col("record")).alias("e")).first()["e"] == ["version", "date"]
    assert contract.audit(r, ["session_id", "date"]).first().asDict() == {"records": 1, "distinct_keys": 1, "faulty": 0, "max_error": 0.0, "absent_zones": 3}


def test_timeline(spark):
    a, b = timeline.action_slice(F.lit(40.0), F.lit(30.0))
    assert tuple(spark.range(1).select(a, b).first()) == (50, 60)
    z = spark.createDataFrame([("r", 1, "drinking", 1), ("r", 1, "outside", 3), ("r", 2, "resting", 2)], "room string, t int, zone string, n long")
    s = spark.createDataFrame([("r", 1, 0.7), ("r", 2, 0.5)], "room string, t int, risk double")
    d = timeline.document(timeline.frames(z, s, "room", "t"), "room")
    first = d.first()["timeline"][0]
    assert (first["ordinal"], first["zones"][0]["share"], first["phase"], first["level"]) == (0, 0.25, "during", "high")
    assert timeline.faults(d, "room").first()["faults"] == []


def test_raster(spark):
    zones = spark.createDataFrame([("a", [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]), ("b", [[2.0, 0.0], [6.0, 0.0], [6.0, 2.0], [2.0, 2.0]])], "zone_id string, polygon array<array<double>>")
    m = raster.masks(raster.grid(spark, 8, 4), zones)
    assert {r["zone_id"]: (r["pixels"], r["overlap"]) for r in raster.mask_report(m).collect()} == {"a": (8, 4), "b": (8, 4)}
    assert zones.select(raster.scale(F.col("polygon"), 0.5, 0.25).alias("p")).first()["p"][2] == [2.0, 0.0]


def test_signed_rank_and_assignment(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 4, 5, -6, 0)], "k string, d double")
    r = models.signed_rank(df, ["k"], "d").first()
    assert (r["n"], r["w_plus"]) == (6, 15.0) and abs(r["p"] - 0.4375) < 1e-12
    assert models.assign(np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]])) == [1, 0, 2]


def test_bootstrap_is_near_the_standard_error(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(rng.normal(5, 2, 400))], "k string, i int, v double")
    r = models.bootstrap_mean(df, ["k"], "v", replicates=400).first()
    again = models.bootstrap_mean(df.repartition(3), ["k"], "v", replicates=400).first()
    assert abs((r["high"] - r["low"]) / (2 * 1.96 * 0.1) - 1) < 0.2 and abs(r["low"] - again["low"]) < 1e-9


def test_hidden_states_recover_planted_ones():
    rng = np.random.default_rng(1)
    z = np.repeat(np.arange(20) % 2, 25)
    x = (z * 4.0 + rng.normal(0, 0.5, len(z)))[:, None]
    p, gamma, history = models.fit_states(x, np.ones_like(x), np.array([0, 250]), 2, 3)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:], strict=False))
    hit = np.mean(gamma.argmax(1) == z)
    assert max(hit, 1 - hit) > 0.98 and np.allclose(p["trans"].sum(1), 1)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path))


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:05", 1.0), (1, "2024-01-01 00:00:15", 3.0), (1, "2024-01-01 00:01:00", 5.0)]
    s = stream(spark, tmp_path / "a", rows, "session_id long, ts string, value double")
    got = {str(r["window_start"])[11:]: (r["n"], r["mean"]) for r in run(live.sliding_means(s), "w", "complete").collect()}
    assert got["00:00:00"] == (2, 2.0) and got["00:00:50"] == (1, 5.0)
    assert sorted(r["n"] for r in run(live.gap_sessions(s), "g", "complete").collect()) == [1, 2]
    shares = stream(spark, tmp_path / "b", [(1, "2024-01-01 00:00:00", 1.0, 0.0, 0.0, 0.0), (1, "2024-01-01 00:00:30", 0.0, 1.0, 0.0, 0.0)], "room_id long, ts string, drinking double, feeding double, resting double, open_movement double")
    assert [r["transition"] for r in run(live.distribution_steps(shares), "d").orderBy("ts").collect()] == [0.0, 1.0]
    live.append_batches(s, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_track_files_and_hashes(spark, tmp_path):
    for p in ("S1/V1/tracks.csv", "S1/v1/other.csv", "S2/V2/t.csv"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(p)
    got = {r["video_key"]: r["path"].rsplit("/", 2)[-2:] for r in tables.track_files(spark, str(tmp_path)).collect()}
    assert got == {"s1|v1.mp4": ["V1", "tracks.csv"], "s2|v2.mp4": ["V2", "t.csv"]}
    import hashlib

    sums = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in tables.hashed_files(spark, str(tmp_path), "t.csv").collect()}
    assert sums == {"t.csv": hashlib.sha256(b"S2/V2/t.csv").hexdigest()}


def test_filtered_csv_and_fallbacks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("room_id,start_time\nroom_1,2025-07-03T10:00\nroom_1,2025-08-03T10:00\nroom_2,2025-07-03T10:00\n")
    assert [r["start_time"] for r in tables.read_room_days(spark, str(tmp_path / "w.csv"), "room_1", "2025-07-01", "2025-07-31").collect()] == ["2025-07-03T10:00"]
    f = tables.read_fallbacks(spark, "rooms:\n  room_1:\n    - zone_id: feeding_zone\n      polygon: [[0, 0], [4, 0], [4, 4]]\n").first()
    assert (f["room_id"], f["zone_id"], f["polygon"]) == ("room_1", "feeding_zone", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0]])
    assert tables.read_fallbacks(spark, "").count() == 0


def test_cache_copy_report_and_model(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    path = str(tmp_path / "c")
    assert [tables.cached(a, path, "1").count(), tables.cached(b, path, "1").count(), tables.cached(b, path, "2").count(), tables.cached(a, path, "2", force=True).count()] == [3, 3, 5, 3]
    got = {r["name"]: r["rows"] for r in tables.copy_named(spark, {"x": path, "y": str(tmp_path / "none")}, str(tmp_path / "out")).collect()}
    assert got == {"x": 3, "y": None}
    text = tables.report("Run", {"ids": b, "none": b.limit(0)}, most=2)
    assert "| id |" in text and "3 more rows are not shown." in text and "No rows." in text
    tables.save_model(str(tmp_path / "m"), a, {"profiles": b}, {"states": 2})
    assert spark.read.parquet(str(tmp_path / "m" / "profiles")).count() == 5 and json.loads(spark.read.text(str(tmp_path / "m" / "about")).first()[0]) == {"states": 2}


def test_polygons_and_priority(spark):
    z = "semantic_type string, zone_id string, polygons array<array<array<double>>>, polygon array<array<double>>"
    sq = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    df = spark.createDataFrame([("", "drinking_zone", None, sq(0.0, 2.4)), ("feeding", "x", [sq(1.0, 4.0), []], None), ("resting", "r", [], sq(0.0, 1.0)[:2]), ("other", "o", None, sq(0.0, 9.0))], z)
    t = raster.by_type(df)
    assert sorted((r["kind"], r["polygon"][2]) for r in t.collect()) == [("drinking", [2.0, 2.0]), ("feeding", [4.0, 4.0])]
    px = raster.grid(spark, 5, 5)
    code = lambda grow: {(r["x"], r["y"]): r["code"] for r in raster.assigned(px, t, grow=grow).collect()}
    c = code(0)
    assert len(c) == 25 and c[0, 0] == 1 and c[1, 1] == 1 and c[2, 2] == 2 and c[3, 3] == 2 and c[4, 4] == 0
    up, down = code(1), code(-1)
    assert up[2, 0] == 1 and up[4, 3] == 2 and up[4, 4] == 0 and down[0, 0] == 1 and down[1, 1] == 0 and down[2, 2] == 2 and down[3, 3] == 0


def test_schema_errors(spark):
    good = '{"version":"v","session_id":1,"date":"d","zones":[],"mean":null}'
    cases = {good: "", "[]": "not_an_object", "x": "not_an_object", good.replace('"d"', "3"): "kind:date", good.replace(":1,", ":-1,"): "range:session_id", good.replace('"date":"d",', ""): "missing:date", good.replace('"mean"', '"other"'): "unknown_field", good.replace("null", "2"): ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["e"] for r in df.select("t", F.array_join(contract.schema_errors(F.col("t")), ";").alias("e")).collect()} == cases


def test_sample_cap(spark):
    from roomlens.operators import quality

    df = spark.range(100)
    one, two = (sorted(r["id"] for r in quality.sample_cap(d, ["id"], 10).collect()) for d in (df, df.repartition(7).orderBy(F.col("id").desc())))
    assert one == two and len(one) == 10 and quality.sample_cap(df, ["id"], 1000).count() == 100
