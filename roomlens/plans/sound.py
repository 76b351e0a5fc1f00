"""Sound windows: short frames, masks, event families, hints, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audio, windows
from .adapters import table
from .registry import query

#: Order lines as frames of a tenth of a second: a supplier is a medium, its lines in order are its frames.
FRAMES_SQL = """frames AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS frame, l_quantity AS rms, l_discount AS flux,
 (l_partkey % 13) / 4001.0 AS flatness, (l_partkey % 50) / 1000.0 AS band_2_5khz, (l_partkey % 7) / 2000.0 AS band_3_6khz, (l_orderkey % 25) / 100.0 AS band_300_1500hz, l_tax AS energy_entropy, l_quantity * 100 AS dominant FROM lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("media_id"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("l_quantity").alias("rms"), F.col("l_discount").alias("flux"),
        (k % 13 / 4001.0).alias("flatness"), (k % 50 / 1000.0).alias("band_2_5khz"), (k % 7 / 2000.0).alias("band_3_6khz"), (F.col("l_orderkey") % 25 / 100.0).alias("band_300_1500hz"),
        F.col("l_tax").alias("energy_entropy"), (F.col("l_quantity") * 100).alias("dominant"))


MEDIA_SQL = """q AS (SELECT media_id, median(rms) AS r50, quantile_cont(rms, 0.65) AS r65, quantile_cont(band_2_5khz, 0.75) AS h, quantile_cont(band_3_6khz, 0.75) AS c, quantile_cont(band_300_1500hz, 0.8) AS l,
 quantile_cont(flux, 0.7) AS f FROM frames GROUP BY 1),
m AS (SELECT frames.*, band_2_5khz >= h AND dominant BETWEEN 1000 AND 5000 AND (flux >= f OR rms >= r50) AS call, band_2_5khz >= h AND band_3_6khz >= c AND dominant BETWEEN 1800 AND 7000 AND rms >= r50 AS chirp,
 band_300_1500hz >= l AND band_300_1500hz > band_3_6khz AND dominant BETWEEN 250 AND 2000 AND rms >= r65 AS cluck FROM frames JOIN q USING (media_id))"""


@query(f"""WITH {FRAMES_SQL}, {MEDIA_SQL} SELECT media_id, COUNT(*) AS frames, COUNT(*) FILTER (call) AS calls, COUNT(*) FILTER (chirp) AS chirps, COUNT(*) FILTER (cluck) AS clucks FROM m GROUP BY 1""")
def frame_call_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = audio.media_masks(frames(spark, sf_dir), "media_id")
    n = lambda c: F.count(F.when(F.col(c), 1))
    return m.groupBy("media_id").agg(F.count("*").alias("frames"), n("call").alias("calls"), n("chirp").alias("chirps"), n("cluck").alias("clucks"))


#: Windows of 300 frames every 100; a frame stands in a window by its centre.
WINDOW_SQL = """f AS (SELECT *, unnest(range(greatest(0, CAST(floor((frame - 300) / 100.0) AS BIGINT) + 1), CAST(floor(frame / 100.0) AS BIGINT) + 1)) * 10 AS win FROM m)"""
KEYS, ORDER = ["media_id", "win"], ["frame"]


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = audio.media_masks(frames(spark, sf_dir), "media_id")
    f = windows.contain(m, "media_id", F.col("frame"), 300, 100).filter("window_start >= 0")
    return f.withColumn("win", (F.col("window_start") / 10).cast("long")).drop("window_start")


@query(f"""WITH {FRAMES_SQL}, {MEDIA_SQL}, {WINDOW_SQL} SELECT media_id, win, COUNT(*) AS frames, ROUND(AVG(rms), 6) AS rms, ROUND(AVG(energy_entropy), 6) AS energy_entropy, ROUND(AVG(band_2_5khz), 6) AS band_2_5khz,
 ROUND(AVG(band_3_6khz), 6) AS band_3_6khz, ROUND(AVG(band_300_1500hz), 6) AS band_300_1500hz, ROUND(AVG(flux), 6) AS flux, ROUND(AVG(flatness), 6) AS flatness, median(dominant) AS dominant FROM f GROUP BY ALL""")
def sound_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the frames of a window, and the median of the dominant frequency."""
    names = ("rms", "energy_entropy", "band_2_5khz", "band_3_6khz", "band_300_1500hz", "flux", "flatness")
    return windowed(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("frames"), *[F.round(F.avg(c), 6).alias(c) for c in names], F.percentile("dominant", 0.5).alias("dominant"))


EVENT_SQL = """w AS (SELECT media_id, win, quantile_cont(flux, 0.6) AS f60, quantile_cont(flux, 0.9) AS f90, quantile_cont(rms, 0.6) AS r60, quantile_cont(band_2_5khz, 0.7) AS b70, quantile_cont(band_300_1500hz, 0.7) AS l70 FROM f GROUP BY ALL),
o AS (SELECT f.*, f90, rms >= r60 OR flux >= f60 OR band_2_5khz >= b70 OR band_300_1500hz >= l70 AS raw FROM f JOIN w USING (media_id, win)),
a AS (SELECT *, raw OR (coalesce(lag(raw) OVER v, false) AND coalesce(lead(raw) OVER v, false)) AS active,
 ((band_2_5khz >= 0.022 OR band_3_6khz >= 0.0025) AND flatness <= 0.002) OR (band_300_1500hz >= 0.11 AND band_3_6khz >= 0.002 AND flatness <= 0.008 AND flux < f90) AS d,
 band_300_1500hz >= 0.11 AND band_300_1500hz > band_2_5khz AND flatness <= 0.0012 AND flux < f90 AS s FROM o WINDOW v AS (PARTITION BY media_id, win ORDER BY frame)),
e AS (SELECT media_id, win, frame, active, call, chirp, cluck, d AND active AS dense, s AND active AS sparse, flux >= greatest(f90, 0.082) AND flatness >= 0.001 AND NOT d AND NOT s AND active AS disturbance,
 band_300_1500hz >= 0.11 AND band_2_5khz < 0.02 AND ((flatness >= 0.0009 AND flatness <= 0.008) OR flux >= f90) AND NOT d AND NOT s AND active AS lowfreq FROM a),
l AS (SELECT media_id, win, frame, x.mask, x.on_ FROM e, LATERAL (VALUES ('active', active), ('dense', dense), ('sparse', sparse), ('disturbance', disturbance), ('lowfreq', lowfreq), ('bird', dense OR sparse),
 ('nonbird', disturbance OR lowfreq), ('call', call), ('chirp', chirp), ('cluck', cluck)) x(mask, on_)),
b AS (SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY media_id, win, mask ORDER BY frame), false) THEN 1 ELSE 0 END AS s FROM l),
i AS (SELECT *, SUM(s) OVER (PARTITION BY media_id, win, mask ORDER BY frame) AS run FROM b), r AS (SELECT media_id, win, mask, run, COUNT(*) FILTER (on_) AS n FROM i GROUP BY ALL),
t AS (SELECT media_id, win, mask, COUNT(*) FILTER (n > 0) AS runs, SUM(n) AS on_frames, COUNT(*) FILTER (n BETWEEN 1 AND 5) AS short_runs, SUM(CASE WHEN n BETWEEN 1 AND 5 THEN n ELSE 0 END) AS short_frames FROM r GROUP BY ALL),
p AS (SELECT media_id, win, MAX(on_frames) FILTER (mask = 'bird') / 300.0 AS bird, MAX(on_frames) FILTER (mask = 'dense') / 300.0 AS dense, MAX(on_frames) FILTER (mask = 'sparse') / 300.0 AS sparse,
 MAX(on_frames) FILTER (mask = 'nonbird') / 300.0 AS nonbird, MAX(on_frames) FILTER (mask = 'disturbance') / 300.0 AS disturbance, MAX(on_frames) FILTER (mask = 'lowfreq') / 300.0 AS lowfreq, MAX(on_frames) FILTER (mask = 'active') / 300.0 AS active,
 MAX(on_frames) FILTER (mask = 'call') / 300.0 AS call, MAX(runs) FILTER (mask = 'bird') * 2 AS bird_rate, MAX(runs) FILTER (mask = 'chirp') * 2 AS chirp_rate, MAX(short_runs) FILTER (mask = 'disturbance') * 2 AS impact_rate,
 MAX(short_frames) FILTER (mask = 'disturbance') / 300.0 AS impact, MAX(CASE WHEN runs > 0 THEN on_frames * 0.1 / runs ELSE 0 END) FILTER (mask = 'cluck') AS cluck_duration FROM t GROUP BY ALL)"""

HINT_SQL = """CASE WHEN active < 0.05 THEN 'background_quiet' WHEN bird >= 0.2 AND bird > nonbird * 1.5 THEN CASE WHEN sparse > dense * 0.8 THEN 'bird_dominant_with_sparse_component' ELSE 'bird_dominant_dense' END
 WHEN sparse >= 0.08 AND sparse > dense AND sparse > nonbird THEN 'bird_dominant_sparse' WHEN nonbird >= 0.1 AND nonbird > bird * 1.25 THEN CASE WHEN lowfreq >= disturbance THEN 'background_with_lowfreq_uncertain_events'
 ELSE 'background_with_transient_disturbance' END WHEN bird >= 0.05 AND nonbird >= 0.05 THEN 'mixed_bird_and_disturbance' WHEN bird >= 0.05 THEN 'background_with_bird_events' WHEN nonbird >= 0.05 THEN 'background_with_nonbird_events'
 ELSE 'background_low_level_activity' END"""

SUMMARY_SQL = """SELECT media_id, win, ROUND(bird, 6) AS bird_occupancy, ROUND(dense, 6) AS dense_occupancy, ROUND(sparse, 6) AS sparse_occupancy, ROUND(nonbird, 6) AS nonbird_occupancy, ROUND(disturbance, 6) AS disturbance_occupancy,
 ROUND(lowfreq, 6) AS lowfreq_occupancy, ROUND(active, 6) AS active_occupancy, ROUND(call, 6) AS call_occupancy, ROUND(bird_rate, 6) AS bird_rate, ROUND(chirp_rate, 6) AS chirp_rate, ROUND(impact_rate, 6) AS impact_rate, ROUND(impact, 6) AS impact_occupancy,
 ROUND(cluck_duration, 6) AS cluck_mean_duration, ROUND(bird - nonbird, 6) AS bird_minus_nonbird, ROUND(CASE WHEN active > 0 THEN bird / active ELSE 0 END, 6) AS bird_within_active, """ + HINT_SQL + " AS hint FROM p"


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = audio.window_event_masks(windowed(spark, sf_dir), KEYS, ORDER)
    masks = ["active", "dense", "sparse", "disturbance", "lowfreq", "bird", "nonbird", "call", "chirp", "cluck"]
    s = audio.mask_summary(e, KEYS, ORDER, masks, 0.1, 30.0, {"impact": ("disturbance", 5)})
    o = {m: F.col(f"{m}_occupancy") for m in masks}
    hint = audio.event_hint(*[o[m] for m in ("bird", "dense", "sparse", "nonbird", "disturbance", "lowfreq", "active")])
    r = lambda c: F.round(c, 6)
    names = [f"{m}_occupancy" for m in ("bird", "dense", "sparse", "nonbird", "disturbance", "lowfreq", "active", "call")] + ["bird_rate", "chirp_rate", "impact_rate", "impact_occupancy", "cluck_mean_duration"]
    return s.select(*KEYS, *[r(F.col(n)).alias(n) for n in names], r(o["bird"] - o["nonbird"]).alias("bird_minus_nonbird"),
                    r(F.when(o["active"] > 0, o["bird"] / o["active"]).otherwise(0.0)).alias("bird_within_active"), hint.alias("hint"))


@query(f"WITH {FRAMES_SQL}, {MEDIA_SQL}, {WINDOW_SQL}, {EVENT_SQL} {SUMMARY_SQL}")
def sound_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancies, rates and durations of the event families of each window, and what dominates it."""
    return event_features(spark, sf_dir)


@query(f"""WITH {FRAMES_SQL}, {MEDIA_SQL}, {WINDOW_SQL}, {EVENT_SQL}, z AS ({SUMMARY_SQL}), n AS (SELECT s_suppkey AS media_id, unnest(range(CAST((SELECT MAX(frame) FROM frames) // 100 AS BIGINT) + 1)) * 10 AS win FROM supplier)
SELECT n.media_id, n.win, z.win IS NOT NULL AS audio_available, CASE WHEN z.win IS NULL THEN 'insufficient_audio_frames' ELSE 'ok' END AS audio_quality_flag, bird_occupancy, coalesce(hint, 'unavailable') AS hint FROM n LEFT JOIN z ON z.media_id = n.media_id AND z.win = n.win""")
def sound_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of every medium, which are planned as long as the longest one; those without frames get the defaults."""
    last = frames(spark, sf_dir).agg(F.floor(F.max("frame") / 100).cast("long").alias("last"))
    wins = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("media_id")).crossJoin(F.broadcast(last))  # one row
    wins = wins.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), 10 * F.col("last"), F.lit(10).cast("long"))).alias("win"))
    x = audio.with_unavailable(wins, event_features(spark, sf_dir), KEYS)
    return x.select(*KEYS, "audio_available", "audio_quality_flag", "bird_occupancy", "hint")


@query()
def short_frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors read as frames of samples at 22,050 hertz."""
    f = table(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    s = audio.short_frames(f, 22050.0)
    return s.select("media_id", "frame", *[F.round(c, 6).alias(c) for c in s.columns[2:]])
