"""Tracks in videos: observations, behaviour mixes, summaries, snapshots, windows, state labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import clamp, entropy, imbalance
from ..operators import tracks, zones
from .adapters import OBS_SQL, obs, table
from .registry import query

#: Observations as detections: a session's day is a video, its hours are seconds.
SEEN_SQL = f"""{OBS_SQL}, seen AS (SELECT session_id, CAST(start_dt AS DATE) AS date, CAST(hour(start_dt) AS BIGINT) AS second, user_id AS track_id, window_id, coalesce(quality, 0) AS confidence, zone || '_zone' AS source_zone,
 CASE zone WHEN 'drinking' THEN 'drinking' WHEN 'feeding' THEN 'feeding' WHEN 'resting' THEN 'idle' WHEN 'open_movement' THEN 'active' ELSE 'dust_bathing' END AS behavior,
 coalesce(metric, 0) / 77 AS x_norm, (user_id % 101) / 90.0 AS y_norm FROM obs)"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.lit("dust_bathing")
    for z, n in (("drinking", "drinking"), ("feeding", "feeding"), ("resting", "idle"), ("open_movement", "active")):
        b = F.when(F.col("zone") == z, n).otherwise(b)
    return obs(spark, sf_dir).select(
        "session_id", F.col("start_dt").cast("date").alias("date"), F.hour("start_dt").cast("long").alias("second"), F.col("user_id").alias("track_id"), "window_id", F.coalesce("quality", F.lit(0.0)).alias("confidence"),
        F.concat("zone", F.lit("_zone")).alias("source_zone"), b.alias("behavior"), (F.coalesce("metric", F.lit(0.0)) / 77).alias("x_norm"), (F.col("user_id") % 101 / 90.0).alias("y_norm"))


@query(f"""WITH {SEEN_SQL} SELECT window_id, CASE source_zone WHEN 'drinking_zone' THEN 'drinker' WHEN 'feeding_zone' THEN 'feeder' WHEN 'resting_zone' THEN 'resting' ELSE 'open_movement' END AS display_zone,
 ROUND(least(greatest(x_norm, 0), 1) * 10.8 - 5.4, 4) AS world_x, ROUND((1 - least(greatest(y_norm, 0), 1)) * 16.4 - 8.2, 4) AS world_z,
 CASE WHEN confidence > 0.5 OR x_norm > 0.5 THEN concat_ws(',', CASE WHEN confidence > 0.5 THEN 'active=' || CAST(ROUND(confidence - 0.5, 2) AS VARCHAR) END, CASE WHEN x_norm > 0.5 THEN 'feeding=1.0' END) ELSE behavior || '=1.0' END AS evidence FROM seen""")
def track_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display zone, room coordinates and evidence of every detection."""
    x, z = tracks.world(F.col("x_norm"), F.col("y_norm"))
    shares = {"active": F.round(F.greatest(F.col("confidence") - 0.5, F.lit(0.0)), 2), "feeding": F.when(F.col("x_norm") > 0.5, 1.0)}
    e = tracks.evidence(shares, F.col("behavior"))
    text = F.array_join(F.transform(F.map_entries(e), lambda kv: F.concat(kv["key"], F.lit("="), kv["value"].cast("string"))), ",")
    return seen(spark, sf_dir).select("window_id", tracks.display_zone(F.col("source_zone")).alias("display_zone"), x.alias("world_x"), z.alias("world_z"), text.alias("evidence"))


@query(f"""WITH {SEEN_SQL}, c AS (SELECT session_id, date, behavior, COUNT(*) AS n FROM seen GROUP BY ALL), t AS (SELECT session_id, date, SUM(n) AS total FROM c GROUP BY ALL),
b AS (SELECT * FROM (VALUES (0, 'active'), (1, 'feeding'), (2, 'drinking'), (3, 'idle'), (4, 'preening'), (5, 'perching'), (6, 'wing_flapping')) v(place, behavior)),
l AS (SELECT session_id, date, place, behavior FROM t, b UNION ALL SELECT session_id, date, 6 + row_number() OVER (PARTITION BY session_id, date ORDER BY behavior), behavior FROM c WHERE behavior NOT IN (SELECT behavior FROM b))
SELECT l.session_id, l.date, CAST(place AS INT) AS place, l.behavior, array_to_string(list_transform(string_split(l.behavior, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS label, coalesce(n, 0) AS count, ROUND(coalesce(n, 0) / total, 6) AS value
 FROM l JOIN t USING (session_id, date) LEFT JOIN c ON c.session_id = l.session_id AND c.date = l.date AND c.behavior = l.behavior""")
def behavior_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share and count of every behaviour of a video in fixed order."""
    return tracks.mix(seen(spark, sf_dir), ["session_id", "date"], "behavior")


@query(f"""WITH {SEEN_SQL}, c AS (SELECT session_id, date, behavior, COUNT(*) AS n FROM seen GROUP BY ALL) SELECT session_id, date, string_agg(behavior || ':' || n, ',' ORDER BY n DESC, behavior) AS mix FROM c GROUP BY ALL""")
def behavior_mix_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behaviours of a video from frequent to rare."""
    m = tracks.mix(seen(spark, sf_dir), ["session_id", "date"], "behavior").filter("count > 0")
    items = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "behavior")))
    return m.groupBy("session_id", "date").agg(F.array_join(F.transform(items, lambda x: F.concat(x["behavior"], F.lit(":"), (-x["k"]).cast("string"))), ",").alias("mix"))


@query(f"""WITH {SEEN_SQL}, s AS (SELECT session_id, date, second, COUNT(DISTINCT track_id) AS t FROM seen GROUP BY ALL), m AS (SELECT session_id, date, SUM(t) AS t FROM s GROUP BY ALL),
d AS (SELECT session_id, date, behavior FROM (SELECT session_id, date, behavior, COUNT(*) AS n, MIN(window_id) AS f FROM seen GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY session_id, date ORDER BY n DESC, f) = 1),
x AS (SELECT session_id, date, COUNT(*) AS records, COUNT(DISTINCT track_id) AS tracks, ROUND(AVG(confidence), 6) AS mean_confidence FROM seen GROUP BY ALL)
SELECT session_id, date, records, tracks, ROUND(t / 24, 3) AS mean_detected, mean_confidence, behavior AS dominant FROM x JOIN m USING (session_id, date) JOIN d USING (session_id, date)""")
def behavior_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.summary(seen(spark, sf_dir), ["session_id", "date"], "second", "track_id", "behavior", "confidence", 24, "window_id")


@query(f"""WITH {SEEN_SQL} SELECT session_id, track_id, COUNT(*) AS count, ROUND(SUM(confidence), 6) AS confidence_sum, ROUND(SUM(x_norm), 6) AS x_norm_sum, MAX(date) AS latest_date,
 arg_max(behavior, struct_pack(d := date, s := second, w := window_id)) AS latest_behavior, arg_max(source_zone, struct_pack(d := date, s := second, w := window_id)) AS latest_source_zone,
 ROUND(arg_max(x_norm, struct_pack(d := date, s := second, w := window_id)), 6) AS latest_x_norm, COUNT(*) FILTER (behavior = 'feeding') AS feeding, COUNT(*) FILTER (behavior = 'drinking') AS drinking FROM seen GROUP BY ALL""")
def track_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and last known values of every track."""
    s = seen(spark, sf_dir).withColumn("feeding", (F.col("behavior") == "feeding").cast("long")).withColumn("drinking", (F.col("behavior") == "drinking").cast("long"))
    x = tracks.snapshots(s, ["session_id", "track_id"], ["date", "second", "window_id"], ["confidence", "x_norm", "feeding", "drinking"], ["behavior", "source_zone", "x_norm"])
    r = lambda c: F.round(c, 6).alias(c)
    return x.select("session_id", "track_id", "count", r("confidence_sum"), r("x_norm_sum"), "latest_date", "latest_behavior", "latest_source_zone", r("latest_x_norm"), F.col("feeding_sum").alias("feeding"), F.col("drinking_sum").alias("drinking"))


#: Windows of five and a half seconds every four in each video.
PLAN_SQL = """w AS (SELECT session_id, date, k, k * 4 + 0.5 AS "offset" FROM (SELECT DISTINCT session_id, date FROM seen), (SELECT unnest(range(6)) AS k)),
j AS (SELECT w.session_id, w.date, k, second, track_id, CAST(ceil("offset" + 5.5) - floor("offset") AS BIGINT) AS observed FROM w JOIN seen s ON s.session_id = w.session_id AND s.date = w.date AND second >= floor("offset") AND second < ceil("offset" + 5.5)),
p AS (SELECT session_id, date, k, second, ANY_VALUE(observed) AS observed, COUNT(DISTINCT track_id) AS t, COUNT(*) AS n FROM j GROUP BY ALL)"""


@query(f"""WITH {SEEN_SQL}, {PLAN_SQL} SELECT session_id, date, k, CAST(SUM(n) AS BIGINT) AS records, ROUND(SUM(t) / ANY_VALUE(observed), 6) AS mean_visible, MAX(t) AS max_visible FROM p GROUP BY ALL""")
def track_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in the windows of their video: visible tracks a second, over all seconds of the window."""
    s = seen(spark, sf_dir)
    w = s.select("session_id", "date").distinct().select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(6)])).alias("k"))
    w = w.withColumn("offset", F.col("k") * 4 + 0.5).withColumn("length", F.lit(5.5))
    j = tracks.in_windows(s, w, ["session_id", "date"], "second", width=8)
    p = j.groupBy("session_id", "date", "k", "second").agg(F.countDistinct("track_id").alias("t"), F.count("*").alias("n"), F.max("observed_seconds").alias("o"))
    return p.groupBy("session_id", "date", "k").agg(F.sum("n").alias("records"), F.round(F.sum("t") / F.max("o"), 6).alias("mean_visible"), F.max("t").alias("max_visible"))


ROOM_SQL = f"""{OBS_SQL}, r AS (SELECT session_id, CAST(start_dt AS DATE) AS date, hour(start_dt) AS h, COUNT(*) FILTER (zone = 'drinking') AS d, COUNT(*) FILTER (zone = 'feeding') AS f, COUNT(*) FILTER (zone = 'resting') AS r,
 COUNT(*) FILTER (zone = 'open_movement') AS o, least(coalesce(AVG(metric), 0) / 80, 1) AS a FROM obs GROUP BY ALL),
s AS (SELECT *, greatest(d + f + r + o, 1) * 1.0 AS t FROM r), p AS (SELECT session_id, date, h, a, CASE WHEN d + f + r + o > 0 THEN d / t ELSE 0.25 END AS d, CASE WHEN d + f + r + o > 0 THEN f / t ELSE 0.25 END AS f,
 CASE WHEN d + f + r + o > 0 THEN r / t ELSE 0.25 END AS r, CASE WHEN d + f + r + o > 0 THEN o / t ELSE 0.25 END AS o FROM s),
e AS (SELECT *, -(CASE WHEN d > 0 THEN d * ln(d) ELSE 0 END + CASE WHEN f > 0 THEN f * ln(f) ELSE 0 END + CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END + CASE WHEN o > 0 THEN o * ln(o) ELSE 0 END) / ln(4) AS free,
 0.5 * (abs(d - 0.25) + abs(f - 0.25) + abs(r - 0.25) + abs(o - 0.25)) AS imb FROM p),
k AS (SELECT *, least(greatest(0.38 * (1 - a) + 0.32 * greatest(imb, 1 - free) + 0.20 * (1 - free) + 0.10 * least(greatest((0.55 - d - f) / 0.55, 0), 1), 0), 1) AS risk FROM e)"""


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda z: F.count(F.when(F.col("zone") == z, 1))
    r = obs(spark, sf_dir).groupBy("session_id", F.col("start_dt").cast("date").alias("date"), F.hour("start_dt").cast("long").alias("h")).agg(
        n("drinking").alias("nd"), n("feeding").alias("nf"), n("resting").alias("nr"), n("open_movement").alias("no"), F.least(F.coalesce(F.avg("metric"), F.lit(0.0)) / 80, F.lit(1.0)).alias("a"))
    total = F.col("nd") + F.col("nf") + F.col("nr") + F.col("no")
    r = r.select("session_id", "date", "h", "a", *[F.when(total > 0, F.col(f"n{c}") / F.greatest(total, F.lit(1))).otherwise(0.25).alias(c) for c in "dfro"])
    f = [F.col(c) for c in "dfro"]
    r = r.withColumn("free", entropy(f)).withColumn("imb", imbalance(f))
    return r.withColumn("risk", zones.risk(1 - F.col("a"), F.col("imb"), 1 - F.col("free"), F.col("d") + F.col("f")))


@query(f"""WITH {ROOM_SQL} SELECT session_id, date, h, ROUND(risk, 9) AS risk, CASE WHEN a <= 0.16 THEN 'localized_low_activity' WHEN imb >= 0.6 OR 1 - free >= 0.6 THEN 'crowding_proxy' WHEN f >= greatest(d, o, r) AND f >= 0.2 THEN 'feeder_focused_activity'
 WHEN d >= greatest(f, o, r) AND d >= 0.14 THEN 'drinker_focused_activity' WHEN r >= greatest(o, f, d) AND r >= 0.38 THEN 'resting_zone_dominant' WHEN o >= greatest(r, f, d) AND o >= 0.3 THEN 'open_movement_dominant' ELSE 'balanced_room_activity' END AS state_label FROM k""")
def state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a room does in each hour."""
    label = tracks.state_label(F.col("a"), F.col("free"), F.col("imb"), F.col("d"), F.col("f"), F.col("o"), F.col("r"))
    return rooms(spark, sf_dir).select("session_id", "date", "h", F.round("risk", 9).alias("risk"), label.alias("state_label"))


@query(f"""WITH {ROOM_SQL}, z AS (SELECT session_id, date, h, risk, x.zone, x.v FROM k, LATERAL (VALUES ('drinker', d), ('feeder', f), ('resting', r), ('open_movement', o)) x(zone, v))
SELECT zone, COUNT(*) AS hours, COUNT(*) FILTER (CASE WHEN zone = 'resting' THEN risk >= 0.55 AND v > 0.68 ELSE risk >= 0.6 AND v < 0.28 END) AS abnormal FROM z GROUP BY zone""")
def zone_abnormality(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.explode(F.array(*[F.struct(F.lit(n).alias("zone"), F.col(c).alias("v")) for n, c in (("drinker", "d"), ("feeder", "f"), ("resting", "r"), ("open_movement", "o"))])).alias("z")
    x = rooms(spark, sf_dir).select("risk", z).select("risk", "z.zone", "z.v")
    return x.groupBy("zone").agg(F.count("*").alias("hours"), F.count(F.when(tracks.zone_abnormal(F.col("zone"), F.col("v"), F.col("risk")), 1)).alias("abnormal"))


@query("""SELECT l_orderkey, l_linenumber, ROUND(least(greatest((x1 + x2) * 0.5 * 0.4, 0), 31), 6) AS center_x, ROUND(least(greatest((y1 + y2) * 0.5 * 0.3, 0), 23), 6) AS center_y, ROUND(least(greatest(y2 * 0.3, 0), 23), 6) AS bottom_y
 FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_quantity + 30 AS x2, l_discount * 600 AS y1, l_discount * 600 + 40 AS y2 FROM lineitem)""")
def box_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and bottom centres of boxes of an 80 x 80 source, scaled to a 32 x 24 image and kept inside it."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), (F.col("l_quantity") + 30).alias("x2"), (F.col("l_discount") * 600).alias("y1"), (F.col("l_discount") * 600 + 40).alias("y2"))
    r = lambda c, most, n: F.round(clamp(c, 0.0, most), 6).alias(n)
    return i.select("l_orderkey", "l_linenumber", r((F.col("x1") + F.col("x2")) * 0.5 * 0.4, 31.0, "center_x"), r((F.col("y1") + F.col("y2")) * 0.5 * 0.3, 23.0, "center_y"), r(F.col("y2") * 0.3, 23.0, "bottom_y"))
