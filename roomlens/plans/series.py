"""Series, windows, runs and merges over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import num
from ..operators import balance, windows, zones
from ..operators.order import blocks
from ..operators.shared import join_keys
from .adapters import OBS_SQL, obs, table
from .registry import query

HOURLY_B = """f AS (SELECT session_id, CAST(start_dt AS DATE) AS date, hour(start_dt) AS h, metric, quality FROM obs
 WHERE hour(start_dt) BETWEEN 7 AND 16 AND NOT caretaker AND metric IS NOT NULL AND quality > 0),
hourly AS (SELECT session_id, date, h, SUM(metric * quality) / SUM(quality) AS m FROM f GROUP BY ALL HAVING SUM(quality) >= 2.0),
daily AS (SELECT session_id, date, AVG(m) AS daily_mean, COUNT(*) AS hour_bins FROM hourly GROUP BY session_id, date)"""


@query(f"WITH {OBS_SQL}, {HOURLY_B} SELECT session_id, date, ROUND(daily_mean, 6) AS daily_mean, hour_bins FROM daily")
def hour_balanced_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.by_session(obs(spark, sf_dir)).withColumn("daily_mean", F.round("daily_mean", 6))


@query(f"""WITH {OBS_SQL}, hourly AS (SELECT session_id, CAST(start_dt AS DATE) AS date, hour(start_dt) AS h,
 SUM(CASE WHEN metric IS NOT NULL AND quality > 0 THEN metric * quality END) / SUM(CASE WHEN metric IS NOT NULL AND quality > 0 THEN quality END) AS m
 FROM obs WHERE hour(start_dt) BETWEEN 7 AND 16 GROUP BY ALL HAVING SUM(least(greatest(coalesce(quality, 0), 0), 1)) >= 2.0)
SELECT session_id, date, ROUND(AVG(m), 6) AS daily_mean, COUNT(*) AS hour_bins FROM hourly GROUP BY session_id, date""")
def hour_balanced_daily_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.by_session_all_rows(obs(spark, sf_dir)).withColumn("daily_mean", F.round("daily_mean", 6))


@query(f"""WITH {OBS_SQL}, hourly AS (SELECT CAST(start_dt AS DATE) AS date, hour(start_dt) AS h, SUM(metric * quality) / SUM(quality) AS m, COUNT(*) AS n
 FROM obs WHERE hour(start_dt) BETWEEN 7 AND 16 AND metric IS NOT NULL AND quality > 0 GROUP BY ALL HAVING SUM(quality) >= 2.0)
SELECT date, ROUND(AVG(m), 6) AS daily_mean, COUNT(*) AS hour_bins, CAST(SUM(n) AS BIGINT) AS windows FROM hourly GROUP BY date HAVING COUNT(*) >= 2""")
def hour_balanced_daily_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.by_date(obs(spark, sf_dir)).withColumn("daily_mean", F.round("daily_mean", 6))


@query(f"""WITH {OBS_SQL}, {HOURLY_B} SELECT session_id, CAST(date_trunc('week', date) AS DATE) AS week, ROUND(AVG(daily_mean), 6) AS weekly_mean,
 COUNT(*) AS days FROM daily GROUP BY ALL""")
def weekly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.weekly(balance.by_session(obs(spark, sf_dir)), ["session_id"]).withColumn("weekly_mean", F.round("weekly_mean", 6))


@query(f"""WITH {OBS_SQL}, {HOURLY_B} SELECT session_id, CAST(date_trunc('week', date - 1) AS DATE) + 1 AS week, ROUND(AVG(daily_mean), 6) AS weekly_mean,
 COUNT(*) AS days FROM daily GROUP BY ALL""")
def week_ending_monday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.weekly(balance.by_session(obs(spark, sf_dir)), ["session_id"], ending_monday=True).withColumn("weekly_mean", F.round("weekly_mean", 6))


@query("""WITH m AS (SELECT o_orderkey AS media_id, o_totalprice / 5000 AS d FROM orders),
w AS (SELECT media_id, d, unnest(range(0, CASE WHEN d IS NULL OR d <= 0 OR d < 30 THEN 1 ELSE CAST(floor((d - 30 + 1e-9) / 10) AS BIGINT) + 1 END)) AS k FROM m)
SELECT media_id, printf('w%04d', k + 1) AS window_no, k * 10.0 AS start_offset, ROUND(CASE WHEN d > 0 AND d < 30 THEN d ELSE 30.0 END, 6) AS length,
 CASE WHEN d IS NULL OR d <= 0 THEN 'missing_or_zero_duration' WHEN d < 30 THEN 'short_media_partial_window' ELSE '' END AS warnings FROM w""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), (F.col("o_totalprice") / 5000).alias("duration"))
    return windows.sliding(media).withColumn("length", F.round("length", 6))


@query(f"""WITH {OBS_SQL}, w AS (SELECT session_id, metric, unnest(range(CAST(floor((secs - 7200) / 3600) AS BIGINT) + 1, CAST(floor(secs / 3600) AS BIGINT) + 1)) * 3600 AS window_start FROM obs)
SELECT session_id, window_start, ROUND(AVG(metric), 6) AS metric_mean, ROUND(SUM(metric), 4) AS metric_sum, COUNT(*) AS frames FROM w GROUP BY ALL""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = windows.contain(obs(spark, sf_dir).select("session_id", "metric", "secs"), "session_id", F.col("secs"), 7200, 3600)
    return x.groupBy("session_id", "window_start").agg(F.round(F.avg("metric"), 6).alias("metric_mean"), F.round(F.sum("metric"), 4).alias("metric_sum"), F.count("*").alias("frames"))


ACTIVITY_SQL = """act AS (SELECT session_id, CAST(start_dt AS DATE) AS date, zone, SUM(metric) AS activity FROM obs WHERE zone <> 'outside' GROUP BY ALL)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).filter("zone <> 'outside'")
    return o.groupBy("session_id", F.col("start_dt").cast("date").alias("date"), "zone").agg(F.sum("metric").alias("activity"))


@query(f"""WITH {OBS_SQL}, {ACTIVITY_SQL} SELECT session_id, date, zone, ROUND(CASE WHEN SUM(activity) OVER w > 0 THEN activity / SUM(activity) OVER w
 ELSE 1.0 / COUNT(*) OVER w END, 6) AS share FROM act WINDOW w AS (PARTITION BY session_id, date)""")
def zone_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.shares(activity(spark, sf_dir), ["session_id", "date"], "activity").select("session_id", "date", "zone", F.round("share", 6).alias("share"))


BIO_SQL = ACTIVITY_SQL + """, p AS (SELECT session_id, date, coalesce(MAX(activity) FILTER (zone = 'drinking'), 0) AS a, coalesce(MAX(activity) FILTER (zone = 'feeding'), 0) AS b,
  coalesce(MAX(activity) FILTER (zone = 'resting'), 0) AS c, coalesce(MAX(activity) FILTER (zone = 'open_movement'), 0) AS d FROM act GROUP BY ALL),
g AS (SELECT *, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) + greatest(d, 0) AS t FROM p),
q AS (SELECT session_id, date, (a + b + c + d) / 4 AS activity_mean, CASE WHEN b > 0 THEN a / b END AS ratio,
  CASE WHEN t > 0 THEN greatest(a, 0) / t ELSE 0.25 END AS fa, CASE WHEN t > 0 THEN greatest(b, 0) / t ELSE 0.25 END AS fb,
  CASE WHEN t > 0 THEN greatest(c, 0) / t ELSE 0.25 END AS fc, CASE WHEN t > 0 THEN greatest(d, 0) / t ELSE 0.25 END AS fd FROM g),
r AS (SELECT *, coalesce(0.5 * (abs(fa - lag(fa) OVER w) + abs(fb - lag(fb) OVER w) + abs(fc - lag(fc) OVER w) + abs(fd - lag(fd) OVER w)), 0) AS transition,
  MIN(activity_mean) OVER (PARTITION BY session_id) AS lo, MAX(activity_mean) OVER (PARTITION BY session_id) AS hi FROM q WINDOW w AS (PARTITION BY session_id ORDER BY date)),
bio AS (SELECT *, -(CASE WHEN fa > 0 THEN fa * ln(fa) ELSE 0 END + CASE WHEN fb > 0 THEN fb * ln(fb) ELSE 0 END + CASE WHEN fc > 0 THEN fc * ln(fc) ELSE 0 END
  + CASE WHEN fd > 0 THEN fd * ln(fd) ELSE 0 END) / ln(4) AS ent, 0.5 * (abs(fa - 0.25) + abs(fb - 0.25) + abs(fc - 0.25) + abs(fd - 0.25)) AS imb,
  least(greatest(0.7 * CASE WHEN hi > lo THEN (activity_mean - lo) / (hi - lo) WHEN hi = 0 THEN 0 ELSE 0.5 END + 0.3 * transition, 0), 1) AS mobility FROM r)"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.biomarkers(activity(spark, sf_dir), ["session_id", "date"], "session_id", ["date"])


@query(f"""WITH {OBS_SQL}, {BIO_SQL} SELECT session_id, date, ROUND(activity_mean, 6) AS activity_mean, ROUND(fa, 6) AS drinking_fraction, ROUND(ent, 6) AS zone_entropy,
 ROUND(imb, 6) AS zone_imbalance, ROUND(ratio, 6) AS drinking_to_feeding, ROUND(transition, 6) AS transition, ROUND(mobility, 6) AS mobility FROM bio""")
def zone_biomarkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["activity_mean", "drinking_fraction", "zone_entropy", "zone_imbalance", "drinking_to_feeding", "transition", "mobility"]
    return markers(spark, sf_dir).select("session_id", "date", *[F.round(c, 6).alias(c) for c in cols])


@query(f"""WITH {OBS_SQL}, {BIO_SQL}, s AS (SELECT session_id, date, least(greatest(0.38 * (1 - mobility) + 0.32 * greatest(imb, 1 - ent) + 0.20 * (1 - ent)
  + 0.10 * least(greatest((0.55 - fa) / 0.55, 0), 1), 0), 1) AS risk FROM bio)
SELECT session_id, date, ROUND(risk, 6) AS risk, CASE WHEN risk >= 0.66 THEN 'during' WHEN risk >= 0.48 THEN 'recovery' ELSE 'background' END AS phase,
 CASE WHEN risk >= 0.66 THEN 'high' WHEN risk >= 0.33 THEN 'medium' ELSE 'low' END AS risk_level FROM s""")
def risk_state_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = 1 - F.col("zone_entropy")
    r = zones.risk(1 - F.col("mobility"), F.col("zone_imbalance"), cluster, F.col("drinking_fraction"))
    x = markers(spark, sf_dir).select("session_id", "date", r.alias("risk"))
    return x.select("session_id", "date", F.round("risk", 6).alias("risk"), zones.phase(F.col("risk")).alias("phase"), zones.risk_level(F.col("risk")).alias("risk_level"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_dt, window_id) <= 5),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY start_dt, window_id) <= 200) SELECT session_id, user_id, window_id FROM b""")
def window_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("start_dt").asc_nulls_last(), F.col("window_id").asc_nulls_last()]
    return windows.first_rows(obs(spark, sf_dir), [(["user_id"], 5), (["session_id"], 200)], order).select("session_id", "user_id", "window_id")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) = 1""")
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return windows.keep_best(x, ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_linenumber"), F.col("l_partkey")])


MASK_SQL = """mask AS (SELECT user_id, secs, window_id, metric > 50 AS m FROM obs WHERE metric IS NOT NULL),
closed AS (SELECT *, m OR (coalesce(lag(m) OVER w, false) AND coalesce(lead(m) OVER w, false)) AS c FROM mask WINDOW w AS (PARTITION BY user_id ORDER BY secs, window_id)),
starts AS (SELECT *, c AND NOT coalesce(lag(c) OVER (PARTITION BY user_id ORDER BY secs, window_id), false) AS s FROM closed),
islands AS (SELECT *, SUM(CAST(s AS INT)) OVER (PARTITION BY user_id ORDER BY secs, window_id) AS run FROM starts)"""


@query(f"""WITH {OBS_SQL}, {MASK_SQL}, r AS (SELECT user_id, run, COUNT(*) AS n FROM islands WHERE c GROUP BY ALL)
SELECT user_id, COUNT(*) AS events, CAST(SUM(n) AS BIGINT) AS rows_on, ROUND(AVG(n * 0.1), 6) AS mean_duration, COUNT(*) FILTER (n <= 3) AS short_events FROM r GROUP BY user_id""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("secs", "window_id")
    o = obs(spark, sf_dir).filter("metric is not null").select("user_id", "secs", "window_id", (F.col("metric") > 50).alias("m"))
    r = windows.runs(o.withColumn("c", windows.close_gaps(F.col("m"), w)), "user_id", ["secs", "window_id"], "c")
    return r.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("rows").alias("rows_on"), F.round(F.avg(F.col("rows") * 0.1), 6).alias("mean_duration"),
                                    F.count(F.when(F.col("rows") <= 3, 1)).alias("short_events"))


@query(f"""WITH {OBS_SQL}, b AS (SELECT user_id, window_id, secs, metric, CASE WHEN secs - lag(secs) OVER (PARTITION BY user_id ORDER BY secs, window_id) > 21600
  OR lag(secs) OVER (PARTITION BY user_id ORDER BY secs, window_id) IS NULL THEN 1 ELSE 0 END AS b FROM obs),
s AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY secs, window_id) AS segment FROM b)
SELECT user_id, window_id, CAST(segment AS BIGINT) AS segment, ROUND(CASE WHEN COUNT(metric) OVER w >= 3 THEN AVG(metric) OVER w END, 6) AS smoothed FROM s
WINDOW w AS (PARTITION BY user_id, segment ORDER BY secs, window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def sessionize_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessionize(obs(spark, sf_dir).select("user_id", "window_id", "secs", "metric"), "user_id", F.col("secs"), ["secs", "window_id"], 21600)
    return s.select("user_id", "window_id", "segment", F.round(windows.rolling_mean("metric", ["user_id", "segment"], ["secs", "window_id"], 5), 6).alias("smoothed"))


@query(f"""WITH {OBS_SQL} SELECT session_id, date, ROUND(1 + 0.0 * COUNT(*) + date_diff('day', MIN(date) OVER (PARTITION BY session_id), date), 6) AS age,
 CASE WHEN percent_rank() OVER w <= 0.334 THEN 'Early' WHEN percent_rank() OVER w <= 0.667 THEN 'Middle' ELSE 'Late' END AS progress
 FROM (SELECT session_id, CAST(start_dt AS DATE) AS date FROM obs) GROUP BY session_id, date WINDOW w AS (PARTITION BY session_id ORDER BY date)""")
def progress_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = obs(spark, sf_dir).select("session_id", F.col("start_dt").cast("date").alias("date")).distinct()
    w = Window.partitionBy("session_id").orderBy("date")
    p = F.percent_rank().over(w)
    age = 1.0 + F.datediff("date", F.min("date").over(Window.partitionBy("session_id")))
    return d.select("session_id", "date", age.alias("age"), F.when(p <= 0.334, "Early").when(p <= 0.667, "Middle").otherwise("Late").alias("progress"))


@query(f"""WITH {OBS_SQL}, o AS (SELECT session_id, CAST(start_dt AS DATE) AS d, start_dt, window_id FROM obs),
s AS (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER w THEN 1 ELSE 0 END AS b FROM o WINDOW w AS (PARTITION BY session_id ORDER BY start_dt, window_id)),
r AS (SELECT *, SUM(b) OVER (PARTITION BY session_id ORDER BY start_dt, window_id) AS band FROM s)
SELECT session_id, CAST(band AS BIGINT) AS band, d AS date, COUNT(*) AS frames FROM r GROUP BY ALL""")
def date_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of time change their date only forwards, so a band is a date of the session."""
    o = obs(spark, sf_dir).groupBy("session_id", F.col("start_dt").cast("date").alias("date")).agg(F.count("*").alias("frames"))
    return o.withColumn("band", F.row_number().over(Window.partitionBy("session_id").orderBy("date")).cast("long"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT zone, MIN(struct_pack(t := start_dt, w := window_id)) AS f FROM obs GROUP BY zone)
SELECT zone, row_number() OVER (ORDER BY f.t, f.w) - 1 AS state_id FROM a""")
def state_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = obs(spark, sf_dir).groupBy("zone").agg(F.min(F.struct("start_dt", "window_id")).alias("f"))
    return a.select("zone", (F.row_number().over(Window.orderBy("f")) - 1).cast("long").alias("state_id"))


@query(f"""WITH {OBS_SQL}, s AS (SELECT user_id, MIN(start_dt) AS first_start, COUNT(*) AS n FROM obs GROUP BY user_id)
SELECT user_id, n, CAST(ntile(3) OVER (ORDER BY first_start, user_id) - 1 AS BIGINT) AS fold FROM s""")
def fold_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = obs(spark, sf_dir).groupBy("user_id").agg(F.min("start_dt").alias("first_start"), F.count("*").alias("n"))
    return blocks(s, ["first_start", "user_id"], 3, "fold").select("user_id", "n", "fold")


@query(f"""WITH {OBS_SQL}, t AS (SELECT session_id, CAST(start_dt AS DATE) AS date, hour(start_dt) AS h, zone, COUNT(DISTINCT user_id) AS n FROM obs GROUP BY ALL)
SELECT session_id, date, zone, ROUND(SUM(n) / 24.0, 6) AS visible_mean, CAST(MAX(n) AS BIGINT) AS visible_max FROM t GROUP BY ALL""")
def visible_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).groupBy("session_id", F.col("start_dt").cast("date").alias("date"), F.hour("start_dt").alias("h"), "zone").agg(F.countDistinct("user_id").alias("n"))
    return o.groupBy("session_id", "date", "zone").agg(F.round(F.sum("n") / 24.0, 6).alias("visible_mean"), F.max("n").alias("visible_max"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT user_id, zone, COUNT(*) AS n, MIN(window_id) AS seen FROM obs GROUP BY ALL)
SELECT user_id, zone AS dominant, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""")
def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = obs(spark, sf_dir).groupBy("user_id", "zone").agg(F.count("*").alias("n"), F.min("window_id").alias("seen"))
    return windows.keep_best(c, ["user_id"], [F.col("n").desc(), F.col("seen")]).select("user_id", F.col("zone").alias("dominant"), "n")


@query(f"""WITH {OBS_SQL} SELECT session_id, CAST(start_dt AS DATE) AS date, zone, COUNT(*) AS records, COUNT(DISTINCT user_id) AS tracks, ROUND(AVG(quality), 6) AS mean_quality
 FROM obs GROUP BY GROUPING SETS ((session_id, CAST(start_dt AS DATE)), (session_id, CAST(start_dt AS DATE), zone))""")
def behavior_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumn("date", F.col("start_dt").cast("date"))
    sets = [[F.col("session_id"), F.col("date")], [F.col("session_id"), F.col("date"), F.col("zone")]]
    return o.groupingSets(sets, "session_id", "date", "zone").agg(F.count("*").alias("records"), F.countDistinct("user_id").alias("tracks"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query(f"""WITH {OBS_SQL}, t AS (SELECT session_id, user_id, COUNT(*) AS n, SUM(quality) AS s FROM obs GROUP BY ALL),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, s DESC, user_id) <= 30)
SELECT session_id, user_id, n, ROUND(s, 4) AS quality_sum, row_number() OVER (PARTITION BY session_id ORDER BY user_id) AS place FROM k""")
def top_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = obs(spark, sf_dir).groupBy("session_id", "user_id").agg(F.count("*").alias("n"), F.sum("quality").alias("s"))
    k = windows.first_rows(t, [(["session_id"], 30)], [F.col("n").desc(), F.round("s", 9).desc(), F.col("user_id")])
    return k.select("session_id", "user_id", "n", F.round("s", 4).alias("quality_sum"), F.row_number().over(Window.partitionBy("session_id").orderBy("user_id")).cast("long").alias("place"))


@query(f"""WITH {OBS_SQL}, e AS (SELECT user_id, CAST(start_dt AS DATE) AS date, COUNT(*) FILTER (zone = 'feeding') AS f, COUNT(*) FILTER (zone = 'drinking') AS d,
 COUNT(*) FILTER (zone = 'resting') AS r, COUNT(DISTINCT hour(start_dt)) AS h FROM obs GROUP BY ALL)
SELECT user_id, date, CASE WHEN f >= 2 AND h >= 2 THEN 'feeding' WHEN d >= 2 AND h >= 2 THEN 'drinking' WHEN r >= 1 THEN 'resting' ELSE 'idle' END AS action FROM e""")
def priority_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda z: F.count(F.when(F.col("zone") == z, 1))
    e = obs(spark, sf_dir).groupBy("user_id", F.col("start_dt").cast("date").alias("date")).agg(n("feeding").alias("f"), n("drinking").alias("d"), n("resting").alias("r"), F.countDistinct(F.hour("start_dt")).alias("h"))
    meets = lambda c, k, h: F.coalesce(F.col(c) >= k, F.lit(False)) & (F.col("h") >= h)
    return e.select("user_id", "date", F.coalesce(F.when(meets("f", 2, 2), "feeding"), F.when(meets("d", 2, 2), "drinking"), F.when(meets("r", 1, 0), "resting"), F.lit("idle")).alias("action"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT zone, greatest(quantile_cont(metric, 0.95), 0.35 * MAX(metric), 1e-4) AS reference FROM obs WHERE metric > 0 GROUP BY zone)
SELECT o.zone, COUNT(*) AS n, ROUND(ANY_VALUE(reference), 6) AS reference, ROUND(AVG(sqrt(least(greatest(metric / reference, 0), 1))), 6) AS calibrated_mean,
 COUNT(*) FILTER (sqrt(least(greatest(metric / reference, 0), 1)) >= CASE o.zone WHEN 'resting' THEN 0.85 ELSE 0.95 END) AS abnormal
 FROM obs o JOIN c ON o.zone = c.zone WHERE metric IS NOT NULL GROUP BY o.zone""")
def zone_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).filter("metric is not null")
    x = join_keys(o, zones.calibration(o, "zone", "metric"), ["zone"], "inner").withColumn("v", zones.calibrated(F.col("metric"), F.col("reference")))
    limit = F.when(F.col("zone") == "resting", 0.85).otherwise(0.95)
    return x.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.first("reference"), 6).alias("reference"), F.round(F.avg("v"), 6).alias("calibrated_mean"),
                                 F.count(F.when(F.col("v") >= limit, 1)).alias("abnormal"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT session_id, metric, quality, median(metric) OVER (PARTITION BY session_id) AS c FROM obs WHERE metric IS NOT NULL),
s AS (SELECT session_id, MIN(c) AS center, greatest(1.4826 * median(abs(metric - c)), (quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25)) / 1.349, stddev_pop(metric), 1e-6) AS scale FROM m GROUP BY session_id)
SELECT session_id, ROUND(center, 6) AS center, ROUND(scale, 6) AS scale FROM s""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import robust_center_scale

    return robust_center_scale(obs(spark, sf_dir), ["session_id"], "metric").select("session_id", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))
