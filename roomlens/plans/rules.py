"""Rules and predicates: paths, statuses, complete rows, slots, bands, picks, definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import num, paths, time
from ..operators import events, quality
from ..operators.environment import worst_status
from .adapters import GEOM_SQL, OBS_SQL, geom, obs, table
from .registry import query
from .studies import EVENT_SQL, anchors

PATH_SQL = """n AS (SELECT l_orderkey, l_linenumber, l_suppkey AS s, l_partkey AS k, CASE l_linenumber WHEN 1 THEN 'data/Video/Room 0' || l_suppkey % 4 || '/Day ' || l_partkey % 9 || '/clip_' || l_orderkey || '.MP4' WHEN 2 THEN 'data/video/room_' || l_suppkey % 4 || '/a/b b/clip.mp4'
 WHEN 3 THEN 'video/ROOM-' || l_suppkey % 12 || '/x.mp4' WHEN 4 THEN 'plain/Day ' || l_partkey % 9 || '/room' || l_suppkey % 3 || '.mp4' ELSE 'misc/groom' || l_suppkey % 5 || '/file' || l_linenumber || '.mp4' END AS path FROM lineitem)"""


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as paths of recordings in five layouts."""
    i = table(spark, sf_dir, "lineitem")
    s, p, t = F.col("l_suppkey"), F.col("l_partkey"), lambda c: c.cast("string")
    path = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("data/Video/Room 0"), t(s % 4), F.lit("/Day "), t(p % 9), F.lit("/clip_"), t(F.col("l_orderkey")), F.lit(".MP4")))
            .when(F.col("l_linenumber") == 2, F.concat(F.lit("data/video/room_"), t(s % 4), F.lit("/a/b b/clip.mp4")))
            .when(F.col("l_linenumber") == 3, F.concat(F.lit("video/ROOM-"), t(s % 12), F.lit("/x.mp4")))
            .when(F.col("l_linenumber") == 4, F.concat(F.lit("plain/Day "), t(p % 9), F.lit("/room"), t(s % 3), F.lit(".mp4")))
            .otherwise(F.concat(F.lit("misc/groom"), t(s % 5), F.lit("/file"), t(F.col("l_linenumber")), F.lit(".mp4"))))
    return i.select("l_orderkey", "l_linenumber", path.alias("path"), s.alias("s"), p.alias("p"))


@query(f"""WITH {PATH_SQL}, r AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'room_' || s % 4 WHEN 2 THEN 'room_' || s % 4 WHEN 3 THEN 'room_' || s % 12 WHEN 4 THEN 'room_' || s % 3 ELSE 'unknown_room' END AS room_id FROM n)
SELECT l_orderkey, l_linenumber, room_id, CASE l_linenumber WHEN 1 THEN room_id || '_data_video_room_0' || s % 4 || '_day_' || k % 9 WHEN 2 THEN room_id || '_a_b_b' WHEN 3 THEN room_id WHEN 4 THEN room_id || '_plain_day_' || k % 9 ELSE 'misc_groom' || s % 5 END AS session_id,
 CASE l_linenumber WHEN 1 THEN 'Room 0' || s % 4 WHEN 2 THEN 'room_' || s % 4 WHEN 3 THEN 'ROOM-' || s % 12 WHEN 4 THEN 'Room ' || s % 3 ELSE 'unknown_room' END AS room_folder,
 CASE l_linenumber WHEN 1 THEN 'Day ' || k % 9 WHEN 2 THEN 'a' WHEN 3 THEN 'ROOM-' || s % 12 ELSE 'own' END AS session_folder, CASE WHEN starts_with(path, 'data/') THEN path[6:] ELSE path END AS relative FROM r""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms, sessions and folders of paths; the session's own name stands where the path has none."""
    p = F.col("path")
    x = file_paths(spark, sf_dir).withColumn("room_id", paths.room_of_path(p))
    room, session = paths.folders_of_path(p, F.lit(""), F.col("room_id"), F.lit("own"))
    return x.select("l_orderkey", "l_linenumber", "room_id", paths.session_of_path(p, F.col("room_id")).alias("session_id"), room.alias("room_folder"), session.alias("session_folder"), paths.relative_path(p, F.lit("data/"), "relative").alias("relative"))


@query("""SELECT o_custkey, CASE WHEN COUNT(*) FILTER (o_orderstatus = 'F') > 0 THEN 'failed' WHEN COUNT(*) FILTER (o_orderstatus = 'P') > 0 THEN 'warning' ELSE 'ok' END AS status, COUNT(*) AS n FROM orders GROUP BY 1""")
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "warning").otherwise("ok").alias("s"))
    return o.groupBy("o_custkey").agg(worst_status(F.col("s")).alias("status"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, s_suppkey AS media_id, CASE WHEN s_suppkey IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN s_suppkey IS NULL THEN 'media_not_found' ELSE '' END AS warnings FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def media_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of media that are not known stay, as failed ones."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("media_id"))
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(s, F.col("media_id") == F.col("o_custkey"), "left")
    miss = F.col("media_id").isNull()
    return x.select("o_orderkey", "media_id", F.when(miss, "failed").otherwise("ok").alias("status"), F.when(miss, "media_not_found").otherwise("").alias("warnings"))


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, CASE WHEN metric IS NOT NULL AND isfinite(metric) THEN coalesce(quality, 0) ELSE 0 END AS w1, coalesce(quality, 0) AS w2 FROM obs), t AS (SELECT AVG(metric) AS c, stddev_samp(metric) AS s FROM obs WHERE user_id % 3 <> 0)
SELECT window_id, coalesce(quality > 0 AND metric > 0 AND start_dt >= TIMESTAMP '2024-01-10', false) AS complete, ROUND((w1 + w2) / 2, 6) AS row_weight, ROUND((CAST(w1 > 0 AS INT) + CAST(w2 > 0 AS INT)) / 2.0, 6) AS row_weight_binary,
 ROUND(CASE WHEN w1 > 0 AND metric IS NOT NULL THEN (metric - c) / s ELSE 0 END, 6) AS scaled FROM w, t""")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows, row weights, and values scaled by the rows of the training folds."""
    o = obs(spark, sf_dir)
    w = lambda b: quality.row_weight(quality.weights(["metric", "quality"], ["quality", "quality"], b))
    t = o.filter("user_id % 3 <> 0").agg(F.avg("metric").alias("c"), F.stddev_samp("metric").alias("s"))
    x = o.crossJoin(F.broadcast(t))  # one row
    first = quality.weights(["metric"], ["quality"])[0]
    return x.select("window_id", F.coalesce(quality.complete(["quality", "metric"], "start_dt", "2024-01-10"), F.lit(False)).alias("complete"), F.round(w(False), 6).alias("row_weight"), F.round(w(True), 6).alias("row_weight_binary"),
                    F.round(quality.train_scaled(F.col("metric"), first, F.col("c"), F.col("s")), 6).alias("scaled"))


@query(f"""WITH {OBS_SQL} SELECT session_id, COUNT(*) FILTER (minute(start_dt) % 5 = 0 AND second(start_dt) < 30) AS candidate_slots, COUNT(*) FILTER (epoch_us(start_dt) // 1000000 % 10 = 0 AND epoch_us(start_dt) % 1000000 = 0) AS sampled, COUNT(*) AS n FROM obs GROUP BY 1""")
def sampled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return obs(spark, sf_dir).groupBy("session_id").agg(n(time.candidate_slot(F.col("start_dt"))).alias("candidate_slots"), n(time.sampled(F.col("secs"), 10.0, 0.0)).alias("sampled"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT s_suppkey, 10000 + s_acctbal / 50 AS scale FROM supplier), m AS (SELECT median(scale) AS m FROM s) SELECT s_suppkey, ROUND(scale, 6) AS scale FROM s, m WHERE scale / m BETWEEN 0.98 AND 1.02""")
def camera_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (10000 + F.col("s_acctbal") / 50).alias("scale"))
    return quality.stable_band(s, "s_suppkey", "scale").withColumn("scale", F.round("scale", 6))


@query("""SELECT c_custkey FROM customer WHERE lower(trim(CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'false' END)) = 'true' AND lower(trim(CASE c_nationkey % 3 WHEN 0 THEN ' TRUE ' WHEN 1 THEN '' END)) = 'true'""")
def eligible_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("c_acctbal") > 0, "True").otherwise("false")
    b = F.when(F.col("c_nationkey") % 3 == 0, " TRUE ").when(F.col("c_nationkey") % 3 == 1, "")
    return table(spark, sf_dir, "customer").filter(quality.truthy(a, b)).select("c_custkey")


@query(f"""WITH {OBS_SQL} SELECT session_id, user_id, window_id, CAST(row_number() OVER (PARTITION BY session_id, user_id ORDER BY quality NULLS LAST, start_dt NULLS LAST, window_id NULLS LAST) AS INT) AS place FROM obs""")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order by several keys, nulls last."""
    w = Window.partitionBy("session_id", "user_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("quality", "start_dt", "window_id")])
    return obs(spark, sf_dir).select("session_id", "user_id", "window_id", F.row_number().over(w).alias("place"))


@query(f"""WITH {OBS_SQL}, {GEOM_SQL}, c AS (SELECT geometry_id, MAX(area) AS coverage FROM geom GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY coverage, geometry_id) - 1 AS i, COUNT(*) OVER () AS n FROM c)
SELECT pick, geometry_id, ROUND(coverage, 6) AS coverage FROM n, LATERAL (VALUES (CASE WHEN i = 0 THEN 'minimum' END), (CASE WHEN i = n // 2 THEN 'median' END), (CASE WHEN i = n - 1 THEN 'maximum' END)) v(pick) WHERE pick IS NOT NULL""")
def coverage_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometries of least, middle and largest coverage; there are at most 50."""
    c = geom(spark, sf_dir).groupBy("geometry_id").agg(F.max("area").alias("coverage"))
    return quality.picks(c, [F.col("coverage"), F.col("geometry_id")]).select("pick", "geometry_id", F.round("coverage", 6).alias("coverage"))


@query("""WITH a AS (SELECT o_custkey AS k, 0 AS priority, 'order' AS kind, o_orderkey AS ref FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 1, 'low', o_orderkey FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT c_custkey, 2, 'customer', c_nationkey FROM customer)
SELECT k, CAST(priority AS INT) AS priority, kind, ref FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, ref) = 1""")
def first_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three sources that defines a key."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    row = lambda d, k, kind, r: d.select(F.col(k).alias("k"), F.lit(kind).alias("kind"), F.col(r).cast("long").alias("ref"))
    parts = [row(o.filter("o_orderpriority = '1-URGENT'"), "o_custkey", "order", "o_orderkey"), row(o.filter("o_totalprice < 50000"), "o_custkey", "low", "o_orderkey"), row(c, "c_custkey", "customer", "c_nationkey")]
    return quality.first_defined(parts, "k", ["ref"])


@query("""WITH a AS (SELECT l_suppkey, CAST(d AS INT) AS pixels, AVG(CAST((l_quantity >= 15) = (l_quantity + d >= 15) AS INT)) AS agreement, COUNT(*) AS n FROM lineitem, (VALUES (-10), (-5), (5), (10)) v(d) GROUP BY ALL)
SELECT pixels, COUNT(*) AS sessions, CAST(SUM(n) AS BIGINT) AS detections, ROUND(SUM(agreement * n) / SUM(n), 6) AS weighted_agreement, ROUND(median(agreement), 6) AS median_agreement, ROUND(quantile_cont(agreement, 0.1), 6) AS q10_agreement FROM a GROUP BY pixels""")
def perturbation_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an assignment survives a shift: over all detections, and median and tenth percentile of the sessions."""
    q = F.col("l_quantity")
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", q, F.explode(F.array(*map(F.lit, (-10, -5, 5, 10)))).alias("pixels"))
    a = x.groupBy("l_suppkey", "pixels").agg(F.avg(((q >= 15) == (q + F.col("pixels") >= 15)).cast("int")).alias("a"), F.count("*").alias("n"))
    r = lambda c: F.round(c, 6)
    return a.groupBy("pixels").agg(F.count("*").alias("sessions"), F.sum("n").alias("detections"), r(F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("weighted_agreement"), r(F.percentile("a", 0.5)).alias("median_agreement"), r(F.percentile("a", 0.1)).alias("q10_agreement"))


@query(f"""WITH {OBS_SQL}, v AS (SELECT zone, user_id, AVG(metric) AS m, AVG(quality) AS q FROM obs GROUP BY ALL), p AS (SELECT * FROM v WHERE m IS NOT NULL AND q IS NOT NULL),
s AS (SELECT (m - AVG(m) OVER w) / nullif(stddev_samp(m) OVER w, 0) AS x, (q - AVG(q) OVER w) / nullif(stddev_samp(q) OVER w, 0) AS y FROM p WINDOW w AS (PARTITION BY zone)) SELECT COUNT(*) AS n, ROUND(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 5) AS pooled_r FROM s""")
def pooled_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation over all zones of values standardised in each."""
    v = obs(spark, sf_dir).groupBy("zone", "user_id").agg(F.avg("metric").alias("m"), F.avg("quality").alias("q"))
    return quality.pooled(v, "zone", ["m", "q"]).agg(F.count("*").alias("n"), F.round(num.safe_corr(F.col("m"), F.col("q")), 5).alias("pooled_r"))


COVER = (("before", -86400.0, 0.0, 2), ("during", 0.0, 43200.0, 1), ("after", 43200.0, 129600.0, 2))


@query(f"""WITH {OBS_SQL}, {EVENT_SQL}, ph(phase, a, b) AS (VALUES ('before', -86400, 0), ('during', 0, 43200), ('after', 43200, 129600)),
c AS (SELECT event_id, COUNT(*) FILTER (phase = 'before') AS x, COUNT(*) FILTER (phase = 'during') AS y, COUNT(*) FILTER (phase = 'after') AS z FROM ev e, ph, obs o WHERE o.user_id = e.user_id AND o.secs >= e.secs + a AND o.secs < e.secs + b GROUP BY 1)
SELECT ev.event_id, coalesce(x >= 2 AND y >= 1 AND z >= 2, false) AS covered FROM ev LEFT JOIN c USING (event_id)""")
def phase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every phase of an event has rows enough."""
    o = obs(spark, sf_dir)
    return events.phase_counts(o.select("user_id", "secs"), anchors(o), "user_id", COVER)


@query("""WITH c AS (SELECT quality AS t, toxic AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT DISTINCT t AS label FROM c),
m AS (SELECT label, COUNT(*) FILTER (t = label) AS s, COUNT(*) FILTER (p = label) AS q, COUNT(*) FILTER (t = label AND p = label) AS h FROM k, c GROUP BY label)
SELECT ROUND(AVG(h / s), 6) AS balanced_accuracy, ROUND(AVG(CASE WHEN s + q > 0 THEN 2 * h / (s + q) ELSE 0 END), 6) AS macro_f1, COUNT(*) AS labels FROM m""")
def balanced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall and mean F1 over the labels that occur."""
    c = table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), F.col("toxic").alias("p")).filter("t is not null and p is not null")
    cells = c.groupBy("t", "p").agg(F.count("*").alias("n"))
    true = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("h"))
    said = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("q"))
    x = true.join(said, "label", "left").select("s", "h", F.coalesce("q", F.lit(0)).alias("q"))
    return x.agg(F.round(F.avg(F.col("h") / F.col("s")), 6).alias("balanced_accuracy"), F.round(F.avg(2 * F.col("h") / (F.col("s") + F.col("q"))), 6).alias("macro_f1"), F.count("*").alias("labels"))


SCALE_SQL = """a AS (SELECT user_id % 50 AS k, AVG(metric) AS raw FROM obs GROUP BY 1), g AS (SELECT k, raw, raw / (1 + k % 7) AS norm, (1 + k % 7) * 1.0 AS geo FROM a),
d AS (SELECT raw - lag(raw) OVER (ORDER BY k) AS raw, norm - lag(norm) OVER (ORDER BY k) AS norm, geo - lag(geo) OVER (ORDER BY k) AS geo FROM g),
r AS (SELECT *, rank() OVER (ORDER BY raw) + (COUNT(*) OVER (PARTITION BY raw) - 1) / 2.0 AS rr, rank() OVER (ORDER BY norm) + (COUNT(*) OVER (PARTITION BY norm) - 1) / 2.0 AS rn, rank() OVER (ORDER BY geo) + (COUNT(*) OVER (PARTITION BY geo) - 1) / 2.0 AS rg FROM d WHERE raw IS NOT NULL)"""


@query(f"""WITH {OBS_SQL}, {SCALE_SQL} SELECT COUNT(*) AS boundaries, ROUND(corr(geo, raw), 6) AS raw_pearson, ROUND(corr(geo, norm), 6) AS normalized_pearson, ROUND(corr(rg, rr), 6) AS raw_spearman, ROUND(corr(rg, rn), 6) AS normalized_spearman FROM r""")
def camera_scale_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a reading, raw and by scale, against steps of the scale, between at most 50 geometries in order."""
    from ..operators.stats import average_rank

    k = F.col("user_id") % 50
    g = obs(spark, sf_dir).groupBy(k.alias("k")).agg(F.avg("metric").alias("raw")).withColumn("geo", 1.0 + F.col("k") % 7).withColumn("norm", F.col("raw") / F.col("geo"))
    w = Window.orderBy("k")  # at most 50 rows
    d = g.select(*[(F.col(c) - F.lag(c).over(w)).alias(c) for c in ("raw", "norm", "geo")]).filter("raw is not null")
    r = d.select("*", *[average_rank(c, []).alias(f"r_{c}") for c in ("raw", "norm", "geo")])
    c = lambda a, b: F.round(num.safe_corr(F.col(a), F.col(b)), 6)
    return r.agg(F.count("*").alias("boundaries"), c("geo", "raw").alias("raw_pearson"), c("geo", "norm").alias("normalized_pearson"), c("r_geo", "r_raw").alias("raw_spearman"), c("r_geo", "r_norm").alias("normalized_spearman"))


@query(f"""WITH {OBS_SQL}, d AS (SELECT session_id, CAST(start_dt AS DATE) AS date, SUM(metric * quality) / nullif(SUM(CASE WHEN metric IS NOT NULL THEN quality END), 0) AS raw, AVG(metric / (1 + user_id % 7)) AS norm FROM obs WHERE quality > 0 GROUP BY ALL),
l AS (SELECT session_id, 'raw' AS series, date, raw AS v FROM d UNION ALL SELECT session_id, 'normalized', date, norm FROM d), k AS (SELECT * FROM l WHERE v IS NOT NULL),
r AS (SELECT session_id, series, rank() OVER (PARTITION BY session_id, series ORDER BY date) AS a, rank() OVER (PARTITION BY session_id, series ORDER BY v) + (COUNT(*) OVER (PARTITION BY session_id, series, v) - 1) / 2.0 AS b FROM k)
SELECT session_id, series, COUNT(*) AS days, ROUND(corr(a, b), 6) AS rho FROM r GROUP BY ALL""")
def downstream_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend over the days of a session, of a raw and of a normalised daily series."""
    from ..operators.stats import spearman

    o = obs(spark, sf_dir).filter("quality > 0")
    d = o.groupBy("session_id", F.col("start_dt").cast("date").alias("date")).agg(num.weighted_mean(F.col("metric"), F.col("quality")).alias("raw"), F.avg(F.col("metric") / (1 + F.col("user_id") % 7)).alias("normalized"))
    x = d.unpivot(["session_id", "date"], ["raw", "normalized"], "series", "v")
    return spearman(x, ["session_id", "series"], "date", "v").select("session_id", "series", F.col("n").alias("days"), F.round("rho", 6).alias("rho"))


@query(f"""WITH {OBS_SQL}, s AS (SELECT session_id, window_id, zone, metric, quality FROM obs WHERE metric BETWEEN 20 AND 60 AND quality >= 0.3 AND zone <> 'outside') SELECT session_id, window_id, zone FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY abs(metric - 40), quality DESC, window_id) = 1""")
def example_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best example row of each session within ranges of value, quality and zone."""
    s = obs(spark, sf_dir).filter("metric between 20 and 60 and quality >= 0.3 and zone <> 'outside'").select("session_id", "window_id", "zone", "metric", "quality")
    best = F.min_by(F.struct("window_id", "zone"), F.struct(F.abs(F.col("metric") - 40).alias("d"), (-F.col("quality")).alias("q"), F.col("window_id")))
    return s.groupBy("session_id").agg(best.alias("b")).select("session_id", "b.window_id", "b.zone")
