"""Lookups with fallback, composite matches, samples, summaries, frame differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import compare_key
from ..operators import audio, models, stats
from ..operators.quantiles import percentiles
from ..operators.shared import join_keys
from ..operators.windows import first_rows, keep_best
from .adapters import OBS_SQL, obs, table
from .registry import query
from .series import HOURLY_B
from ..operators import balance


@query(f"""WITH {OBS_SQL} SELECT session_id, COUNT(metric) AS n, ROUND(AVG(metric), 6) AS mean, ROUND(MIN(metric), 6) AS low, ROUND(MAX(metric), 6) AS high, ROUND(median(metric), 6) AS middle,
 COUNT(DISTINCT user_id) AS tracks, arg_max(window_id, struct_pack(m := metric, w := -window_id)) AS best_window FROM obs WHERE metric IS NOT NULL GROUP BY session_id""")
def summary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).filter("metric is not null")
    r = lambda c, n: F.round(c, 6).alias(n)
    middle = percentiles(o, ["session_id"], {"metric": (0.5,)}).select("session_id", r(F.col("metric")[0], "middle"))
    s = o.groupBy("session_id").agg(F.count("metric").alias("n"), r(F.avg("metric"), "mean"), r(F.min("metric"), "low"), r(F.max("metric"), "high"),
                                    F.countDistinct("user_id").alias("tracks"), F.max_by("window_id", F.struct("metric", -F.col("window_id"))).alias("best_window"))
    return join_keys(s, middle, ["session_id"])


@query(f"""WITH {OBS_SQL} SELECT strftime(start_dt, '%Y-%m') AS month, zone, ROUND(AVG(CAST(coalesce(quality, 0) > 0.5 AS INT)), 6) AS available, COUNT(*) - COUNT(metric) AS missing, COUNT(*) AS n FROM obs GROUP BY ALL""")
def monthly_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.coalesce("quality", F.lit(0.0)) > 0.5).cast("int")
    return obs(spark, sf_dir).groupBy(F.date_format("start_dt", "yyyy-MM").alias("month"), "zone").agg(F.round(F.avg(ok), 6).alias("available"), (F.count("*") - F.count("metric")).alias("missing"), F.count("*").alias("n"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT user_id, window_id, CASE WHEN metric > 20 THEN metric END AS a, CASE WHEN quality > 0.3 THEN quality END AS b FROM obs)
SELECT user_id, ROUND(arg_min(a, window_id) FILTER (a IS NOT NULL), 6) AS first_metric, ROUND(arg_min(b, window_id) FILTER (b IS NOT NULL), 6) AS first_quality FROM c GROUP BY user_id""")
def first_present_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value of each column on its own."""
    a, b = F.when(F.col("metric") > 20, F.col("metric")), F.when(F.col("quality") > 0.3, F.col("quality"))
    first = lambda c: F.round(F.min_by(c, F.when(c.isNotNull(), F.col("window_id"))), 6)
    return obs(spark, sf_dir).groupBy("user_id").agg(first(a).alias("first_metric"), first(b).alias("first_quality"))


@query(f"""WITH {OBS_SQL} SELECT zone, window_id, user_id FROM obs QUALIFY row_number() OVER (PARTITION BY zone ORDER BY md5('7:' || window_id), window_id) <= 100""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 rows of each zone, in the order of a seeded hash."""
    h = F.md5(F.concat(F.lit("7:"), F.col("window_id").cast("string")))
    return first_rows(obs(spark, sf_dir).select("zone", "window_id", "user_id", h.alias("h")), [(["zone"], 100)], [F.col("h"), F.col("window_id")]).drop("h")


@query("""WITH cfg AS (SELECT n_nationkey AS room, CASE WHEN n_nationkey % 2 = 0 THEN 'AUTOMOBILE' END AS session, 'config_' || n_nationkey AS config FROM nation WHERE n_nationkey % 3 <> 0)
SELECT c_custkey, coalesce(s.config, r.config) AS config, CASE WHEN s.config IS NOT NULL THEN 'session' WHEN r.config IS NOT NULL THEN 'room' ELSE 'none' END AS scope
 FROM customer LEFT JOIN cfg s ON s.room = c_nationkey AND s.session = c_mktsegment LEFT JOIN cfg r ON r.room = c_nationkey AND r.session IS NULL""")
def config_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config of a room and session, else of the room, else none."""
    k = F.col("n_nationkey")
    cfg = table(spark, sf_dir, "nation").filter(k % 3 != 0).select(k.alias("room"), F.when(k % 2 == 0, "AUTOMOBILE").alias("session"), F.concat(F.lit("config_"), k.cast("string")).alias("config"))
    c = table(spark, sf_dir, "customer")
    s, r = (F.broadcast(cfg.filter(w).select(F.col("room").alias(f"{n}_room"), F.col("session").alias(f"{n}_session"), F.col("config").alias(n))) for n, w in (("a", "session is not null"), ("b", "session is null")))
    x = c.join(s, (F.col("a_room") == F.col("c_nationkey")) & (F.col("a_session") == F.col("c_mktsegment")), "left").join(r, F.col("b_room") == F.col("c_nationkey"), "left")
    return x.select("c_custkey", F.coalesce("a", "b").alias("config"), F.when(F.col("a").isNotNull(), "session").when(F.col("b").isNotNull(), "room").otherwise("none").alias("scope"))


@query("""WITH m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, MIN(o_orderkey) AS media FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, media, CASE WHEN media IS NULL THEN 'no_media_match' ELSE '' END AS exclusion
 FROM lineitem LEFT JOIN m ON o_custkey = l_partkey % 1000 AND d = CAST(l_shipdate AS DATE)""")
def composite_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first medium of a composite key, or the reason for leaving a row out."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("media"))
    m = keep_best(o, ["o_custkey", "d"], [F.col("media")])
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("k"), F.col("l_shipdate").cast("date").alias("s"))
    x = i.join(m, (F.col("k") == F.col("o_custkey")) & (F.col("s") == F.col("d")), "left")
    return x.select("l_orderkey", "l_linenumber", "media", F.when(F.col("media").isNull(), "no_media_match").otherwise("").alias("exclusion"))


@query(f"""WITH {OBS_SQL}, {HOURLY_B}, j AS (SELECT a.date, a.daily_mean AS x, b.daily_mean AS y FROM daily a JOIN daily b ON a.date = b.date AND a.session_id = 0 AND b.session_id = 1),
r AS (SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT COUNT(*) AS n, ROUND(corr(rx, ry), 6) AS rho FROM r HAVING COUNT(*) > 0""")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two sessions' daily series over their common dates."""
    d = balance.by_session(obs(spark, sf_dir))
    side = lambda k, n: d.filter(F.col("session_id") == k).select("date", F.col("daily_mean").alias(n))
    j = side(0, "x").join(side(1, "y"), "date").withColumn("one", F.lit(1))
    return stats.spearman(j, ["one"], "x", "y").select("n", F.round("rho", 6).alias("rho"))


@query("""WITH a AS (SELECT DISTINCT p_brand, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS k FROM part), b AS (SELECT DISTINCT p_brand AS folder, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS f FROM part),
m AS (SELECT p_brand, folder, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN k = f THEN 0 ELSE 1 END, folder) AS rn FROM a JOIN b ON contains(k, f) OR contains(f, k)) SELECT p_brand, folder FROM m WHERE rn = 1""")
def folder_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder whose normalised name equals, holds or is held by a brand's; both sides are small dimensions."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("k", compare_key(F.col("p_brand")))
    f = p.select(F.col("p_brand").alias("folder"), F.col("k").alias("f"))
    m = p.join(F.broadcast(f), F.contains("k", "f") | F.contains("f", "k"))
    return keep_best(m, ["p_brand"], [F.when(F.col("k") == F.col("f"), 0).otherwise(1), F.col("folder")]).select("p_brand", "folder")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), s AS (SELECT *, list_transform(v, lambda x: x / list_sum(v)) AS n FROM e),
l AS (SELECT vec_id, label, n, lag(n) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM s)
SELECT vec_id, label, ROUND(CASE WHEN b IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(list_zip(n, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END, 6) AS flux FROM l""")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each normalised spectrum to the one before it in its group; the first is 0."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))
    n = e.select("vec_id", "label", F.transform("v", lambda x: x / F.aggregate("v", F.lit(0.0), lambda a, b: a + b)).alias("n"))
    b = F.lag("n").over(Window.partitionBy("label").orderBy("vec_id"))
    d = F.aggregate(F.zip_with("n", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return n.withColumn("b", b).select("vec_id", "label", F.round(F.when(F.col("b").isNull(), 0.0).otherwise(F.sqrt(d)), 6).alias("flux"))


@query("""SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"b":"' || o_orderstatus || '","c":' || (o_orderkey % 10) || '}') AS signature FROM orders""")
def canonical_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a record's JSON with its fields in alphabetical order."""
    s = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"), (F.col("o_orderkey") % 10).alias("c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.to_json(s), 256).alias("signature"))


@query(f"""WITH {OBS_SQL}, q AS (SELECT session_id, quantile_cont(metric, 0.6) AS a, quantile_cont(metric, 0.9) AS b FROM obs WHERE metric IS NOT NULL GROUP BY 1)
SELECT session_id, COUNT(*) AS frames, COUNT(*) FILTER (metric >= a) AS dense, COUNT(*) FILTER (metric >= b AND quality < 0.5) AS disturbed, ROUND(AVG(CAST(metric >= b AS INT)), 6) AS occupancy
 FROM obs JOIN q USING (session_id) WHERE metric IS NOT NULL GROUP BY 1""")
def window_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks from the quantiles of each window's own rows."""
    o = obs(spark, sf_dir).filter("metric is not null").select("session_id", "metric", F.col("metric").alias("top"), "quality")
    x = audio.above_group_quantile(o, ["session_id"], {"metric": 0.6, "top": 0.9})
    return x.groupBy("session_id").agg(F.count("*").alias("frames"), F.count(F.when(F.col("metric_high"), 1)).alias("dense"),
                                       F.count(F.when(F.col("top_high") & (F.col("quality") < 0.5), 1)).alias("disturbed"), F.round(F.avg(F.col("top_high").cast("int")), 6).alias("occupancy"))


@query()
def weekly_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly means of the daily series with bootstrap intervals."""
    d = balance.by_session(obs(spark, sf_dir)).select("session_id", F.date_trunc("week", "date").cast("date").alias("week"), "date", "daily_mean")
    b = models.bootstrap_mean(d, ["session_id", "week"], "daily_mean", replicates=2000)
    return b.filter("n >= 2").select("session_id", "week", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])
