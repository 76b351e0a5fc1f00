"""Event studies, trends, boundaries, geometry, agreement, and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import num, text, time
from ..operators import balance, events, stats, zones
from ..operators.environment import merged_status, normalise
from .adapters import GEOM_SQL, OBS_SQL, geom, obs, table
from .registry import query
from .series import HOURLY_B

#: Events are errors of high value; they last ten minutes around their time.
EVENT_SQL = "ev AS (SELECT user_id, window_id AS event_id, start_dt, secs FROM obs WHERE caretaker AND metric > 60)"


def anchors(o: DataFrame) -> DataFrame:
    return o.filter(F.col("caretaker") & (F.col("metric") > 60)).select("user_id", F.col("window_id").alias("event_id"), "start_dt", F.col("secs").alias("anchor"))


def _overlap(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    o = obs(spark, sf_dir)
    rows = o.select("user_id", F.col("window_id").alias("row_id"), F.col("secs").alias("lo"), (F.col("secs") + 3600).alias("hi"))
    ev = anchors(o).select("user_id", "event_id", (F.col("anchor") - 7200).alias("e_lo"), (F.col("anchor") + 7200).alias("e_hi"))
    return events.overlap_join(rows, ev, "user_id", how).select("user_id", "row_id")


OVERLAP_SQL = f"""WITH {OBS_SQL}, {EVENT_SQL} SELECT user_id, window_id AS row_id FROM obs o WHERE @NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = o.user_id
 AND o.secs < e.secs + 7200 AND o.secs + 3600 > e.secs - 7200 AND e.event_id <> o.window_id)"""


@query(OVERLAP_SQL.replace("@NOT", "NOT"))
def overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, "left_anti")


@query(OVERLAP_SQL.replace("@NOT", ""))
def overlap_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, "left_semi")


PHASES = (("before", -86400, 0), ("during", 0, 43200), ("after", 43200, 129600))
#: A row every two hours would fill a phase; a quarter of that must be there: 3, 2 and 3 rows.
EVERY = 7200.0
PHASE_SQL = """ph(phase, a, b, need) AS (VALUES ('before', -86400, 0, 3), ('during', 0, 43200, 2), ('after', 43200, 129600, 3)),
pr AS (SELECT event_id, phase, need, CASE WHEN metric IS NOT NULL AND quality > 0 THEN quality END AS w, metric FROM ev e, ph, obs o WHERE o.user_id = e.user_id AND o.secs >= e.secs + a AND o.secs < e.secs + b),
pm AS (SELECT event_id, phase, CASE WHEN COUNT(w) >= need AND SUM(w) >= 1.0 THEN SUM(metric * w) / SUM(w) END AS mean, COUNT(w) AS n FROM pr GROUP BY event_id, phase, need)"""


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    rows = o.select("user_id", "secs", "window_id", F.col("metric").alias("value"), F.col("quality").alias("weight"))
    return events.phase_means(rows, anchors(o), "user_id", PHASES, EVERY, order=["window_id"])


@query(f"WITH {OBS_SQL}, {EVENT_SQL}, {PHASE_SQL} SELECT event_id, phase, ROUND(mean, 6) AS mean, n FROM pm")
def phase_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(spark, sf_dir).withColumn("mean", num.rounded(F.col("mean")))


@query(f"""WITH {OBS_SQL}, {EVENT_SQL}, {PHASE_SQL}, w AS (SELECT event_id, MAX(mean) FILTER (phase = 'before') AS b, MAX(mean) FILTER (phase = 'during') AS d,
 MAX(mean) FILTER (phase = 'after') AS a FROM pm GROUP BY event_id) SELECT event_id, ROUND(d - b, 6) AS immediate, ROUND(a - b, 6) AS recovery FROM w""")
def difference_in_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.differences(means(spark, sf_dir)).select("event_id", num.rounded(F.col("immediate")).alias("immediate"), num.rounded(F.col("recovery")).alias("recovery"))


@query(f"""WITH {OBS_SQL}, {EVENT_SQL}, b AS (SELECT unnest(range(-10, 10)) AS bin)
SELECT bin, COUNT(metric) AS n, ROUND(AVG(metric), 6) AS mean FROM ev e, b, obs o WHERE o.user_id = e.user_id AND o.secs >= e.secs + bin * 7200 AND o.secs < e.secs + (bin + 1) * 7200 GROUP BY bin""")
def event_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    rows = o.select("user_id", "secs", F.col("metric").alias("value"))
    p = events.phase_rows(rows, anchors(o), "user_id", [(str(k), k * 7200, (k + 1) * 7200) for k in range(-10, 10)], 86400)
    return p.groupBy(F.col("phase").cast("long").alias("bin")).agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {OBS_SQL}, {EVENT_SQL}, s(setting, gap) AS (VALUES ('none', 0), ('hour', 3600), ('day', 86400)),
k AS (SELECT setting, e.user_id, e.event_id FROM ev e, s WHERE NOT EXISTS (SELECT 1 FROM ev f WHERE f.user_id = e.user_id AND f.event_id <> e.event_id
  AND f.secs > e.secs - gap AND f.secs < e.secs + gap)), {PHASE_SQL},
d AS (SELECT event_id, MAX(mean) FILTER (phase = 'during') - MAX(mean) FILTER (phase = 'before') AS im FROM pm GROUP BY event_id)
SELECT setting, COUNT(*) AS events, COUNT(im) AS usable, ROUND(AVG(im), 6) AS mean_immediate, CAST(sign(AVG(im)) AS INT) AS direction FROM k LEFT JOIN d USING (event_id) GROUP BY setting""")
def isolation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    a = anchors(o)
    w = Window.partitionBy("user_id").orderBy("anchor", "event_id")
    near = F.least(F.coalesce(F.col("anchor") - F.lag("anchor").over(w), F.lit(1e18)), F.coalesce(F.lead("anchor").over(w) - F.col("anchor"), F.lit(1e18)))
    gaps = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(g).alias("gap")) for n, g in (("none", 0), ("hour", 3600), ("day", 86400))])).alias("s")
    kept = a.withColumn("near", near).select("event_id", "near", gaps).filter((F.col("s.gap") == 0) | (F.col("near") >= F.col("s.gap")))
    d = events.differences(means(spark, sf_dir)).select("event_id", "immediate")
    x = kept.select("event_id", "s.setting").join(d, "event_id", "left")
    return x.groupBy("setting").agg(F.count("*").alias("events"), F.count("immediate").alias("usable"), num.rounded(F.avg("immediate")).alias("mean_immediate"),
                                    F.signum(F.avg("immediate")).cast("int").alias("direction"))


RANK_SQL = """r AS (SELECT session_id, rank() OVER (PARTITION BY session_id ORDER BY date) + (COUNT(*) OVER (PARTITION BY session_id, date) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY session_id ORDER BY daily_mean) + (COUNT(*) OVER (PARTITION BY session_id, daily_mean) - 1) / 2.0 AS ry FROM daily)"""


@query(f"WITH {OBS_SQL}, {HOURLY_B}, {RANK_SQL} SELECT session_id, ROUND(corr(rx, ry), 6) AS rho, COUNT(*) AS n FROM r GROUP BY session_id")
def spearman_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.spearman(balance.by_session(obs(spark, sf_dir)), ["session_id"], "date", "daily_mean")
    return s.withColumn("rho", F.round("rho", 6))


@query(f"""WITH {OBS_SQL}, {HOURLY_B}, e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY date) AS i, COUNT(*) OVER (PARTITION BY session_id) AS n FROM daily),
k AS (SELECT *, least(14, greatest(3, CAST(floor(n / 5) AS BIGINT))) AS edge FROM e)
SELECT session_id, ROUND(AVG(daily_mean) FILTER (i <= edge), 6) AS first_mean, ROUND(AVG(daily_mean) FILTER (i > n - edge), 6) AS last_mean, ANY_VALUE(edge) AS edge FROM k GROUP BY session_id""")
def trend_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Window.partitionBy("session_id")
    d = balance.by_session(obs(spark, sf_dir)).withColumn("i", F.row_number().over(part.orderBy("date"))).withColumn("n", F.count("*").over(part))
    d = d.withColumn("edge", F.least(F.lit(14), F.greatest(F.lit(3), F.floor(F.col("n") / 5))).cast("long"))
    return d.groupBy("session_id").agg(F.round(F.avg(F.when(F.col("i") <= F.col("edge"), F.col("daily_mean"))), 6).alias("first_mean"),
                                       F.round(F.avg(F.when(F.col("i") > F.col("n") - F.col("edge"), F.col("daily_mean"))), 6).alias("last_mean"), F.first("edge").alias("edge"))


@query(f"""WITH {OBS_SQL}, u AS (SELECT user_id, CASE WHEN AVG(metric) IS NULL THEN NULL ELSE 1 / (1 + abs(AVG(metric) - 50)) END AS p FROM obs GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL ORDER BY p, user_id) AS rn, COUNT(*) OVER (PARTITION BY p IS NULL) AS m FROM u)
SELECT user_id, ROUND(p, 6) AS p, ROUND(CASE WHEN p IS NOT NULL THEN least(MIN(p * m / rn) OVER (PARTITION BY p IS NULL ORDER BY rn DESC ROWS UNBOUNDED PRECEDING), 1) END, 6) AS q FROM r""")
def step_up_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = obs(spark, sf_dir).groupBy("user_id").agg(F.avg("metric").alias("a")).select("user_id", (1 / (1 + F.abs(F.col("a") - 50))).alias("p"))
    return stats.step_up(u, [], "p", ["user_id"]).select("user_id", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


JUMP_SQL = """z AS (SELECT session_id, date, daily_mean, median(daily_mean) OVER () AS c FROM daily),
t AS (SELECT quantile_cont(daily_mean, 0.75) - quantile_cont(daily_mean, 0.25) AS iqr, stddev_samp(daily_mean) AS sd FROM daily),
y AS (SELECT session_id, date, (daily_mean - c) / greatest(CASE WHEN iqr > 0 THEN iqr / 1.349 ELSE sd END, 1e-9) AS z FROM z, t)"""


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance.by_session(obs(spark, sf_dir))
    q = d.agg(F.percentile("daily_mean", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_samp("daily_mean").alias("sd"))
    iqr = F.col("q")[2] - F.col("q")[0]
    x = d.crossJoin(F.broadcast(q))  # one row of quantiles
    return x.select("session_id", "date", ((F.col("daily_mean") - F.col("q")[1]) / F.greatest(F.when(iqr > 0, iqr / 1.349).otherwise(F.col("sd")), F.lit(1e-9))).alias("z"))


@query(f"""WITH {OBS_SQL}, {HOURLY_B}, {JUMP_SQL}, j AS (SELECT session_id, abs(z - lag(z) OVER (PARTITION BY session_id ORDER BY date)) AS step FROM y)
SELECT session_id, COUNT(step) AS steps, ROUND(median(step), 6) AS median_step, ROUND(quantile_cont(step, 0.9), 6) AS p90_step FROM j GROUP BY session_id""")
def adjacent_day_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("date")
    j = standardised(spark, sf_dir).select("session_id", F.abs(F.col("z") - F.lag("z").over(w)).alias("step"))
    return j.groupBy("session_id").agg(F.count("step").alias("steps"), F.round(F.percentile("step", 0.5), 6).alias("median_step"), F.round(F.percentile("step", 0.9), 6).alias("p90_step"))


@query(f"""WITH {OBS_SQL}, {HOURLY_B}, {JUMP_SQL}, e AS (SELECT session_id, min_by(z, date) AS first_z, max_by(z, date) AS last_z FROM y GROUP BY session_id),
b AS (SELECT session_id, first_z - lag(last_z) OVER (ORDER BY session_id) AS jump FROM e) SELECT session_id, ROUND(jump, 6) AS jump, ROUND(abs(jump), 6) AS size FROM b WHERE jump IS NOT NULL""")
def boundary_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = standardised(spark, sf_dir).groupBy("session_id").agg(F.min_by("z", "date").alias("first_z"), F.max_by("z", "date").alias("last_z"))
    b = e.select("session_id", (F.col("first_z") - F.lag("last_z").over(Window.orderBy("session_id"))).alias("jump")).filter("jump is not null")
    return b.select("session_id", F.round("jump", 6).alias("jump"), F.round(F.abs("jump"), 6).alias("size"))


PROFILE_SQL = """pr AS (SELECT user_id, zone, (COUNT(*) + 0.005) AS occ FROM obs WHERE zone <> 'outside' GROUP BY ALL),
prof AS (SELECT user_id AS profile_id, zone, occ / SUM(occ) OVER (PARTITION BY user_id) AS share FROM pr),
full_prof AS (SELECT * FROM prof WHERE profile_id IN (SELECT profile_id FROM prof GROUP BY profile_id HAVING COUNT(*) = 4)),
rep AS (SELECT p.profile_id, g.geometry_id, p.zone, p.share * g.area / SUM(p.share * g.area) OVER (PARTITION BY p.profile_id, g.geometry_id) AS f, g.area FROM full_prof p JOIN geom g USING (zone))"""


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy densities of all profiles replayed on every geometry (at most 50); rows grow with the profiles."""
    o = obs(spark, sf_dir).filter("zone <> 'outside'").groupBy(F.col("user_id").alias("profile_id"), "zone").agg((F.count("*") + 0.005).alias("occ"))
    part = Window.partitionBy("profile_id")
    p = o.withColumn("n", F.count("*").over(part)).filter("n = 4").select("profile_id", "zone", (F.col("occ") / F.sum("occ").over(part)).alias("share"))
    x = p.join(F.broadcast(geom(spark, sf_dir)), "zone")
    total = F.sum(F.col("share") * F.col("area")).over(Window.partitionBy("profile_id", "geometry_id"))
    return x.select("profile_id", "geometry_id", "zone", (F.col("share") * F.col("area") / total).alias("f"), "area")


@query(f"""WITH {OBS_SQL}, {GEOM_SQL}, {PROFILE_SQL}, val AS (SELECT eps, zone, profile_id, geometry_id, ln(f + eps) - ln(area + eps) AS v FROM rep, (VALUES (0.001), (0.0025), (0.005), (0.01), (0.02)) e(eps)),
m AS (SELECT eps, zone, v, AVG(v) OVER (PARTITION BY eps, zone) AS gm, AVG(v) OVER (PARTITION BY eps, zone, geometry_id) AS mg FROM val)
SELECT CAST(eps AS DOUBLE) AS eps, zone, ROUND(AVG(v), 6) AS mean_selectivity, ROUND(SUM((mg - gm) ** 2) / greatest(SUM((v - gm) ** 2), 1e-12), 5) AS eta_geometry FROM m GROUP BY eps, zone""")
def pseudocount_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = F.explode(F.array(*[F.lit(e) for e in (0.001, 0.0025, 0.005, 0.01, 0.02)])).alias("eps")
    x = replay(spark, sf_dir).select("*", eps).withColumn("v", F.log(F.col("f") + F.col("eps")) - F.log(F.col("area") + F.col("eps")))
    mean = lambda n, *k: F.broadcast(x.groupBy("eps", "zone", *k).agg(F.avg("v").alias(n)))  # noqa: E731  at most 50 geometries, 4 zones
    m = x.join(mean("gm"), ["eps", "zone"]).join(mean("mg", "geometry_id"), ["eps", "zone", "geometry_id"])
    ss = lambda c: F.sum(F.pow(c, F.lit(2.0)))
    return m.groupBy("eps", "zone").agg(F.round(F.avg("v"), 6).alias("mean_selectivity"), F.round(ss(F.col("mg") - F.col("gm")) / F.greatest(ss(F.col("v") - F.col("gm")), F.lit(1e-12)), 5).alias("eta_geometry"))


@query(f"""WITH {OBS_SQL}, {GEOM_SQL}, {PROFILE_SQL}, d AS (SELECT profile_id, geometry_id, zone, (f + 0.005) / (area + 0.005) AS r FROM rep),
n AS (SELECT *, r / exp(AVG(ln(r)) OVER (PARTITION BY profile_id, geometry_id)) AS density FROM d)
SELECT zone, ROUND(AVG(density), 6) AS density_mean, ROUND(stddev_samp(density), 6) AS density_sd, COUNT(*) AS n FROM n GROUP BY zone""")
def scale_equivariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = replay(spark, sf_dir).withColumn("r", (F.col("f") + 0.005) / (F.col("area") + 0.005))
    n = x.withColumn("density", F.col("r") / F.exp(F.avg(F.log("r")).over(Window.partitionBy("profile_id", "geometry_id"))))
    return n.groupBy("zone").agg(F.round(F.avg("density"), 6).alias("density_mean"), F.round(F.stddev_samp("density"), 6).alias("density_sd"), F.count("*").alias("n"))


BOXES = (("drinking", (0.0, 0.0, 15.0, 0.05)), ("feeding", (15.0, 0.0, 35.0, 0.06)), ("resting", (0.0, 0.05, 25.0, 0.2)), ("open_movement", (25.0, 0.05, 60.0, 0.2)))
BOX_SQL = "CASE WHEN %s >= 0 AND %s < 15 AND %s >= 0 AND %s < 0.05 THEN 'drinking' WHEN %s >= 15 AND %s < 35 AND %s >= 0 AND %s < 0.06 THEN 'feeding' WHEN %s >= 0 AND %s < 25 AND %s >= 0.05 AND %s < 0.2 THEN 'resting' WHEN %s >= 25 AND %s < 60 AND %s >= 0.05 AND %s < 0.2 THEN 'open_movement' ELSE 'outside' END"


def _box_sql(x: str, y: str) -> str:
    return BOX_SQL % ((x, x, y, y) * 4)


def _zone(x, y):
    z = F.lit("outside")
    for name, box in reversed(BOXES):
        z = F.when(zones.in_box(x, y, box), name).otherwise(z)
    return z


@query(f"SELECT {_box_sql('l_quantity', 'l_discount')} AS zone, COUNT(*) AS points, ROUND(AVG(l_tax), 6) AS mean_tax FROM lineitem GROUP BY 1")
def point_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(_zone(F.col("l_quantity"), F.col("l_discount")).alias("zone"), "l_tax")
    return p.groupBy("zone").agg(F.count("*").alias("points"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query(f"""WITH p AS (SELECT l_returnflag, {_box_sql('l_quantity', 'l_discount')} AS a, {_box_sql('l_quantity + d', 'l_discount')} AS b, d FROM lineitem, (VALUES (-10), (-5), (5), (10)) v(d))
SELECT l_returnflag, CAST(d AS INT) AS shift, ROUND(AVG(CAST(a = b AS INT)), 6) AS agreement, COUNT(*) AS n FROM p GROUP BY ALL""")
def assignment_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.explode(F.array(*map(F.lit, (-10, -5, 5, 10)))).alias("shift")
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", d)
    same = _zone(F.col("l_quantity"), F.col("l_discount")) == _zone(F.col("l_quantity") + F.col("shift"), F.col("l_discount"))
    return p.groupBy("l_returnflag", "shift").agg(F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.count("*").alias("n"))


TRIANGLE = [(5.0, 0.01), (45.0, 0.03), (20.0, 0.09)]


@query("""WITH p AS (SELECT l_returnflag, l_quantity AS x, l_discount AS y FROM lineitem), e AS (SELECT *, CAST((1e-2 > y) <> (3e-2 > y) AND x < (45.0 - 5.0) * (y - 1e-2) / (3e-2 - 1e-2) + 5.0 AS INT)
 + CAST((3e-2 > y) <> (9e-2 > y) AND x < (20.0 - 45.0) * (y - 3e-2) / (9e-2 - 3e-2) + 45.0 AS INT) + CAST((9e-2 > y) <> (1e-2 > y) AND x < (5.0 - 20.0) * (y - 9e-2) / (1e-2 - 9e-2) + 20.0 AS INT) AS k FROM p)
SELECT l_returnflag, COUNT(*) FILTER (k % 2 = 1) AS inside, COUNT(*) AS n FROM e GROUP BY 1""")
def polygon_even_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = zones.even_odd(F.col("l_quantity"), F.col("l_discount"), TRIANGLE)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.when(inside, 1)).alias("inside"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT quality, toxic FROM labels), k AS (SELECT DISTINCT quality AS label FROM c UNION SELECT DISTINCT toxic FROM c)
SELECT label, COUNT(*) FILTER (quality = label) AS support, COUNT(*) FILTER (toxic = label) AS predicted, COUNT(*) FILTER (quality = label AND toxic = label) AS hits,
 ROUND(COUNT(*) FILTER (quality = label AND toxic = label) / nullif(COUNT(*) FILTER (toxic = label), 0), 6) AS label_precision,
 ROUND(COUNT(*) FILTER (quality = label AND toxic = label) / nullif(COUNT(*) FILTER (quality = label), 0), 6) AS recall,
 ROUND(2 * COUNT(*) FILTER (quality = label AND toxic = label) / nullif(COUNT(*) FILTER (quality = label) + COUNT(*) FILTER (toxic = label), 0), 6) AS f1 FROM k, c GROUP BY label""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    side = F.explode(F.array(F.struct(F.col("quality").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("quality") == F.col("toxic"), F.col("n")).otherwise(0).alias("h")),
                             F.struct(F.col("toxic").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")
    t = cells.select(side).groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.h").alias("hits"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    return t.select("label", "support", "predicted", "hits", r(F.col("hits"), F.col("predicted")).alias("label_precision"), r(F.col("hits"), F.col("support")).alias("recall"),
                    r(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


@query("""WITH e AS (SELECT l_returnflag, l_quantity AS v, 10 + l_linenumber AS lo, 20 + l_linenumber * 2 AS hi FROM lineitem), d AS (SELECT *, v - (lo + hi) / 2.0 AS err, greatest(lo - v, v - hi, 0) AS ie FROM e)
SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(err), 6) AS bias, ROUND(AVG(abs(err)), 6) AS mae, ROUND(sqrt(AVG(err * err)), 6) AS rmse, ROUND(AVG(err) - 1.96 * stddev_samp(err), 6) AS lower_limit,
 ROUND(AVG(err) + 1.96 * stddev_samp(err), 6) AS upper_limit, ROUND(median(ie), 6) AS median_interval_error, ROUND(AVG(CAST(ie = 0 AS INT)), 6) AS within_range FROM d GROUP BY 1""")
def count_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("v"), (10.0 + F.col("l_linenumber")).alias("lo"), (20.0 + F.col("l_linenumber") * 2).alias("hi"))
    d = x.select("l_returnflag", (F.col("v") - (F.col("lo") + F.col("hi")) / 2).alias("e"), num.interval_error(F.col("v"), F.col("lo"), F.col("hi")).alias("ie"))
    r = lambda c: F.round(c, 6)
    return d.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), r(F.avg("e")).alias("bias"), r(F.avg(F.abs("e"))).alias("mae"), r(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"),
        r(F.avg("e") - 1.96 * F.stddev_samp("e")).alias("lower_limit"), r(F.avg("e") + 1.96 * F.stddev_samp("e")).alias("upper_limit"),
        r(F.percentile("ie", 0.5)).alias("median_interval_error"), r(F.avg((F.col("ie") == 0).cast("int"))).alias("within_range"))


@query("""WITH c AS (SELECT quality, toxic, COUNT(*) AS n FROM labels GROUP BY ALL), x AS (SELECT SUM(n) AS n FROM c GROUP BY quality), y AS (SELECT SUM(n) AS n FROM c GROUP BY toxic),
s AS (SELECT (SELECT SUM(n * (n - 1) / 2.0) FROM c) AS c, (SELECT SUM(n * (n - 1) / 2.0) FROM x) AS x, (SELECT SUM(n * (n - 1) / 2.0) FROM y) AS y, (SELECT SUM(n) FROM c) AS t)
SELECT CAST(t AS BIGINT) AS n, ROUND(coalesce((c - x * y / nullif(t * (t - 1) / 2.0, 0)) / nullif((x + y) / 2 - x * y / nullif(t * (t - 1) / 2.0, 0), 0), 1.0), 6) AS ari FROM s""")
def contingency_rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rand_index(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("ari", F.round("ari", 6))


@query("""SELECT page_id, CASE WHEN regexp_extract(replace(url, '-', ' '), '(?i)(^|[^a-z0-9])room[\\s_]*([0-9]+)', 2) = '' THEN 'unknown_room' ELSE 'room_' || CAST(regexp_extract(replace(url, '-', ' '), '(?i)(^|[^a-z0-9])room[\\s_]*([0-9]+)', 2) AS BIGINT) END AS room_id,
 CASE WHEN trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_') END AS slug,
 regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS compare_key FROM pages""")
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.room_id(u).alias("room_id"), text.slugify(u).alias("slug"), text.compare_key(u).alias("compare_key"))


@query("""SELECT doc_id, coalesce(array_to_string(list_distinct_ordered, ';'), '') AS warnings FROM (SELECT doc_id, list_filter(list_transform(list_zip(l, range(len(l))), lambda z: CASE WHEN list_position(l, z[1]) = z[2] + 1 THEN z[1] END),
 lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT doc_id, list_filter(list_transform(string_split(lang || ';nan; ' || source || ';' || lang || '; ;' || source, ';'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan') AS l FROM documents))""")
def warning_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a, b = F.concat("lang", F.lit(";nan; "), "source"), F.concat("lang", F.lit("; ;"), "source")
    return d.select("doc_id", text.merge_warnings(a, b).alias("warnings"))


@query("""SELECT o_orderkey, ROUND(TRY_CAST(split_part(f, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(f, '/', 2) AS DOUBLE), 0), 6) AS fps,
 least(o_orderkey % 7, o_orderkey % 5) * 1.0 AS low, greatest(o_orderkey % 7, o_orderkey % 5) * 1.0 AS high FROM (SELECT o_orderkey, (o_orderkey * 1000) || '/' || (o_orderkey % 1001) AS f FROM orders)""")
def fraction_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((k * 1000).cast("string"), F.lit("/"), (k % 1001).cast("string")).alias("f"), F.concat((k % 7).cast("string"), F.lit("~"), (k % 5).cast("string")).alias("r"))
    low, high = text.value_range(F.col("r"))
    return o.select("o_orderkey", F.round(text.fraction(F.col("f")), 6).alias("fps"), low.alias("low"), high.alias("high"))


ENV_SQL = """env AS (SELECT o_custkey % 3 AS room_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN COUNT(*) % 7 <> 0 THEN MIN(o_totalprice) / 19999 END AS am_min,
 CASE WHEN COUNT(*) % 3 <> 0 AND COUNT(*) % 7 <> 0 THEN MAX(o_totalprice) / 19999 END AS am_max, CASE WHEN COUNT(*) % 4 <> 0 AND COUNT(*) % 7 <> 0 THEN AVG(o_totalprice) / 19999 END AS pm,
 CASE WHEN COUNT(*) % 5 <> 0 AND COUNT(*) % 14 <> 0 THEN 50.0 END AS rh_am, CASE WHEN COUNT(*) % 6 <> 0 AND COUNT(*) % 10 <> 0 AND COUNT(*) % 14 <> 0 THEN 60.0 END AS rh_pm FROM orders GROUP BY ALL),
m AS (SELECT *, coalesce((am_min + am_max) / 2, am_min, am_max) AS am_mean, coalesce((rh_am + rh_pm) / 2, rh_am, rh_pm) AS rh_daily FROM env),
n AS (SELECT *, coalesce((am_mean + pm) / 2, am_mean, pm) AS daily, CASE WHEN date IS NULL THEN 'date_parse_failed' WHEN coalesce(am_mean, pm) IS NULL AND rh_daily IS NULL THEN 'missing_temp_and_rh'
 WHEN coalesce(am_mean, pm) IS NULL OR rh_daily IS NULL THEN 'partial' ELSE 'ok' END AS flag FROM m)"""


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n, price = F.count("*"), lambda f: f("o_totalprice") / 19999
    some = lambda *ks: reduce(lambda x, y: x & y, [n % k != 0 for k in ks])
    e = o.groupBy((F.col("o_custkey") % 3).alias("room_id"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.when(some(7), price(F.min)).alias("am_min"), F.when(some(3, 7), price(F.max)).alias("am_max"), F.when(some(4, 7), price(F.avg)).alias("pm"),
        F.when(some(5, 14), F.lit(50.0)).alias("rh_am"), F.when(some(6, 10, 14), F.lit(60.0)).alias("rh_pm"))
    return normalise(e)


@query(f"WITH {ENV_SQL} SELECT room_id, date, ROUND(am_mean, 6) AS am_mean, ROUND(daily, 6) AS daily, ROUND(rh_daily, 6) AS rh_daily, ROUND(am_max - am_min, 6) AS temp_range, flag FROM n")
def environment_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return environment(spark, sf_dir).select("room_id", "date", *map(r, ("am_mean", "daily", "rh_daily", "temp_range")), "flag")


@query(f"""WITH {OBS_SQL}, {ENV_SQL}, x AS (SELECT o.*, n.*, CASE user_id % 11 WHEN 0 THEN 'Failed' WHEN 1 THEN ' warning' WHEN 2 THEN NULL ELSE 'ok' END AS video,
 CASE user_id % 13 WHEN 0 THEN 'decode_failed' WHEN 1 THEN 'manifest_has_audio_false' WHEN 2 THEN '' ELSE 'OK' END AS sound, CASE user_id % 17 WHEN 0 THEN 'warning' WHEN 1 THEN 'failed' END AS upstream
 FROM obs o LEFT JOIN n ON n.room_id = o.session_id AND n.date = CAST(o.start_dt AS DATE) + CAST(date '1995-01-01' - date '2024-01-01' AS INT))
SELECT window_id, ROUND(coalesce(CASE WHEN hour(start_dt) < 12 THEN am_mean ELSE pm END, daily), 6) AS temp, coalesce(flag, '') AS env_flag,
 CASE WHEN metric IS NULL OR lower(trim(video)) = 'failed' THEN 'failed' WHEN lower(coalesce(sound, '')) NOT IN ('', 'ok', 'manifest_has_audio_false') OR coalesce(flag, '') NOT IN ('', 'ok') THEN 'warning'
  WHEN upstream IN ('warning', 'failed') THEN upstream WHEN lower(trim(video)) = 'warning' THEN 'warning' ELSE 'ok' END AS status FROM x""")
def environment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumn("date", F.date_add(F.col("start_dt").cast("date"), F.datediff(F.lit("1995-01-01"), F.lit("2024-01-01"))))
    x = o.join(environment(spark, sf_dir).withColumnRenamed("room_id", "session_id"), ["session_id", "date"], "left")
    k = F.col("user_id")
    video = F.when(k % 11 == 0, "Failed").when(k % 11 == 1, " warning").when(k % 11 != 2, "ok")
    sound = F.when(k % 13 == 0, "decode_failed").when(k % 13 == 1, "manifest_has_audio_false").when(k % 13 == 2, "").otherwise("OK")
    upstream = F.when(k % 17 == 0, "warning").when(k % 17 == 1, "failed")
    temp = F.coalesce(F.when(F.hour("start_dt") < 12, F.col("am_mean")).otherwise(F.col("pm")), F.col("daily"))
    return x.select("window_id", F.round(temp, 6).alias("temp"), F.coalesce("flag", F.lit("")).alias("env_flag"), merged_status(F.col("metric"), video, sound, F.col("flag"), upstream).alias("status"))


@query("""SELECT 'video' AS stage, o_orderkey AS window_id, 'no_items' AS issue FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION SELECT 'audio', o_orderkey, 'cheap' FROM orders WHERE o_totalprice < 2000 UNION SELECT 'audio', l_orderkey, 'cheap' FROM lineitem WHERE l_extendedprice < 1000""")
def union_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    row = lambda stage, key, issue: [F.lit(stage).alias("stage"), F.col(key).alias("window_id"), F.lit(issue).alias("issue")]
    none = o.join(i, o["o_orderkey"] == i["l_orderkey"], "left_anti").select(*row("video", "o_orderkey", "no_items"))
    parts = [none, o.filter("o_totalprice < 2000").select(*row("audio", "o_orderkey", "cheap")), i.filter("l_extendedprice < 1000").select(*row("audio", "l_orderkey", "cheap"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["stage", "window_id", "issue"])


@query("""SELECT c_custkey AS id, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT id, 'both' FROM (SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return c.exceptAll(o.distinct()).withColumn("side", F.lit("missing")).unionByName(c.intersect(o).withColumn("side", F.lit("both")))
