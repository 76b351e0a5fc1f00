"""What geometry does to zone values: profiles replayed on all geometries, and steps between sessions against steps of their areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import num
from ..operators import counterfactual, stats
from ..operators.zones import ZONES
from .adapters import GEOM_SQL, OBS_SQL, geom, obs
from .registry import query
from .studies import PROFILE_SQL

EPS, SWEEP = 0.005, (0.0001, 0.001, 0.005, 0.01, 0.02)

CELL_SQL = """e(eps) AS (VALUES @EPS), cf AS (SELECT eps, p.profile_id, p.zone, (p.share + eps) / (s.area + eps) AS r FROM full_prof p JOIN geom s ON s.geometry_id = p.profile_id % 50 AND s.zone = p.zone, e),
ce AS (SELECT c.eps, c.profile_id, g.geometry_id, c.zone, g.area, c.r * g.area / SUM(c.r * g.area) OVER (PARTITION BY c.eps, c.profile_id, g.geometry_id) AS v FROM cf c JOIN geom g USING (zone)),
kv AS (SELECT 'raw' AS kind, eps, profile_id, geometry_id, zone, v FROM ce UNION ALL SELECT 'normalized', eps, profile_id, geometry_id, zone, ln(v + eps) - ln(area + eps) FROM ce),
km AS (SELECT kind, eps, zone, v, AVG(v) OVER (PARTITION BY kind, eps, zone) AS gm, AVG(v) OVER (PARTITION BY kind, eps, zone, geometry_id) AS mg, AVG(v) OVER (PARTITION BY kind, eps, zone, profile_id) AS mp FROM kv),
et AS (SELECT kind, eps, zone, SUM((mg - gm) ** 2) / greatest(SUM((v - gm) ** 2), 1e-12) AS g, SUM((mp - gm) ** 2) / greatest(SUM((v - gm) ** 2), 1e-12) AS p, SUM((v - mg - mp + gm) ** 2) / greatest(SUM((v - gm) ** 2), 1e-12) AS i FROM km GROUP BY kind, eps, zone)"""


def wide_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geometry_id, a_<zone>) of at most 50 geometries."""
    return geom(spark, sf_dir).groupBy("geometry_id").agg(*[F.max(F.when(F.col("zone") == z, F.col("area"))).alias(f"a_{z}") for z in ZONES])


def wide_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, geometry_id, o_<zone>) of users seen in all four zones; a user's own geometry is that of its number."""
    o = obs(spark, sf_dir).filter("zone <> 'outside'").groupBy(F.col("user_id").alias("profile_id")).agg(*[F.count(F.when(F.col("zone") == z, 1)).alias(z) for z in ZONES])
    o = o.filter(reduce(lambda a, b: a & b, [F.col(z) > 0 for z in ZONES]))
    total = sum((F.col(z) + EPS for z in ZONES), F.lit(0.0))
    return o.select("profile_id", (F.col("profile_id") % 50).alias("geometry_id"), *[((F.col(z) + EPS) / total).alias(f"o_{z}") for z in ZONES])


def shares(spark: SparkSession, sf_dir: str, eps: tuple[float, ...]) -> DataFrame:
    g, p = wide_geometry(spark, sf_dir), wide_profiles(spark, sf_dir).withColumn("eps", F.explode(F.array(*map(F.lit, eps))))
    return counterfactual.shares_of_variance(counterfactual.replayed(counterfactual.densities(p, g, F.col("eps")), g, F.col("eps")), ["eps"])


@query(f"""WITH {OBS_SQL}, {GEOM_SQL}, {PROFILE_SQL}, {CELL_SQL.replace('@EPS', '(0.005)')} SELECT r.zone, ROUND(r.g, 6) AS raw_geometry, ROUND(r.p, 6) AS raw_profile, ROUND(r.i, 6) AS raw_interaction,
 ROUND(n.g, 6) AS normalized_geometry, ROUND(n.p, 6) AS normalized_profile, ROUND(n.i, 6) AS normalized_interaction, ROUND(1 - n.g / r.g, 6) AS reduction FROM et r JOIN et n USING (zone) WHERE r.kind = 'raw' AND n.kind = 'normalized'""")
def counterfactual_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of variance of expected zone shares and of their log selectivities, by geometry, profile and interaction."""
    x = shares(spark, sf_dir, (EPS,))
    r = lambda c: F.round(c, 6)
    return x.select("zone", *[r(c).alias(c) for c in x.columns if c.startswith(("raw_", "normalized_"))], r(1 - F.col("normalized_geometry") / F.col("raw_geometry")).alias("reduction"))


@query(f"""WITH {OBS_SQL}, {GEOM_SQL}, {PROFILE_SQL}, {CELL_SQL.replace('@EPS', ', '.join(f'({e})' for e in SWEEP))}, s AS (SELECT eps, AVG(g) FILTER (kind = 'raw') AS raw_mean, AVG(g) FILTER (kind = 'normalized') AS normalized_mean,
 median(g) FILTER (kind = 'raw') AS raw_median, median(g) FILTER (kind = 'normalized') AS normalized_median FROM et GROUP BY eps)
SELECT CAST(eps AS DOUBLE) AS eps, ROUND(raw_mean, 6) AS raw_mean, ROUND(normalized_mean, 6) AS normalized_mean, ROUND(1 - normalized_mean / raw_mean, 6) AS reduction, ROUND(raw_median, 6) AS raw_median, ROUND(normalized_median, 6) AS normalized_median FROM s""")
def counterfactual_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with five pseudocounts, over the four zones."""
    s = shares(spark, sf_dir, SWEEP).groupBy("eps").agg(*[f for k in counterfactual.KINDS for f in (F.avg(f"{k}_geometry").alias(f"{k}_mean"), F.percentile(f"{k}_geometry", 0.5).alias(f"{k}_median"))])
    s = s.withColumn("reduction", 1 - F.col("normalized_mean") / F.col("raw_mean"))
    return s.select("eps", *[F.round(c, 6).alias(c) for c in s.columns if c != "eps"])


@query()
def counterfactual_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much normalizing reduces the geometry share, with its bootstrap interval over the profiles."""
    g = wide_geometry(spark, sf_dir)
    x = counterfactual.reduction_interval(counterfactual.densities(wide_profiles(spark, sf_dir), g, F.lit(EPS)), g, EPS)
    return x.select(F.col("profiles").cast("long").alias("profiles"), *[F.round(c, 6).alias(c) for c in x.columns if c != "profiles"])


#: Sessions are here the 50 geometries, in the order of their first days; each has a first and a last day of zone fractions.
STEP_SQL = """dz AS (SELECT user_id % 50 AS g, CAST(start_dt AS DATE) AS date, zone, COUNT(*) AS n FROM obs WHERE zone <> 'outside' GROUP BY ALL),
dd AS (SELECT g, date, SUM(n) AS n FROM dz GROUP BY ALL), od AS (SELECT user_id % 50 AS g, MIN(start_dt) AS t, MIN(CAST(start_dt AS DATE)) AS first_date, MAX(CAST(start_dt AS DATE)) AS last_date FROM obs WHERE zone <> 'outside' GROUP BY 1),
zf AS (SELECT d.g, d.date, m.zone, m.area, coalesce(z.n, 0) / d.n AS f FROM dd d JOIN geom m ON m.geometry_id = d.g LEFT JOIN dz z ON z.g = d.g AND z.date = d.date AND z.zone = m.zone),
en AS (SELECT o.g, o.t, a.zone, a.area, a.f AS f0, b.f AS f1, ln(a.f + 0.005) - ln(a.area + 0.005) AS s0, ln(b.f + 0.005) - ln(b.area + 0.005) AS s1 FROM od o JOIN zf a ON a.g = o.g AND a.date = o.first_date JOIN zf b ON b.g = o.g AND b.date = o.last_date AND b.zone = a.zone),
st AS (SELECT zone, g, f0 - lag(f1) OVER w AS raw, s0 - lag(s1) OVER w AS normalized, area - lag(area) OVER w AS area FROM en WINDOW w AS (PARTITION BY zone ORDER BY t, g)), sv AS (SELECT * FROM st WHERE raw IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY zone ORDER BY area) + (COUNT(*) OVER (PARTITION BY zone, area) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY zone ORDER BY raw) + (COUNT(*) OVER (PARTITION BY zone, raw) - 1) / 2.0 AS rr,
 rank() OVER (PARTITION BY zone ORDER BY normalized) + (COUNT(*) OVER (PARTITION BY zone, normalized) - 1) / 2.0 AS rn FROM sv)"""


def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(boundary_id, zone, area, raw, normalized): from the last day of a session to the first of the next, steps of the zone's fraction and log selectivity, and of its area."""
    o = obs(spark, sf_dir).filter("zone <> 'outside'").select((F.col("user_id") % 50).alias("g"), F.col("start_dt").cast("date").alias("date"), "zone", "start_dt")
    day = o.groupBy("g", "date").agg(F.min("start_dt").alias("t"), *[(F.count(F.when(F.col("zone") == z, 1)) / F.count("*")).alias(z) for z in ZONES])
    zones = F.struct(*ZONES)
    ends = day.groupBy("g").agg(F.min("t").alias("t"), F.min_by(zones, "date").alias("first"), F.max_by(zones, "date").alias("last")).join(wide_geometry(spark, sf_dir).withColumnRenamed("geometry_id", "g"), "g")
    x = ends.select("g", "t", F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(f"a_{z}").alias("a"), F.col(f"first.{z}").alias("f0"), F.col(f"last.{z}").alias("f1")) for z in ZONES])).alias("s")).select("g", "t", "s.*")
    w = Window.partitionBy("zone").orderBy("t", "g")  # one row a session
    log = lambda f: F.log(F.col(f) + EPS) - F.log(F.col("a") + EPS)
    x = x.select("*", log("f0").alias("s0"), log("f1").alias("s1"))
    x = x.select(F.col("g").alias("boundary_id"), "zone", (F.col("a") - F.lag("a").over(w)).alias("area"), (F.col("f0") - F.lag("f1").over(w)).alias("raw"), (F.col("s0") - F.lag("s1").over(w)).alias("normalized"))
    return x.filter("raw is not null")


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By zone, Pearson and Spearman correlations of the steps with the area's; null below five steps or without two values."""
    x = session_steps(spark, sf_dir)
    r = x.select("*", *[stats.average_rank(c, ["zone"]).alias(f"r_{c}") for c in ("area", "raw", "normalized")])
    enough = lambda c: (F.count("*") >= 5) & (F.countDistinct("area") >= 2) & (F.countDistinct(c) >= 2)
    pair = lambda c, a, b, n: F.when(enough(c), num.safe_corr(F.col(a), F.col(b))).alias(f"{c}_{n}")
    return r.groupBy("zone").agg(F.count("*").alias("boundaries"), *[f for c in counterfactual.KINDS for f in (pair(c, "area", c, "pearson"), pair(c, "r_area", f"r_{c}", "spearman"))])


TESTED = ("raw_pearson", "raw_spearman", "normalized_pearson", "normalized_spearman")


@query(f"""WITH {OBS_SQL}, {GEOM_SQL}, {STEP_SQL} SELECT zone, COUNT(*) AS boundaries, CASE WHEN COUNT(*) >= 5 THEN ROUND(corr(area, raw), 6) END AS raw_pearson, CASE WHEN COUNT(*) >= 5 THEN ROUND(corr(ra, rr), 6) END AS raw_spearman,
 CASE WHEN COUNT(*) >= 5 THEN ROUND(corr(area, normalized), 6) END AS normalized_pearson, CASE WHEN COUNT(*) >= 5 THEN ROUND(corr(ra, rn), 6) END AS normalized_spearman FROM rk GROUP BY zone""")
def boundary_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(spark, sf_dir).select("zone", "boundaries", *[F.round(c, 6).alias(c) for c in TESTED])


@query()
def boundary_coupling_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlations of ``boundary_coupling`` with their p, adjusted over the zones."""
    x = correlations(spark, sf_dir)
    for c in TESTED:
        x = stats.step_up(x.withColumn(f"{c}_p", num.correlation_p(F.col(c), F.col("boundaries"))), [], f"{c}_p", ["zone"]).withColumnRenamed("q", f"{c}_q")
    return x.select("zone", "boundaries", *[F.round(k, 9).alias(k) for c in TESTED for k in (c, f"{c}_p", f"{c}_q")])


@query()
def boundary_coupling_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much normalizing lowers the mean correlation with the area, with its bootstrap interval over the complete boundaries."""
    cell = lambda n, z: F.max(F.when(F.col("zone") == z, F.col(n))).alias(f"{n}_{z}")
    wide = session_steps(spark, sf_dir).groupBy("boundary_id").agg(*[cell(n, z) for n in ("area", *counterfactual.KINDS) for z in ZONES])
    x = counterfactual.coupling_interval(wide)
    return x.select(F.col("boundaries").cast("long").alias("boundaries"), *[F.round(c, 6).alias(c) for c in x.columns if c != "boundaries"])
