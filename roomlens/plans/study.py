"""The event study: controls for events, paired responses by feature and phase, their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import candidate_slot
from ..operators import events, models, stats
from ..operators.shared import BROADCAST_BYTES, cut, small_or_plain
from .adapters import OBS_SQL, obs
from .registry import query

KEY = "session_id"
#: A minute of the phases and of the coverage is ten minutes here, as rows of a session are minutes apart; one every ten minutes would fill a phase, and a quarter must be there: 2, 1 and 2.
UNIT, EVERY, RADIUS = 600.0, 600.0, 1200.0
PHASES = (("baseline", -10 * UNIT, -2 * UNIT, "anchor"), ("immediate", 0.0, 2 * UNIT, "end"), ("recovery", 2 * UNIT, 10 * UNIT, "end"))
COVERAGE = (("before", -10 * UNIT, -2 * UNIT, "anchor", 4), ("during", 0.0, 2 * UNIT, "end", 1), ("after", 2 * UNIT, 10 * UNIT, "end", 4))

#: Operations are a caretaker's stays of 5, 10 or 15 minutes; those of high value and fair quality are the events.
PAIRS_SQL = """ops AS (SELECT session_id, window_id AS event_id, start_dt, secs, 300.0 * (1 + window_id % 3) AS length, metric, quality FROM obs WHERE caretaker),
ex AS (SELECT * FROM ops WHERE metric > 60 AND quality > 0.3),
ca AS (SELECT session_id, MIN(window_id) AS row_id, start_dt, MIN(secs) AS secs FROM obs WHERE minute(start_dt) % 5 = 0 AND second(start_dt) < 30 GROUP BY session_id, start_dt),
tm AS (SELECT e.session_id, e.event_id, e.secs AS e_secs, e.length, c.row_id, c.secs, abs(hour(e.start_dt) * 60 + minute(e.start_dt) + second(e.start_dt) / 60 - (hour(c.start_dt) * 60 + minute(c.start_dt) + second(c.start_dt) / 60)) AS far,
 abs(date_diff('day', CAST(e.start_dt AS DATE), CAST(c.start_dt AS DATE))) AS days FROM ex e JOIN ca c ON e.session_id = c.session_id AND abs(c.secs - e.secs) >= 1800),
pairs AS MATERIALIZED (SELECT session_id, event_id, e_secs, length, row_id, secs, days, least(far, 1440 - far) AS clock, least(far, 1440 - far) + CASE WHEN days = 0 THEN 60.0 ELSE 0.0 END + 0.1 * days AS score FROM tm p
 WHERE least(far, 1440 - far) <= 120 AND NOT EXISTS (SELECT 1 FROM ops o WHERE o.session_id = p.session_id AND o.secs < p.secs + p.length + 900 AND o.secs + o.length > p.secs - 600)
 AND (SELECT COUNT(*) FROM obs o WHERE o.session_id = p.session_id AND o.secs >= p.secs - 6000 AND o.secs < p.secs - 1200) >= 4
 AND (SELECT COUNT(*) FROM obs o WHERE o.session_id = p.session_id AND o.secs >= p.secs + p.length AND o.secs < p.secs + p.length + 1200) >= 1
 AND (SELECT COUNT(*) FROM obs o WHERE o.session_id = p.session_id AND o.secs >= p.secs + p.length + 1200 AND o.secs < p.secs + p.length + 6000) >= 4)"""

#: The sequential choice, one event of each session a step.
PICKS_SQL = """od AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY e_secs, event_id) AS k FROM (SELECT DISTINCT session_id, event_id, e_secs FROM pairs)),
g AS (SELECT session_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS used, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS row_id FROM (SELECT DISTINCT session_id FROM pairs)
 UNION ALL SELECT session_id, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.secs) END, CASE WHEN b IS NOT NULL THEN event_id END, b.row_id FROM (
  SELECT g.session_id, od.k, g.used, od.event_id, MIN({'score': p.score, 'secs': p.secs, 'row_id': p.row_id}) FILTER (len(list_filter(g.used, lambda u: abs(u - p.secs) < 1200)) = 0) AS b
  FROM g JOIN od ON od.session_id = g.session_id AND od.k = g.k + 1 JOIN pairs p ON p.event_id = od.event_id GROUP BY ALL)),
picks AS MATERIALIZED (SELECT p.* FROM g JOIN pairs p ON p.event_id = g.event_id AND p.row_id = g.row_id)"""

RESPONSE_SQL = """anc AS (SELECT 'true' AS side, event_id, session_id, e_secs AS a, e_secs + length AS z FROM picks UNION ALL SELECT 'pseudo', event_id, session_id, secs, secs + length FROM picks),
fe AS (SELECT session_id, secs, 'metric' AS feature, metric AS value, quality AS weight FROM obs UNION ALL SELECT session_id, secs, 'log_metric', ln(1 + greatest(metric, 0)), quality FROM obs
 UNION ALL SELECT session_id, secs, 'active', CASE WHEN zone IN ('feeding', 'open_movement') THEN 1.0 ELSE 0.0 END, CASE WHEN metric IS NULL THEN 0.0 ELSE 1.0 END FROM obs),
ph(phase, at_end, lo, hi, need) AS (VALUES ('baseline', 0, -6000, -1200, 2), ('immediate', 1, 0, 1200, 1), ('recovery', 1, 1200, 6000, 2)),
pr AS (SELECT side, event_id, feature, phase, need, CASE WHEN value IS NOT NULL AND weight > 0 THEN weight END AS w, value FROM anc, ph, fe
 WHERE fe.session_id = anc.session_id AND fe.secs >= CASE WHEN at_end = 1 THEN z ELSE a END + lo AND fe.secs < CASE WHEN at_end = 1 THEN z ELSE a END + hi),
pm AS (SELECT side, event_id, feature, phase, CASE WHEN COUNT(w) >= need AND SUM(w) >= 1.0 THEN SUM(value * w) / SUM(w) END AS mean FROM pr GROUP BY side, event_id, feature, phase, need),
ch AS (SELECT event_id, feature, MAX(mean) FILTER (side = 'true' AND phase = 'immediate') - MAX(mean) FILTER (side = 'true' AND phase = 'baseline') AS ti, MAX(mean) FILTER (side = 'pseudo' AND phase = 'immediate') - MAX(mean) FILTER (side = 'pseudo' AND phase = 'baseline') AS pi,
 MAX(mean) FILTER (side = 'true' AND phase = 'recovery') - MAX(mean) FILTER (side = 'true' AND phase = 'baseline') AS tr, MAX(mean) FILTER (side = 'pseudo' AND phase = 'recovery') - MAX(mean) FILTER (side = 'pseudo' AND phase = 'baseline') AS pr FROM pm GROUP BY event_id, feature)"""

CHANGES = ("true_immediate", "pseudo_immediate", "immediate_difference", "true_recovery", "pseudo_recovery", "recovery_difference")


def operations(o: DataFrame) -> DataFrame:
    return o.filter("caretaker").select(KEY, F.col("window_id").alias("event_id"), "start_dt", "secs", (300.0 * (1 + F.col("window_id") % 3)).alias("length"), "metric", "quality")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    ops = operations(o)
    candidates = o.filter(candidate_slot(F.col("start_dt"))).groupBy(KEY, "start_dt").agg(F.min("window_id").alias("row_id"), F.min("secs").alias("secs"))
    spans = ops.select(KEY, F.col("secs").alias("lo"), (F.col("secs") + F.col("length")).alias("hi"))
    return events.control_pairs(ops.filter("metric > 60 and quality > 0.3"), candidates, spans, o.select(KEY, "secs"), KEY, coverage=COVERAGE)


@query(f"WITH {OBS_SQL}, {PAIRS_SQL} SELECT session_id, event_id, row_id, ROUND(score, 6) AS score, row_number() OVER (PARTITION BY event_id ORDER BY score, secs, row_id) AS place FROM pairs QUALIFY place <= 3")
def match_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best controls of each event, each for itself."""
    x = events.match_ranked(pairs(spark, sf_dir), 3)
    return x.select(KEY, "event_id", "row_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH RECURSIVE {OBS_SQL}, {PAIRS_SQL}, {PICKS_SQL} SELECT session_id, event_id, row_id, ROUND(clock, 6) AS clock, days, days = 0 AS same_date, ROUND(score, 6) AS score, length FROM picks")
def match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One control for each event, none within 20 minutes of another."""
    x = events.match_greedy(pairs(spark, sf_dir), KEY, RADIUS)
    return x.select(KEY, "event_id", "row_id", F.round("clock", 6).alias("clock"), F.col("days").cast("long").alias("days"), (F.col("days") == 0).alias("same_date"), F.round("score", 6).alias("score"), "length")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against the control that the greedy choice gave it, by feature: differences in differences. Has the event's session and date."""
    o = obs(spark, sf_dir)
    picks = events.match_greedy(pairs(spark, sf_dir), KEY, RADIUS)
    side = lambda name, at: picks.select(F.struct(F.lit(name).alias("side"), F.col("event_id").alias("own")).alias("event_id"), KEY, F.col(at).alias("anchor"), (F.col(at) + F.col("length")).alias("end"))
    q, m = F.col("quality"), F.col("metric")
    values = (("metric", m, q), ("log_metric", F.log(1 + F.greatest(m, F.when(m.isNotNull(), F.lit(0.0)))), q), ("active", F.when(F.col("zone").isin("feeding", "open_movement"), 1.0).otherwise(0.0), F.when(m.isNull(), 0.0).otherwise(1.0)))
    rows = o.select(KEY, "secs", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value"), w.cast("double").alias("weight")) for n, v, w in values])).alias("f")).select(KEY, "secs", "f.*")
    sides = small_or_plain(side("true", "e_secs").unionByName(side("pseudo", "secs")), BROADCAST_BYTES // 8)  # each is in a few phases and buckets
    means = cut(events.phase_means(rows, sides, KEY, PHASES, EVERY, width=7200, by=["feature"]))
    of = lambda name: means.filter(F.col("event_id.side") == name).select(F.col("event_id.own").alias("event_id"), "feature", "phase", "mean")
    x = events.paired(of("true"), of("pseudo"), ["feature"], tuple(p[0] for p in PHASES))
    return x.join(picks.select("event_id", KEY, F.timestamp_seconds("e_secs").cast("date").alias("date")), "event_id")


@query(f"""WITH RECURSIVE {OBS_SQL}, {PAIRS_SQL}, {PICKS_SQL}, {RESPONSE_SQL} SELECT event_id, feature, ROUND(ti, 6) AS true_immediate, ROUND(pi, 6) AS pseudo_immediate, ROUND(ti - pi, 6) AS immediate_difference,
 ROUND(tr, 6) AS true_recovery, ROUND(pr, 6) AS pseudo_recovery, ROUND(tr - pr, 6) AS recovery_difference FROM ch""")
def paired_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("event_id", "feature", *[F.round(c, 6).alias(c) for c in CHANGES])


def daily_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, phase, session_id, date, d, events): means of the days of a session."""
    x = responses(spark, sf_dir).select("event_id", "feature", KEY, "date", F.col("immediate_difference").alias("immediate"), F.col("recovery_difference").alias("recovery"))
    long = x.unpivot(["event_id", "feature", KEY, "date"], ["immediate", "recovery"], "phase", "d").filter("d is not null")
    return long.groupBy("feature", "phase", KEY, "date").agg(F.avg("d").alias("d"), F.count("*").alias("events"))


@query(f"""WITH RECURSIVE {OBS_SQL}, {PAIRS_SQL}, {PICKS_SQL}, {RESPONSE_SQL}, l AS (SELECT event_id, feature, 'immediate' AS phase, ti - pi AS d FROM ch UNION ALL SELECT event_id, feature, 'recovery', tr - pr FROM ch),
y AS (SELECT feature, phase, e.session_id, CAST(e.start_dt AS DATE) AS date, AVG(d) AS d, COUNT(*) AS events FROM l JOIN ex e USING (event_id) WHERE d IS NOT NULL GROUP BY ALL)
SELECT feature, phase, CAST(SUM(events) AS BIGINT) AS matched_events, COUNT(DISTINCT session_id) AS sessions, COUNT(*) AS event_days, ROUND(AVG(d), 6) AS mean_difference, ROUND(median(d), 6) AS median_difference FROM y GROUP BY feature, phase""")
def response_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_differences(spark, sf_dir)
    return d.groupBy("feature", "phase").agg(F.sum("events").alias("matched_events"), F.countDistinct(KEY).alias("sessions"), F.count("*").alias("event_days"), F.round(F.avg("d"), 6).alias("mean_difference"), F.round(F.percentile("d", 0.5), 6).alias("median_difference"))


@query()
def response_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By feature and phase: intervals of the mean daily difference when days and when whole sessions are drawn, and the signed-rank p (null below five
    days), adjusted over the features of a phase."""
    d, keys = daily_differences(spark, sf_dir), ["feature", "phase"]
    plain = models.bootstrap_mean(d.select(*keys, KEY, "date", "d"), keys, "d").select(*keys, F.col("n").alias("event_days"), F.col("low").alias("day_low"), F.col("high").alias("day_high"))
    x = models.cluster_bootstrap(d, keys, KEY, "d").join(plain, keys).join(models.signed_rank(d, keys, "d").select(*keys, "w_plus", "p"), keys, "left")
    x = stats.step_up(x.withColumn("p", F.when(F.col("event_days") >= 5, F.col("p"))), ["phase"], "p", ["feature"])
    return x.select(*keys, "clusters", "event_days", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "day_low", "day_high", "w_plus", "p", "q")])
