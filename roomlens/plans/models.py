"""Regimes, records, posteriors, bootstraps, tests and hidden states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import num
from ..operators import audio, contract, models, predict, states
from ..operators.order import blocks
from ..operators.shared import join_keys
from .adapters import OBS_SQL, obs, table
from .registry import query
from .studies import means
from ..operators import events


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.65) AS a, quantile_cont(l_extendedprice, 0.8) AS b, quantile_cont(l_tax, 0.7) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, COUNT(*) FILTER (l_quantity >= a AND l_extendedprice >= b) AS calls, COUNT(*) FILTER (l_quantity >= a AND l_tax >= c) AS chirps, COUNT(*) FILTER (l_extendedprice >= b AND l_tax >= c) AS clucks
 FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def call_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_tax")
    x = audio.above_group_quantile(x, ["l_returnflag"], {"l_quantity": 0.65, "l_extendedprice": 0.8, "l_tax": 0.7})
    a, b, c = F.col("l_quantity_high"), F.col("l_extendedprice_high"), F.col("l_tax_high")
    return x.groupBy("l_returnflag").agg(F.count(F.when(a & b, 1)).alias("calls"), F.count(F.when(a & c, 1)).alias("chirps"), F.count(F.when(b & c, 1)).alias("clucks"))


SCALE_SQL = "greatest(1.4826 * median(abs({0} - c)), (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) / 1.349, stddev_pop({0}), 1e-6)"


@query(f"""WITH {OBS_SQL}, o AS (SELECT window_id, metric, quality FROM obs WHERE metric IS NOT NULL AND quality IS NOT NULL),
ma AS (SELECT MIN(c) AS c, {SCALE_SQL.format('metric')} AS s FROM (SELECT metric, median(metric) OVER () AS c FROM o)),
mb AS (SELECT MIN(c) AS c, {SCALE_SQL.format('quality')} AS s FROM (SELECT quality, median(quality) OVER () AS c FROM o)),
z AS (SELECT window_id, (metric - ma.c) / ma.s AS x, (quality - mb.c) / mb.s AS y FROM o, ma, mb),
q AS (SELECT quantile_cont(x, 0.95) AS x95, quantile_cont(x, 0.99) AS x99, quantile_cont(y, 0.95) AS y95, quantile_cont(y, 0.99) AS y99 FROM z),
s AS (SELECT window_id, 1 / (1 + exp(-least(greatest((x - x95) / greatest(x99 - x95, 0.1), -30), 30))) AS d, 1 / (1 + exp(-least(greatest((y - y95) / greatest(y99 - y95, 0.1), -30), 30))) AS p FROM z, q),
b AS (SELECT *, (1 - d) * (1 - p) AS g FROM s)
SELECT window_id, ROUND(d, 6) AS dense, ROUND(p, 6) AS sparse, ROUND(g, 6) AS background, CASE WHEN d >= p AND d >= g THEN 'dense' WHEN p >= g THEN 'sparse' ELSE 'background' END AS regime,
 ROUND(greatest(d, p, g) - CASE WHEN d >= p AND d >= g THEN greatest(p, g) WHEN p >= g THEN greatest(d, g) ELSE greatest(d, p) END, 6) AS margin FROM b""")
def regime_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).select("window_id", "metric", "quality").filter("metric is not null and quality is not null")
    s = audio.regime_scores(o, "metric", "quality")
    label, margin = audio.top_label({n: F.col(n) for n in ("dense", "sparse", "background")})
    return s.select("window_id", *[F.round(c, 6).alias(c) for c in ("dense", "sparse", "background")], label.alias("regime"), F.round(margin, 6).alias("margin"))


def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).filter("metric is not null")
    return o.groupBy("session_id", F.col("start_dt").cast("date").alias("date"), "zone").agg(F.count("*").alias("n"), F.avg("metric").alias("mean"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT session_id, CAST(start_dt AS DATE) AS date, zone, COUNT(*) AS n, AVG(metric) AS mean FROM obs WHERE metric IS NOT NULL GROUP BY ALL),
g AS (SELECT session_id, date, COUNT(*) AS zones FROM c GROUP BY ALL)
SELECT COUNT(*) AS records, COUNT(*) AS distinct_keys, CAST(0 AS BIGINT) AS faulty, 0.0 AS max_error, CAST(SUM(5 - zones) AS BIGINT) AS absent_zones FROM g""")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = contract.audit(contract.records(zone_rows(spark, sf_dir), ["session_id", "date"]), ["session_id", "date"])
    return a.withColumn("max_error", F.round("max_error", 9))


@query()
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = contract.records(zone_rows(spark, sf_dir), ["session_id", "date"])
    return r.select("session_id", "date", contract.to_text(F.col("record")).alias("record"), F.array_join(contract.errors(F.col("record")), ";").alias("errors"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, exp(CAST(x AS DOUBLE)) AS p FROM e),
n AS (SELECT vec_id, p / SUM(p) OVER (PARTITION BY vec_id) AS p FROM s)
SELECT vec_id, ROUND(-SUM(p * ln(p)) / ln(COUNT(*)), 6) AS entropy, ROUND(MAX(p), 6) AS top FROM n GROUP BY vec_id""")
def posterior_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    x = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).select("vec_id", "e", total.alias("total"))
    x = x.select("vec_id", F.transform("e", lambda v: v / F.col("total")).alias("p"))
    h = -F.aggregate("p", F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0)) / F.log(F.size("p").cast("double"))
    return x.select("vec_id", F.round(h, 6).alias("entropy"), F.round(F.array_max("p"), 6).alias("top"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a session's daily means with the interval of 5,000 draws of days."""
    d = obs(spark, sf_dir).groupBy("session_id", F.col("start_dt").cast("date").alias("date")).agg(F.avg("metric").alias("metric"))
    b = models.bootstrap_mean(d, ["session_id"], "metric", replicates=5000)
    return b.select("session_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query()
def signed_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events.differences(means(spark, sf_dir))
    x = d.unpivot(["event_id"], ["immediate", "recovery"], "measure", "d")
    return models.signed_rank(x, ["measure"], "d").select("measure", "n", F.round("w_plus", 3).alias("w_plus"), F.round("p", 6).alias("p"))


@query()
def hidden_state_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of each session as sequences; the training table is bounded by sessions and hours."""
    h = obs(spark, sf_dir).groupBy("session_id", F.date_trunc("hour", "start_dt").alias("hour")).agg(F.avg("metric").alias("metric"), F.avg("quality").alias("quality"))
    h = h.withColumn("weight", F.coalesce("quality", F.lit(0.0)))
    g = models.state_grid(h, "session_id", ["hour"], ["metric"], ["weight"], [2, 3], [1, 2])
    return g.select("states", "seed", F.round("log_likelihood", 3).alias("log_likelihood"), "rounds", F.round("largest_share", 4).alias("largest_share"))


def state_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's day of hours as a sequence: mean value and quality, share of active zones, log of the rows; sessions are ten groups of users, and folds are
    blocks of sessions that follow each other by their starts."""
    o = obs(spark, sf_dir).withColumn("session_id", F.col("user_id") % 10)
    active = F.avg(F.col("zone").isin("feeding", "open_movement").cast("double"))
    h = o.groupBy("session_id", F.date_trunc("hour", "start_dt").alias("hour")).agg(F.avg("metric").alias("m"), F.avg("quality").alias("q"), active.alias("a"), F.log(F.count("*").cast("double")).alias("n"))
    weight = F.coalesce("q", F.lit(0.0))
    r = F.struct("hour", F.array("m", "q", "a", "n").alias("x"), F.array(weight, weight, F.lit(1.0), F.lit(1.0)).alias("w"))
    seq = h.groupBy("session_id", F.col("hour").cast("date").alias("date")).agg(F.sort_array(F.collect_list(r)).alias("r"))
    fold = blocks(o.groupBy("session_id").agg(F.min("start_dt").alias("t")), ["t", "session_id"], 3, "fold")
    return join_keys(seq, fold.select("session_id", F.col("fold").cast("int").alias("fold")), ["session_id"], "inner").select("session_id", "date", "fold", F.col("r.x").alias("x"), F.col("r.w").alias("w"))


SEEDS = [11, 23, 37]


@query()
def hidden_state_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out likelihoods of 2 to 12 states, three folds of sessions and three seeds."""
    g = states.cross_validated(state_sequences(spark, sf_dir), list(range(2, 13)), 3, SEEDS)
    return g.select("states", "fold", "seed", "rounds", "train_rows", "test_rows", *[F.round(c, 3).alias(c) for c in ("train_ll", "test_ll", "train_bic")], *[F.round(c, 5).alias(c) for c in ("test_ll_per_row", "min_occupancy")])


@query()
def hidden_state_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number of states, over folds and pairs of seeds: how far the states of the rows agree (adjusted Rand index) and how alike the matched states are."""
    s = states.stability(states.fit(state_sequences(spark, sf_dir), [2, 3, 4, 6, 8], 3, SEEDS))
    p = F.when(~F.isnan("profile_correlation"), F.col("profile_correlation"))
    return s.groupBy("states").agg(F.count("*").alias("pairs"), F.max("rows").alias("rows"), F.round(F.percentile("ari", 0.5), 6).alias("median_ari"), F.round(F.min("ari"), 6).alias("least_ari"), F.round(F.percentile(p, 0.5), 6).alias("median_profile_correlation"))


@query()
def hidden_state_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a model of four states, by session, day and fold: rows, changes of state, share of the commonest state, mean probability of the likeliest."""
    x = states.paths(states.fit(state_sequences(spark, sf_dir), [4], 3, SEEDS[:1]), ["session_id", "date"])
    n = F.size("path")
    changes = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.element_at("path", i) != F.element_at("path", F.least(i + 1, n)))))
    most = F.array_max(F.transform(F.array_distinct("path"), lambda s: F.size(F.filter("path", lambda v: v == s))))
    mean = F.aggregate("top", F.lit(0.0), lambda a, v: a + v) / n
    return x.select("session_id", "date", "fold", "held_out", n.alias("rows"), changes.alias("changes"), F.round(most / n, 6).alias("commonest"), F.round(mean, 6).alias("certainty"))


@query()
def nuisance_predictability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well session, hour, value and quality tell the zone of users that are not trained on."""
    o = obs(spark, sf_dir).select("user_id", "zone", "session_id", F.hour("start_dt").alias("hour"), "metric", "quality")
    p = predict.predictability(o, "zone", "user_id", ["session_id", "hour"], ["metric", "quality"])
    return p.select("fold", "n", *[F.round(c, 3).alias(c) for c in ("balanced_accuracy", "macro_f1", "chance")])


@query()
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors read as frames of samples."""
    f = table(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    s = audio.spectral(f, 22050.0)
    return s.select("media_id", "frame", *[F.round(c, 5).alias(c) for c in s.columns[2:]])


@query("""WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders),
l AS (SELECT l_orderkey, COUNT(*) AS items, SUM(l_quantity) AS qty FROM lineitem GROUP BY 1)
SELECT c_custkey, b.o_orderkey AS last_order, items, ROUND(qty, 2) AS qty, n_name AS nation, CASE WHEN b.o_orderkey IS NULL THEN 'failed' WHEN items IS NULL THEN 'audio_missing'
 WHEN c_acctbal < 0 THEN 'warning' ELSE 'ok' END AS status FROM customer LEFT JOIN b ON b.o_custkey = c_custkey AND rn = 1 LEFT JOIN l ON l_orderkey = b.o_orderkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def merge_three_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import keep_best

    t = lambda n: table(spark, sf_dir, n)
    last = keep_best(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    items = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("qty"))
    c = t("customer")
    x = c.join(last, c["c_custkey"] == last["o_custkey"], "left").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = t("nation")  # a dimension of 25 rows
    x = x.join(F.broadcast(n), x["c_nationkey"] == n["n_nationkey"], "left")
    status = F.when(F.col("o_orderkey").isNull(), "failed").when(F.col("items").isNull(), "audio_missing").when(F.col("c_acctbal") < 0, "warning").otherwise("ok")
    return x.select("c_custkey", F.col("o_orderkey").alias("last_order"), "items", F.round("qty", 2).alias("qty"), F.col("n_name").alias("nation"), status.alias("status"))


@query(f"""WITH {OBS_SQL} SELECT zone, COUNT(*) AS rows_all, COUNT(metric) AS rows_with_value, ROUND(100.0 * AVG(CAST(metric IS NOT NULL AND quality > 0 AS INT)), 6) AS percent_covered,
 COUNT(DISTINCT user_id) AS tracks, MIN(CAST(start_dt AS DATE)) AS first_date, MAX(CAST(start_dt AS DATE)) AS last_date FROM obs GROUP BY zone""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("start_dt").cast("date")
    ok = F.coalesce(F.col("metric").isNotNull() & (F.col("quality") > 0), F.lit(False))
    return obs(spark, sf_dir).groupBy("zone").agg(
        F.count("*").alias("rows_all"), F.count("metric").alias("rows_with_value"), F.round(100 * F.avg(ok.cast("int")), 6).alias("percent_covered"),
        F.countDistinct("user_id").alias("tracks"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT session_id, strftime(start_dt, '%Y-%m') AS month, metric, quality FROM obs)
SELECT session_id, month, kind, ROUND(AVG(v), 6) AS mean, COUNT(v) AS n FROM (SELECT session_id, month, 'metric' AS kind, metric AS v FROM m UNION ALL SELECT session_id, month, 'quality', quality FROM m) GROUP BY ALL""")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = obs(spark, sf_dir).select("session_id", F.date_format("start_dt", "yyyy-MM").alias("month"), num.present(F.col("metric")).alias("metric"), num.present(F.col("quality")).alias("quality"))
    x = m.unpivot(["session_id", "month"], ["metric", "quality"], "kind", "v")
    return x.groupBy("session_id", "month", "kind").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query()
def room_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested timeline for each session: a frame a day with zones, risk score, phase and level."""
    from ..operators import timeline, zones
    from .series import markers

    n = obs(spark, sf_dir).groupBy("session_id", F.col("start_dt").cast("date").alias("date"), "zone").agg(F.count("*").alias("n"))
    risk = zones.risk(1 - F.col("mobility"), F.col("zone_imbalance"), 1 - F.col("zone_entropy"), F.col("drinking_fraction"))
    d = timeline.document(timeline.frames(n, markers(spark, sf_dir).select("session_id", "date", risk.alias("risk")), "session_id", "date"), "session_id")
    return d.select("session_id", F.size("timeline").alias("frames"), F.to_json("timeline").alias("timeline")).join(timeline.faults(d, "session_id"), "session_id")
