"""Exact percentiles, row numbers, running minima and ranks, in one task and over range partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlens.operators import models, order, quantiles, shared, stats


@pytest.fixture(scope="module")
def values(spark):
    """A hot value with a third of the rows, outliers, infinities, nulls, a null key, and a group of one row."""
    rng = random.Random(3)
    rows = [("a", rng.choice([5.0, 5.0, rng.gauss(0, 1), rng.uniform(0, 1e-9), 1e300 * rng.random(), None])) for _ in range(3000)]
    rows += [(None, float(k % 7)) for k in range(400)] + [("b", 2.5), ("c", None)] + [("d", v) for v in (float("inf"), -float("inf"), 1.0, 1.0 + 2**-52, 3.0) for _ in range(90)]
    return spark.createDataFrame([(k, x, j) for j, (k, x) in enumerate(rows)], "k string, x double, id int").repartition(5).cache()


PROBS = (0.0, 0.013, 0.25, 0.5, 0.75, 0.9, 1.0)


def plain(rows):
    return {r[0]: None if r[1] is None else [round(v, 9) if abs(v) < 1e200 else v for v in r[1]] for r in rows}


@pytest.mark.parametrize("rows", [0, 1, 50, 1000])
def test_percentiles_are_the_built_in_ones(values, rows, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    want = values.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, PROBS)))).collect()
    assert plain(quantiles.percentiles(values, ["k"], {"x": PROBS}, rows).collect()) == plain(want)
    v = values.filter("k = 'a' or k is null").withColumn("y", -F.col("x"))
    got = quantiles.percentiles(v, [], {"x": (0.3, 0.5), "y": (0.5,)}, rows).first()
    own = v.agg(F.percentile("x", F.array(F.lit(0.3), F.lit(0.5))), F.percentile("y", F.array(F.lit(0.5)))).first()
    assert [round(x, 9) for a in got for x in a] == [round(x, 9) for a in own for x in a]


def test_percentiles_of_nothing(values):
    assert quantiles.percentiles(values.limit(0), ["k"], {"x": (0.5,)}).count() == 0
    assert quantiles.percentiles(values.filter("k = 'c'"), ["k"], {"x": (0.5,)}, 0).collect()[0]["x"] is None


@pytest.mark.parametrize("rows", [0, 10**6])
def test_numbers_minima_and_blocks(values, rows):
    v = values.filter("x is not null").orderBy("id").toPandas()
    got = order.numbered(values.filter("x is not null"), ["k"], [F.col("x"), F.col("id")], "i", "n", rows).toPandas()
    want = v.sort_values(["x", "id"]).groupby("k", dropna=False).cumcount() + 1
    merged = got.set_index("id")["i"]
    assert all(merged[v["id"][j]] == i for j, i in want.items()) and len(got) == len(v)
    assert dict(got.fillna({"k": "none"}).groupby("k")["n"].first()) == dict(v.fillna({"k": "none"}).groupby("k").size())
    low = order.running_min(values.filter("x is not null"), ["k"], [F.col("id")], "x", "low", rows).toPandas().set_index("id")["low"]
    back = v.sort_values("id", ascending=False).groupby("k", dropna=False)["x"].cummin()
    assert all(low[v["id"][j]] == x for j, x in back.items())
    for n in (1, 2, 10, 3852):
        b = order.blocks(values.limit(n), ["id"], 3, "b", rows).orderBy("id").toPandas()["b"].tolist()
        assert b == [j for j in range(3) for _ in range(n // 3 + (j < n % 3))]


@pytest.mark.parametrize("rows", [0, 10**6])
def test_ranks_and_step_up_over_range_partitions(spark, values, rows):
    v = values.filter("k = 'a' and abs(x) < 1e200")
    ranks = order.value_ranks(v, [], "x", {"even": F.when(F.col("id") % 2 == 0, 1).otherwise(0)}, rows).toPandas()
    p = v.toPandas()
    want = p["x"].rank()
    r = ranks.set_index("x")
    assert all(r.loc[x, "rank"] == w for x, w in zip(p["x"], want)) and ranks["n"].sum() == len(p) and ranks["even"].sum() == (p["id"] % 2 == 0).sum()
    w = models.signed_rank(v.withColumn("g", F.lit(1)), ["g"], "x", rows=rows).first()
    d = p["x"][p["x"] != 0]
    assert abs(w["w_plus"] - d.abs().rank()[d > 0].sum()) < 1e-6 and w["n"] == len(d)
    q = stats.step_up(values.select("k", "id", F.when(F.col("id") % 11 > 0, F.rand(2)).alias("p")), ["k"], "p", ["id"], rows).toPandas()
    for _, own in q.groupby("k", dropna=False):
        s = own.dropna(subset="p").sort_values("p")
        adjusted = np.minimum.accumulate((s["p"] * len(s) / np.arange(1, len(s) + 1))[::-1])[::-1].clip(upper=1)
        assert np.allclose(s["q"], adjusted) and own["q"].isna().sum() == own["p"].isna().sum()
    assert len(q) == values.count()


def test_joins_of_keys_and_checkpoint_folder(spark, values):
    few = values.groupBy("k").agg(F.count("*").alias("n"))
    for limit in (0, shared.BROADCAST_BYTES):
        joined = shared.join_keys(values, few, ["k"]) if limit else values.join(few, values["k"].eqNullSafe(few["k"])).drop(few["k"])
        assert joined.filter("n is null").count() == 0 and joined.count() == values.count()
    assert shared.checkpoint_dir(spark).startswith("file:")
