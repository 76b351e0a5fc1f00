"""Counterfactual geometry: sums against two-way decompositions, bootstraps and p-values against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlens.functions import num
from roomlens.operators import counterfactual, resample
from roomlens.operators.zones import ZONES
from roomlens.plans import catalogue


def geometry_share(v):
    """(zones,) of profiles x geometries x zones, by deviations from means."""
    grand = v.mean((0, 1))
    return len(v) * ((v.mean(0) - grand) ** 2).sum(0) / ((v - grand) ** 2).sum((0, 1))


@pytest.fixture(scope="module")
def replay(spark):
    rng = np.random.default_rng(2)
    areas, own = rng.dirichlet([4, 3, 5, 6], 12), rng.dirichlet([2, 2, 2, 2], 200)
    g = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(areas)], "geometry_id long, " + ", ".join(f"a_{z} double" for z in ZONES))
    p = spark.createDataFrame([(k, k % 13, *map(float, o)) for k, o in enumerate(own)], "profile_id long, geometry_id long, " + ", ".join(f"o_{z} double" for z in ZONES))
    kept = [k for k in range(200) if k % 13 < 12]  # one geometry is missing
    d = (own[kept] + 0.005) / (areas[[k % 13 for k in kept]] + 0.005)
    raw = d[:, None] * areas[None]
    raw /= raw.sum(2, keepdims=True)
    return p, g, raw, np.log(raw + 0.005) - np.log(areas + 0.005)


def test_shares_of_variance_are_those_of_the_two_way_table(replay):
    p, g, raw, normalized = replay
    x = counterfactual.shares_of_variance(counterfactual.replayed(counterfactual.densities(p, g, F.lit(0.005)), g, F.lit(0.005)), []).toPandas().set_index("zone")
    assert (x["profiles"] == len(raw)).all() and (x["geometries"] == 12).all()
    for kind, v in (("raw", raw), ("normalized", normalized)):
        grand = v.mean((0, 1))
        total = ((v - grand) ** 2).sum((0, 1))
        profile = v.shape[1] * ((v.mean(1) - grand) ** 2).sum(0) / total
        for j, z in enumerate(ZONES):
            geo = geometry_share(v)[j]
            assert np.allclose(x.loc[z, [f"{kind}_geometry", f"{kind}_profile", f"{kind}_interaction"]].astype(float), [geo, profile[j], max(1 - geo - profile[j], 0)], atol=1e-9)


def test_reduction_interval_is_that_of_a_plain_bootstrap(replay, monkeypatch):
    monkeypatch.setattr(resample, "TASK_ROWS", 50)  # several tasks
    p, g, raw, normalized = replay
    got = counterfactual.reduction_interval(counterfactual.densities(p, g, F.lit(0.005)), g, 0.005, replicates=3000).first()
    assert got["profiles"] == len(raw) and abs(got["raw_geometry"] - geometry_share(raw).mean()) < 1e-9
    assert abs(got["reduction"] - (1 - geometry_share(normalized).mean() / geometry_share(raw).mean())) < 1e-9
    rng = np.random.default_rng(5)
    drawn = []
    for _ in range(2000):
        at = rng.integers(0, len(raw), len(raw))
        drawn.append(1 - geometry_share(normalized[at]).mean() / geometry_share(raw[at]).mean())
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.15 * (high - low) and abs(got["high"] - high) < 0.15 * (high - low)
    assert got["at_most_zero"] == np.mean(np.array(drawn) <= 0)


def test_replicates_do_not_depend_on_partitions(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k % 17)) for k in range(500)], "id long, x double")
    sums = []
    for rows in (20_000, 60):
        monkeypatch.setattr(resample, "TASK_ROWS", rows)
        s = resample.replicate_sums(df, ["id", "x"], lambda pdf: np.column_stack([pdf["x"], np.ones(len(pdf))]), replicates=300).collect()
        sums.append({r["r"]: r["sums"] for r in s})
    assert sums[0].keys() == sums[1].keys() == set(range(-1, 300)) and all(np.allclose(sums[0][r], sums[1][r]) for r in sums[0])
    assert sums[0][-1] == [sum(float(k % 17) for k in range(500)), 500.0]
    assert resample.replicate_sums(df.limit(0), ["id", "x"], lambda pdf: pdf[["x"]].to_numpy()).count() == 0


def test_coupling_interval_is_that_of_a_plain_bootstrap(spark):
    rng = np.random.default_rng(8)
    area = rng.normal(size=(40, 4))
    raw, normalized = area + rng.normal(size=(40, 4)), 0.2 * area + rng.normal(size=(40, 4))
    names = [f"{n}_{z}" for n in ("area", "raw", "normalized") for z in ZONES]
    rows = [(k, *map(float, np.hstack([area[k], raw[k], normalized[k]]))) for k in range(40)] + [(99, *[None] * 12)]
    got = counterfactual.coupling_interval(spark.createDataFrame(rows, "boundary_id long, " + ", ".join(f"{c} double" for c in names)), replicates=3000).first()
    mean = lambda v, a: np.mean([np.corrcoef(v[:, j], a[:, j])[0, 1] for j in range(4)])
    assert got["boundaries"] == 40 and abs(got["reduction"] - (mean(raw, area) - mean(normalized, area))) < 1e-9
    drawn = []
    for _ in range(2000):
        at = rng.integers(0, 40, 40)
        drawn.append(mean(raw[at], area[at]) - mean(normalized[at], area[at]))
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.2 * (high - low) and abs(got["high"] - high) < 0.2 * (high - low)


def beta_by_quadrature(x, a, b):
    """Integral of t^(a-1) (1-t)^(b-1) up to x over the whole, with t = sin^2 u."""
    def part(to):
        u = np.linspace(0, math.asin(math.sqrt(to)), 400_001)
        y = 2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
        return (y[1:-1:2].sum() * 4 + y[2:-1:2].sum() * 2 + y[0] + y[-1]) * (u[1] - u[0]) / 3
    return part(x) / part(1.0)


def test_p_of_correlations(spark):
    assert all(abs(r["g"] - math.lgamma(r["z"])) < 1e-11 * max(1, abs(math.lgamma(r["z"]))) for r in spark.createDataFrame([(z,) for z in (0.5, 1.0, 1.5, 2.0, 7.3, 120.0)], "z double").withColumn("g", num.log_gamma(F.col("z"))).collect())
    cases = [(r, n) for n in (3, 4, 5, 12, 49, 300, 2000) for r in (0.0, 0.01, -0.3, 0.7, -0.95, 1.0)]
    rows = spark.createDataFrame([*cases, (0.5, 2), (None, 9)], "r double, n int").withColumn("p", num.correlation_p(F.col("r"), F.col("n"))).collect()
    for r in rows[: len(cases)]:
        if r["n"] == 3:
            want = 1 - 2 / math.pi * math.asin(abs(r["r"]))  # one degree: the Cauchy distribution
        elif r["n"] == 4:
            want = 1 - abs(r["r"])  # two degrees
        else:
            want = beta_by_quadrature(1 - r["r"] ** 2, (r["n"] - 2) / 2, 0.5) if abs(r["r"]) < 1 else 0.0
        assert abs(r["p"] - want) < 1e-9, tuple(r)
    assert rows[-2]["p"] is None and rows[-1]["p"] is None


def test_queries_without_sql(spark, data):
    larger = data.replace("sf0.001", "sf0.01")
    r = catalogue.QUERIES["counterfactual_interval"](spark, larger).first()
    v = catalogue.QUERIES["counterfactual_variance"](spark, larger).toPandas()
    assert abs(r["raw_geometry"] - v["raw_geometry"].mean()) < 1e-5 and abs(r["normalized_geometry"] - v["normalized_geometry"].mean()) < 1e-5
    assert r["low"] <= r["reduction"] <= r["high"] and 0 <= r["at_most_zero"] <= 1
    c = catalogue.QUERIES["boundary_coupling"](spark, larger).toPandas().set_index("zone")
    t = catalogue.QUERIES["boundary_coupling_tests"](spark, larger).toPandas().set_index("zone")
    assert len(t) == 4 and (t["boundaries"] == 49).all()
    for k in ("raw_pearson", "normalized_spearman"):
        assert np.allclose(t[k], c.loc[t.index, k], atol=1e-6) and ((t[f"{k}_p"] > 0) & (t[f"{k}_q"] >= t[f"{k}_p"] - 1e-9)).all()
    b = catalogue.QUERIES["boundary_coupling_interval"](spark, larger).first()
    assert b["boundaries"] == 49 and abs(b["raw_correlation"] - c["raw_pearson"].mean()) < 1e-5 and b["low"] <= b["reduction"] <= b["high"]
