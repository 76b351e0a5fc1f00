"""Zone profiles replayed on other geometries: shares of variance by sums, and their bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import replicate_sums, statistic_interval
from .shared import join_keys, small_or_plain
from .zones import ZONES

KINDS = ("raw", "normalized")
#: Target geometries that the bootstrap holds in one matrix.
GEOMETRIES = 1000


def _each(name: str) -> list[str]:
    return [f"{name}_{z}" for z in ZONES]


def densities(profiles: DataFrame, geometry: DataFrame, eps: Column) -> DataFrame:
    """``profiles`` (profile_id, geometry_id, o_<zone> shares) with d_<zone>: share over area of the profile's own geometry (geometry_id, a_<zone>), both with ``eps``, to
    geometric mean 1. A profile whose geometry is missing, or with a missing share, goes."""
    x = join_keys(profiles, geometry, ["geometry_id"], "inner").dropna(subset=_each("o"))
    raw = [(F.col(o) + eps) / (F.col(a) + eps) for o, a in zip(_each("o"), _each("a"), strict=True)]
    mean = F.exp(sum((F.log(r) for r in raw), F.lit(0.0)) / len(raw))
    return x.select(*[c for c in profiles.columns if c not in _each("o")], *[(r / mean).alias(d) for r, d in zip(raw, _each("d"), strict=True)])


def replayed(x: DataFrame, geometry: DataFrame, eps: Column) -> DataFrame:
    """Every profile on every geometry: raw_<zone>, the expected share, and normalized_<zone>, its log selectivity against the area."""
    g = small_or_plain(geometry.select(F.col("geometry_id").alias("target_id"), *_each("a")))
    y = x.drop("geometry_id").crossJoin(g)
    total = sum((F.col(d) * F.col(a) for d, a in zip(_each("d"), _each("a"), strict=True)), F.lit(0.0))
    y = y.select("*", *[(F.col(d) * F.col(a) / total).alias(n) for d, a, n in zip(_each("d"), _each("a"), _each("raw"), strict=True)])
    return y.select("*", *[(F.log(F.col(r) + eps) - F.log(F.col(a) + eps)).alias(n) for r, a, n in zip(_each("raw"), _each("a"), _each("normalized"), strict=True)])


def shares_of_variance(y: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, zone, and <kind>_geometry, <kind>_profile, <kind>_interaction): shares of the variance by geometry, by profile and by neither.

    The design is balanced, so sums give them: of squares, of squared means by profile, and of squared means by geometry. Rows are aggregated twice and never
    joined to their means; a profile's rows stand in one task, so its mean is made before the shuffle."""
    cols = [f"{k}_{z}" for k in KINDS for z in ZONES]
    square = lambda c: F.col(c) * F.col(c)
    one = y.groupBy(*keys, "profile_id").agg(F.count("*").alias("_g"), *[f(c) for c in cols for f in (lambda c: F.avg(c).alias(f"m_{c}"), lambda c: F.sum(square(c)).alias(f"q_{c}"))])
    p = one.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_g").alias("_g"), *[f(c) for c in cols for f in (lambda c: F.sum(f"m_{c}").alias(f"t_{c}"), lambda c: F.sum(square(f"m_{c}")).alias(f"p_{c}"), lambda c: F.sum(f"q_{c}").alias(f"q_{c}"))])
    g = y.groupBy(*keys, "target_id").agg(*[F.avg(c).alias(c) for c in cols]).groupBy(*keys).agg(*[F.sum(square(c)).alias(f"g_{c}") for c in cols])
    both, n, m = join_keys(p, g, keys), F.col("_n"), F.col("_g")

    def of(c: str) -> list[Column]:
        grand = F.col(f"t_{c}") / n
        total = F.greatest(F.col(f"q_{c}") - n * m * grand * grand, F.lit(1e-12))
        geometry, profile = n * (F.col(f"g_{c}") - m * grand * grand), m * (F.col(f"p_{c}") - n * grand * grand)
        return [geometry / total, profile / total, F.greatest(F.col(f"q_{c}") - n * m * grand * grand - geometry - profile, F.lit(0.0)) / total]

    rows = [F.struct(F.lit(z).alias("zone"), *[v.alias(f"{k}_{w}") for k in KINDS for v, w in zip(of(f"{k}_{z}"), ("geometry", "profile", "interaction"), strict=True)]) for z in ZONES]
    return both.select(*keys, n.alias("profiles"), m.alias("geometries"), F.explode(F.array(*rows)).alias("s")).select(*keys, "profiles", "geometries", "s.*")


def geometry_shares(sums: np.ndarray, n_geometries: int) -> np.ndarray:
    """(replicates, kinds, zones) geometry shares from summed vectors: values by kind, geometry and zone, squares by kind and zone, weight."""
    z, k = len(ZONES), len(KINDS)
    n = sums[:, -1][:, None, None]
    s = sums[:, : k * n_geometries * z].reshape(-1, k, n_geometries, z)
    q = sums[:, k * n_geometries * z : -1].reshape(-1, k, z)
    grand = s.sum(2) / (n * n_geometries)
    total = q - n * n_geometries * grand**2
    return ((s**2).sum(2) / n - n * n_geometries * grand**2) / np.maximum(total, 1e-12)


def reduction_interval(x: DataFrame, geometry: DataFrame, eps: float, replicates: int = 5000, seed: int = 7) -> DataFrame:
    """One row: mean geometry shares of the raw and of the normalized values, by how much the second is smaller, the bootstrap interval of that over
    profiles, and the share of replicates in which it is not. ``x`` has d_<zone>; the geometries, a dimension of at most ``GEOMETRIES`` rows, go to every task."""
    rows = geometry.select(*_each("a")).limit(GEOMETRIES + 1).collect()
    if len(rows) > GEOMETRIES:
        raise ValueError(f"more than {GEOMETRIES} geometries")
    areas = np.array(rows, float)

    def features(pdf):
        v = pdf[_each("d")].to_numpy(float)[:, None, :] * areas[None]
        v /= v.sum(2, keepdims=True)
        kinds = np.stack([v, np.log(v + eps) - np.log(areas + eps)[None]], 1)  # profiles, kinds, geometries, zones
        return np.hstack([kinds.reshape(len(v), -1), (kinds**2).sum(2).reshape(len(v), -1), np.ones((len(v), 1))])

    def statistic(sums: np.ndarray) -> np.ndarray:
        mean = geometry_shares(sums, len(areas)).mean(2)
        return np.column_stack([mean, 1 - mean[:, 1] / mean[:, 0], sums[:, -1]])

    names = ["raw_geometry", "normalized_geometry", "reduction", "profiles"]
    return statistic_interval(replicate_sums(x, ["profile_id", *_each("d")], features, replicates, seed), statistic, names, "reduction")


def coupling_interval(boundaries: DataFrame, replicates: int = 5000, seed: int = 8) -> DataFrame:
    """One row: over complete boundaries (boundary_id, raw_<zone>, normalized_<zone>, area_<zone> steps), the mean over zones of the correlation of steps with
    area steps, raw and normalized, the difference and its bootstrap interval. Correlations come from summed moments."""
    z = len(ZONES)

    def features(pdf):
        a, *kinds = (pdf[_each(n)].to_numpy(float) for n in ("area", *KINDS))
        return np.hstack([np.ones((len(a), 1)), a, a * a, *[w for v in kinds for w in (v, v * v, v * a)]])

    def statistic(sums: np.ndarray) -> np.ndarray:
        n, (a, aa, *rest) = sums[:, :1], np.split(sums[:, 1:], 8, axis=1)
        out = []
        for v, vv, va in (rest[:3], rest[3:]):
            out.append(((n * va - v * a) / np.sqrt((n * vv - v * v) * (n * aa - a * a))).reshape(-1, z).mean(1))
        return np.column_stack([*out, out[0] - out[1], n])

    names = ["raw_correlation", "normalized_correlation", "reduction", "boundaries"]
    columns = ["boundary_id", *[c for n in ("area", *KINDS) for c in _each(n)]]
    return statistic_interval(replicate_sums(boundaries.dropna(subset=columns), columns, features, replicates, seed), statistic, names, "reduction")
