"""Seeded bootstraps, signed-rank tests, assignment, and hidden-state models by group."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import ROWS, value_ranks


#: Poisson(1) by the top 16 bits of a hash.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def poisson_weights(ids: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """(rows, replicates) weights of replicates ``first`` to ``last``, by hashes of a row's id and the replicate."""
    with np.errstate(over="ignore"):
        r = (np.arange(first, last, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        h = ids[:, None] ^ r[None, :]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _POISSON[(h >> np.uint64(48)).astype(np.int64)]


def bootstrap_mean(df: DataFrame, keys: list[str], x: str, replicates: int = 5000, seed: int = 7, step: int = 250) -> DataFrame:
    """Percentile interval of a group's mean by the Poisson bootstrap: every row gets one weight a replicate, so a group
    is summed in parts and never gathered. Weights are hashes of the row, so the order does not matter; rows that are equal in
    all columns get equal weights, so a table with such rows should bring a column that tells them apart."""
    part = df.filter(F.col(x).isNotNull()).withColumn("_id", F.xxhash64(*df.columns))
    n = part.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))

    def weigh(it):
        for pdf in it:
            for k, own in pdf.groupby(keys, dropna=False):
                ids, v = own["_id"].to_numpy().view(np.uint64), own[x].to_numpy(float)
                for lo in range(0, replicates, step):
                    w = poisson_weights(ids, lo, min(lo + step, replicates), seed).astype(float)
                    r = np.arange(lo, lo + w.shape[1])
                    yield pd.DataFrame({**{c: [z] * len(r) for c, z in zip(keys, k, strict=True)}, "r": r, "s": v @ w, "w": w.sum(0)})

    kind = dict(df.dtypes)
    shape = ", ".join(f"{k} {kind[k]}" for k in keys) + ", r int, s double, w double"
    sums = part.select(*keys, x, "_id").mapInPandas(weigh, shape).groupBy(*keys, "r").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ci = sums.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return n.join(ci, keys).select(*keys, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, x: str, replicates: int = 5000, seed: int = 7) -> DataFrame:
    """Percentile interval of a mean when whole clusters are drawn: for each replicate as many clusters as there are, with
    repetition, by hashes. Rows enter as one sum for each cluster; null below two clusters. Clusters are sessions, few a key."""
    c = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(cluster).alias("_c")).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))
    held = c.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_s", "_n"))).alias("_cs")).withColumn("_k", F.size("_cs"))
    r = held.select(*keys, "_cs", "_k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    pick = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.col("_cs")[F.pmod(F.xxhash64(F.lit(seed), F.col("_r"), j), F.col("_k")).cast("int")])
    d = r.withColumn("_p", pick)
    total = lambda f: F.aggregate("_p", F.lit(0.0), lambda a, y: a + y[f].cast("double"))
    ci = d.select(*keys, (total("_s") / total("_n")).alias("_m")).groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    whole = c.groupBy(*keys).agg(F.count("*").alias("clusters"), (F.sum("_s") / F.sum("_n")).alias("mean"))
    enough = F.col("clusters") >= 2
    return whole.join(ci, keys).select(*keys, "clusters", "mean", F.when(enough, F.col("_q")[0]).alias("low"), F.when(enough, F.col("_q")[1]).alias("high"))


def exact_tail(n: int, w: float) -> float:
    """Two-sided p of the signed-rank sum without ties."""
    counts = [1]
    for k in range(1, n + 1):
        new = counts + [0] * k
        for i, c in enumerate(counts):
            new[i + k] += c
        counts = new
    low = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(counts[: int(low) + 1]) / 2**n)


def signed_rank(df: DataFrame, keys: list[str], d: str, exact_up_to: int = 50, rows: int = ROWS) -> DataFrame:
    """Signed-rank test of differences, zeros dropped: ranks in Spark, the p of each group's sums from them."""
    x = df.filter(F.col(d).isNotNull() & (F.col(d) != 0)).withColumn("_a", F.abs(d))
    v = value_ranks(x, keys, "_a", {"pos": F.when(F.col(d) > 0, 1).otherwise(0)}, rows)
    c = F.col("n")
    g = v.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(c * c * c - c).alias("ties")).withColumnRenamed("_n", "n")

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(n, w, t, strict=True):
            if a <= exact_up_to and c == 0:
                out.append(exact_tail(int(a), float(b)))
            else:
                sd = math.sqrt(max(a * (a + 1) * (2 * a + 1) / 24 - c / 48, 1e-12))
                out.append(math.erfc(abs(b - a * (a + 1) / 4) / sd / math.sqrt(2)))
        return pd.Series(out)

    return g.select(*keys, "n", "w_plus", p("n", "w_plus", "ties").alias("p"))


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row with least total cost, rows added one by one: each takes the cheapest way that moves rows before it to other columns, by
    prices that keep all reduced costs from 0 on; cubic in the number of rows."""
    n = len(cost)
    row_price, col_price, taken = np.zeros(n), np.zeros(n), np.full(n, -1)
    for new in range(n):
        dist, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, spent, last = new, 0.0, -1
        while True:
            step = spent + cost[row] - row_price[row] - col_price
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], last
            col = int(np.where(done, np.inf, dist).argmin())
            spent = dist[col]
            if taken[col] < 0:
                break
            done[col], row, last = True, taken[col], col
        row_price[new] += spent
        for c in np.flatnonzero(done):
            row_price[taken[c]] += spent - dist[c]
            col_price[c] -= spent - dist[c]
        while via[col] >= 0:
            taken[col] = taken[via[col]]
            col = via[col]
        taken[col] = new
    out = [0] * n
    for c, r in enumerate(taken.tolist()):
        out[r] = c
    return out


def fit_states(x: np.ndarray, w: np.ndarray, starts: np.ndarray, k: int, seed: int, rounds: int = 20, tol: float = 1e-4):
    """Diagonal-Gaussian hidden states by weighted EM over sequences that begin at ``starts``. Returns parameters,
    posteriors and the log-likelihood of each round."""
    rng = np.random.default_rng(seed)
    n, f = x.shape
    mean = x[rng.choice(n, k, replace=n < k)] + rng.normal(0, 0.01, (k, f))
    var, trans, first = np.tile(x.var(0) + 1e-2, (k, 1)), np.full((k, k), 0.2 / max(1, k - 1)), np.full(k, 1 / k)
    np.fill_diagonal(trans, 0.8 if k > 1 else 1.0)
    history, gamma = [], np.zeros((n, k))
    ends = [*starts[1:], n]
    for _ in range(rounds):
        e = -0.5 * ((w[:, None, :] * ((x[:, None, :] - mean) ** 2 / var + np.log(2 * np.pi * var))).sum(2))
        total, pair, begin = 0.0, np.zeros((k, k)), np.zeros(k)
        for s, t in zip(starts, ends, strict=True):
            b = np.exp(e[s:t] - e[s:t].max(1, keepdims=True))
            al, be, c = np.empty_like(b), np.ones_like(b), np.empty(t - s)
            for i in range(t - s):
                a = first * b[0] if i == 0 else (al[i - 1] @ trans) * b[i]
                c[i] = a.sum()
                al[i] = a / c[i]
            for i in range(t - s - 2, -1, -1):
                be[i] = trans @ (b[i + 1] * be[i + 1]) / c[i + 1]
            g = al * be
            gamma[s:t] = g / g.sum(1, keepdims=True)
            for i in range(t - s - 1):
                pair += al[i][:, None] * trans * (b[i + 1] * be[i + 1])[None] / c[i + 1]
            begin += gamma[s]
            total += float(np.log(c).sum() + e[s:t].max(1).sum())
        history.append(total)
        gw = gamma[:, :, None] * w[:, None, :]
        mass = gw.sum(0) + 1e-9
        mean = (gw * x[:, None, :]).sum(0) / mass
        var = np.maximum((gw * (x[:, None, :] - mean) ** 2).sum(0) / mass, 1e-3)
        trans = (pair + 1e-3) / (pair + 1e-3).sum(1, keepdims=True)
        first = begin / begin.sum()
        if len(history) > 1 and history[-1] - history[-2] < tol * abs(history[-2]):
            break
    return {"mean": mean, "var": var, "trans": trans, "first": first}, gamma, history


def state_grid(df: DataFrame, group: str, order: list[str], features: list[str], weights: list[str], states: list[int], seeds: list[int]) -> DataFrame:
    """Fits of a grid of state counts and seeds, one task for each cell; every cell reads the (bounded) training rows.
    Rows: states, seed, log_likelihood, rounds, largest state share."""
    data = df.select(group, *order, *features, *weights).withColumn("_c", F.explode(F.array(*[F.lit(i) for i in range(len(states) * len(seeds))])))
    grid = list(itertools.product(states, seeds))

    def cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, seed = grid[key[0]]
        pdf = pdf.sort_values([group, *order], kind="stable")
        x = pdf[features].to_numpy(float)
        w = np.clip(np.nan_to_num(pdf[weights].to_numpy(float)), 0, 1) * np.isfinite(x)
        g = pdf[group].to_numpy()
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        _, gamma, history = fit_states(np.nan_to_num(x), w, starts, k, seed)
        return pd.DataFrame([(k, seed, history[-1], len(history), float(gamma.mean(0).max()))], columns=["states", "seed", "log_likelihood", "rounds", "largest_share"])

    return data.groupBy("_c").applyInPandas(cell, "states int, seed int, log_likelihood double, rounds int, largest_share double")
