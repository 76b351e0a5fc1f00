"""Session-blocked cross-validation of hidden-state models: every round is one Spark job over the sequences.

A sequence (one row: its values and weights in order) is held by one task; tasks add up the expected counts of all cells of the
grid over their sequences, and these sums, whose number does not depend on the rows, meet by cell. The driver keeps the
parameters only."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import assign
from .shared import cut


def posteriors(x: np.ndarray, w: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of one sequence (T, D) under several models side by side: mean and var (C, K, D), trans (C, K, K), first
    (C, K). State probabilities (T, C, K), expected changes (C, K, K), log-likelihoods (C); a missing value is 0 with weight 0."""
    t, (c, k, d) = len(x), p["mean"].shape
    diff = x[:, None, None, :] - p["mean"]
    e = -0.5 * (w[:, None, None, :] * (diff**2 / p["var"] + np.log(2 * np.pi * p["var"]))).sum(-1)
    top = e.max(-1)
    b = np.exp(e - top[..., None])
    al, be, norm = np.empty_like(b), np.ones_like(b), np.empty((t, c))
    for i in range(t):
        a = p["first"] * b[0] if i == 0 else np.einsum("ck,ckj->cj", al[i - 1], p["trans"]) * b[i]
        norm[i] = a.sum(-1)
        al[i] = a / norm[i][:, None]
    for i in range(t - 2, -1, -1):
        be[i] = np.einsum("ckj,cj->ck", p["trans"], b[i + 1] * be[i + 1]) / norm[i + 1][:, None]
    g = al * be
    g /= g.sum(-1, keepdims=True)
    pair = np.einsum("tck,ckj,tcj->ckj", al[:-1], p["trans"], b[1:] * be[1:] / norm[1:, :, None]) if t > 1 else np.zeros((c, k, k))
    return g, pair, np.log(norm).sum(0) + top.sum(0)


def expected(x: np.ndarray, w: np.ndarray, p: dict) -> dict:
    """Log-likelihoods (C) and expected counts of one sequence."""
    g, pair, ll = posteriors(x, w, p)
    gw = g[..., None] * w[:, None, None, :]
    return {"ll": ll, "first": g[0], "trans": pair, "stay": g.sum(0), "mass": gw.sum(0), "sx": (gw * x[:, None, None, :]).sum(0), "sxx": (gw * x[:, None, None, :] ** 2).sum(0)}


def start(k: int, d: int, seed: int) -> dict:
    """First parameters of a model of scaled values: means drawn around 0, unit variances, states that mostly stay."""
    r = np.random.default_rng(seed)
    trans = np.full((k, k), 0.2 / max(1, k - 1))
    np.fill_diagonal(trans, 0.8 if k > 1 else 1.0)
    return {"mean": r.normal(0, 1, (k, d)), "var": np.ones((k, d)), "trans": trans, "first": np.full(k, 1 / k)}


def improve(s: dict) -> dict:
    """Parameters from the sums of expected counts."""
    mass = s["mass"] + 1e-9
    mean = s["sx"] / mass
    trans = s["trans"] + 1e-3
    return {"mean": mean, "var": np.maximum(s["sxx"] / mass - mean**2, 1e-3), "trans": trans / trans.sum(-1, keepdims=True), "first": s["first"] / max(s["first"].sum(), 1e-300)}


_PARTS = ("mean", "var", "trans", "first")


def _flat(p: dict) -> list[float]:
    return np.concatenate([p[n].ravel() for n in _PARTS]).tolist()


def _shaped(v: list[float], k: int, d: int) -> dict:
    v, out = np.array(v), {}
    for n, shape in zip(_PARTS, ((k, d), (k, d), (k, k), (k,)), strict=True):
        size = int(np.prod(shape))
        out[n], v = v[:size].reshape(shape), v[size:]
    return out


@dataclass
class Fits:
    """Fitted cells of a grid (states, fold, seed) and what they were fitted to: ``data`` holds the sequences, a fold's values are scaled by the others' centre and deviation."""

    data: DataFrame
    folds: int
    center: np.ndarray
    scale: np.ndarray
    sizes: dict[int, int]
    cells: dict[tuple[int, int, int], dict]

    @property
    def dims(self) -> int:
        return self.center.shape[1]

    def trained(self, fold: int) -> int:
        """Rows outside a fold."""
        return sum(n for g, n in self.sizes.items() if g != fold)

    def todo(self) -> list[tuple[int, int, int]]:
        return [c for c in self.cells if self.trained(c[1])]

    def each(self, todo: list[tuple[int, int, int]], use: Callable, shape: str, columns: list[str] = []) -> DataFrame:
        """One Spark job over the sequences: ``use`` gets an iterator of (key, fold, (states, fold), seeds, values, weights, parameters) of a task, where key is the tuple of
        ``columns``, and yields rows of ``shape``."""
        groups: dict = {}
        for k, f, s in todo:
            groups.setdefault((k, f), []).append(s)
        sent = self.data.sparkSession.sparkContext.broadcast({g: (own, {n: np.stack([self.cells[(*g, s)]["p"][n] for s in own]) for n in _PARTS}) for g, own in groups.items()})
        center, scale, names = self.center, self.scale, [x.split()[0] for x in shape.split(", ")]

        def sequences(it: Iterator[pd.DataFrame]) -> Iterator[tuple]:
            for pdf in it:
                for key, fold, xs, ws in zip(zip(*[pdf[c] for c in columns]) if columns else [()] * len(pdf), pdf["fold"], pdf["x"], pdf["w"], strict=True):
                    x, w = np.array([np.array(v, float) for v in xs]), np.array([np.array(v, float) for v in ws])
                    if len(x):
                        w = np.where(np.isfinite(x) & np.isfinite(w), np.clip(w, 0, 1), 0.0)
                        for (k, f), (own, p) in sent.value.items():
                            yield key, fold, (k, f), own, np.where(w > 0, (x - center[f]) / scale[f], 0.0), w, p

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = []
            for r in use(sequences(it)):
                rows.append(r)
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

        return self.data.select(*columns, "fold", "x", "w").mapInPandas(run, shape)

    def measure(self, todo: list[tuple[int, int, int]], held_out: bool) -> dict:
        """Summed expected counts of the cells over the sequences outside their fold, or in it."""
        def use(sequences: Iterator[tuple]) -> Iterator[tuple]:
            total: dict = {}
            for _, fold, (k, f), own, x, w, p in sequences:
                if (fold == f) == held_out:
                    got = expected(x, w, p)
                    if (k, f) in total:
                        for n, v in got.items():
                            total[k, f][1][n] += v
                    else:
                        total[k, f] = (own, got)
            for (k, f), (own, got) in total.items():
                for i, s in enumerate(own):
                    for n, a in got.items():
                        for j, v in enumerate(a[i].ravel()):
                            yield k, f, s, n, j, float(v)

        found = self.each(todo, use, "k int, f int, s int, part string, j int, v double").groupBy("k", "f", "s", "part", "j").agg(F.sum("v").alias("v")).collect()
        out: dict = {}
        for r in sorted(found, key=lambda r: r["j"]):
            out.setdefault((r["k"], r["f"], r["s"]), {}).setdefault(r["part"], []).append(r["v"])
        d = self.dims
        shapes = lambda k: {"ll": (), "first": (k,), "trans": (k, k), "stay": (k,), "mass": (k, d), "sx": (k, d), "sxx": (k, d)}
        return {c: {n: np.array(v).reshape(shapes(c[0])[n]) for n, v in got.items()} for c, got in out.items()}


def fit(sequences: DataFrame, states: list[int], folds: int, seeds: list[int], rounds: int = 20, tol: float = 1e-4, resume: str | None = None) -> Fits:
    """``sequences``: (fold int, x array<array<double>>, w array<array<double>>), a row each; other columns stay with them. For each state count, fold and seed a model is
    fitted to the sequences of the other folds. ``resume``: a shared folder where the parameters are written after each round, and read again by a run that begins anew."""
    spark = sequences.sparkSession
    data = cut(sequences)
    flat = data.select("fold", F.explode(F.arrays_zip("x", "w")).alias("r")).select("fold", F.posexplode(F.arrays_zip("r.x", "r.w")).alias("d", "v")).select("fold", "d", F.col("v.x").alias("x"), F.col("v.w").alias("w"))
    ok = (F.col("w") > 0) & F.col("x").isNotNull() & ~F.isnan("x")
    sums = flat.filter(ok).groupBy("fold", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n")).collect()
    sizes = {r["fold"]: r["n"] for r in data.groupBy("fold").agg(F.sum(F.size("x")).alias("n")).collect()}
    dims = 1 + max((r["d"] for r in sums), default=0)
    center, scale = np.zeros((folds, dims)), np.ones((folds, dims))
    for f, j in itertools.product(range(folds), range(dims)):
        own = [r for r in sums if r["fold"] != f and r["d"] == j]
        n = sum(r["n"] for r in own)
        if n:
            center[f, j] = sum(r["s"] for r in own) / n
            scale[f, j] = max(np.sqrt(max(sum(r["q"] for r in own) / n - center[f, j] ** 2, 0.0)), 1e-6)
    cells = {(k, f, s): {"p": start(k, dims, s + 100 * f + 10 * k), "ll": -np.inf, "rounds": 0, "done": False} for k in states for f in range(folds) for s in seeds}
    fits, at = Fits(data, folds, center, scale, sizes, cells), 0
    if resume:
        try:
            known = spark.read.parquet(f"{resume}/*")
            at = known.agg(F.max("round")).first()[0]
            for r in known.filter(F.col("round") == at).collect():
                if (r["k"], r["f"], r["s"]) in cells:
                    cells[r["k"], r["f"], r["s"]] = {"p": _shaped(r["p"], r["k"], dims), "ll": r["ll"], "rounds": r["rounds"], "done": r["done"]}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    while at < rounds:
        todo = [c for c in fits.todo() if not cells[c]["done"]]
        if not todo:
            break
        at += 1
        for c, got in fits.measure(todo, False).items():
            x, ll = cells[c], float(got["ll"])
            x.update(p=improve(got), done=bool(ll - x["ll"] < tol * abs(ll)), ll=ll, rounds=at)
        if resume:
            rows = [(at, *c, x["ll"], x["rounds"], x["done"], _flat(x["p"])) for c, x in cells.items()]
            spark.createDataFrame(rows, "round int, k int, f int, s int, ll double, rounds int, done boolean, p array<double>").coalesce(1).write.mode("overwrite").parquet(f"{resume}/{at}")
    return fits


def scores(fits: Fits) -> DataFrame:
    """Rows: states, fold, seed, rounds, train_ll, train_rows, test_ll, test_rows, test_ll_per_row, train_bic, min_occupancy (the smallest share of the training rows that a state
    has); both likelihoods are those of the final parameters. Folds without rows to train on or to score have nulls."""
    train, test, rows = fits.measure(fits.todo(), False), fits.measure(fits.todo(), True), []
    for c, x in fits.cells.items():
        k, f, _ = c
        m, n, own, their = fits.trained(f), fits.sizes.get(f, 0), train.get(c), test.get(c)
        ll, out = float(own["ll"]) if own else None, float(their["ll"]) if their else None
        free = 2 * k * fits.dims + k * (k - 1) + k - 1
        rows.append((*c, x["rounds"], ll, m, out, n, out / n if their and n else None, free * float(np.log(m)) - 2 * ll if own else None, float(own["stay"].min() / own["stay"].sum()) if own else None))
    return fits.data.sparkSession.createDataFrame(rows, "states int, fold int, seed int, rounds int, train_ll double, train_rows long, test_ll double, test_rows long, test_ll_per_row double, train_bic double, min_occupancy double")


def cross_validated(sequences: DataFrame, states: list[int], folds: int, seeds: list[int], rounds: int = 20, tol: float = 1e-4, resume: str | None = None) -> DataFrame:
    """``scores`` of ``fit``."""
    return scores(fit(sequences, states, folds, seeds, rounds, tol, resume))


def paths(fits: Fits, columns: list[str]) -> DataFrame:
    """(columns, states, fold, seed, held_out, path array<int>, top array<double>): the likeliest state of each row of a sequence under each cell, and its probability."""
    def use(sequences: Iterator[tuple]) -> Iterator[tuple]:
        for key, fold, (k, f), own, x, w, p in sequences:
            g, _, _ = posteriors(x, w, p)
            for i, s in enumerate(own):
                yield (*key, k, f, s, bool(fold == f), g[:, i].argmax(1).tolist(), g[:, i].max(1).tolist())

    kinds = dict(fits.data.dtypes)
    return fits.each(fits.todo(), use, ", ".join([*[f"{c} {kinds[c]}" for c in columns], "states int, fold int, seed int, held_out boolean, path array<int>, top array<double>"]), columns)


def matched_profiles(a: np.ndarray, b: np.ndarray) -> float:
    """Median correlation of the means of states that are matched by least total distance; states without variation do not count."""
    way = assign(np.sqrt(((b[:, None] - a[None]) ** 2).sum(-1)))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = [np.corrcoef(b[i], a[j])[0, 1] for i, j in enumerate(way)] if a.shape[1] > 1 else []
    r = [v for v in r if np.isfinite(v)]
    return float(np.median(r)) if r else float("nan")


def stability(fits: Fits) -> DataFrame:
    """(states, fold, seed_a, seed_b, rows, ari, profile_correlation): for each two seeds of a cell, how far the likeliest states of the training rows agree, whatever their
    numbers, and how alike the matched states are. One job counts the states that meet, for all pairs of seeds at once; only these counts are shuffled."""
    def use(sequences: Iterator[tuple]) -> Iterator[tuple]:
        total: dict = {}
        for _, fold, (k, f), own, x, w, p in sequences:
            if fold != f:
                hard = posteriors(x, w, p)[0].argmax(-1)
                for i, j in itertools.combinations(range(len(own)), 2):
                    m = np.bincount(hard[:, i] * k + hard[:, j], minlength=k * k)
                    key = (k, f, own[i], own[j])
                    total[key] = total[key] + m if key in total else m
        for (k, f, a, b), m in total.items():
            for at in np.flatnonzero(m).tolist():
                yield k, f, a, b, at // k, at % k, int(m[at])

    keys = ["states", "fold", "seed_a", "seed_b"]
    met = fits.each(fits.todo(), use, "states int, fold int, seed_a int, seed_b int, i int, j int, n long").groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    sides = [met.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(two("n").alias(f"of_{c}")) for c in "ij"]
    both = met.groupBy(*keys).agg(two("n").alias("both"), F.sum("n").alias("rows")).join(sides[0], keys).join(sides[1], keys)
    by_chance = F.try_divide(F.col("of_i") * F.col("of_j"), F.col("rows") * (F.col("rows") - 1) / 2.0)
    ari = F.coalesce(F.try_divide(F.col("both") - by_chance, (F.col("of_i") + F.col("of_j")) / 2 - by_chance), F.lit(1.0))
    means = {c: x["p"]["mean"] for c, x in fits.cells.items()}
    alike = [(k, f, a, b, matched_profiles(means[k, f, a], means[k, f, b])) for k, f in sorted({c[:2] for c in fits.todo()}) for a, b in itertools.combinations(sorted(s for *g, s in means if g == [k, f]), 2)]
    pairs = both.sparkSession.createDataFrame(alike, "states int, fold int, seed_a int, seed_b int, profile_correlation double")
    found = both.select("states", "fold", F.least("seed_a", "seed_b").alias("seed_a"), F.greatest("seed_a", "seed_b").alias("seed_b"), "rows", ari.alias("ari"))
    return found.join(F.broadcast(pairs), keys)  # a row for each pair of seeds of a cell
