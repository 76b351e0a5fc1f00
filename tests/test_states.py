"""Hidden states by rounds of Spark jobs: against enumeration, planted states, and a run that resumes."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from roomlens.operators import models, states


def test_expected_counts_by_enumeration():
    r = np.random.default_rng(0)
    p = {n: np.stack([states.start(2, 2, s)[n] for s in (1, 2)]) for n in ("mean", "var", "trans", "first")}
    x, w = r.normal(0, 1, (4, 2)), np.array([[1, 1], [0, 1], [0.5, 0], [1, 1]], float)
    got = states.expected(x, w, p)
    for c in range(2):
        e = [[np.exp(-0.5 * (w[t] * ((x[t] - p["mean"][c, k]) ** 2 / p["var"][c, k] + np.log(2 * np.pi * p["var"][c, k]))).sum()) for k in range(2)] for t in range(4)]
        way = {z: p["first"][c, z[0]] * e[0][z[0]] * np.prod([p["trans"][c, z[t - 1], z[t]] * e[t][z[t]] for t in range(1, 4)]) for z in itertools.product(range(2), repeat=4)}
        total = sum(way.values())
        assert abs(got["ll"][c] - np.log(total)) < 1e-9
        assert abs(got["first"][c, 0] - sum(v for z, v in way.items() if z[0] == 0) / total) < 1e-9
        assert abs(got["trans"][c, 0, 1] - sum(v * sum(z[t - 1 : t + 1] == (0, 1) for t in range(1, 4)) for z, v in way.items()) / total) < 1e-9
        assert abs(got["sx"][c, 1, 0] - sum(v * sum(w[t, 0] * x[t, 0] for t in range(4) if z[t] == 1) for z, v in way.items()) / total) < 1e-9


def planted(spark, n=24, t=30):
    r, rows = np.random.default_rng(3), []
    for i in range(n):
        z = 0
        xs = []
        for _ in range(t):
            z = z if r.random() < 0.9 else 1 - z
            xs.append([float(r.normal(6 * z, 1)), None if r.random() < 0.1 else float(r.normal(-4 * z, 1))])
        rows.append((i % 3, xs, [[1.0, 1.0]] * t))
    return spark.createDataFrame(rows, "fold int, x array<array<double>>, w array<array<double>>")


def test_planted_states_score_best_and_a_run_resumes(spark, tmp_path):
    df = planted(spark)
    whole = states.cross_validated(df, [1, 2], 3, [1, 2], rounds=8).toPandas().sort_values(["states", "fold", "seed"]).reset_index(drop=True)
    by = whole.groupby("states")["test_ll_per_row"].mean()
    assert len(whole) == 12 and by[2] > by[1] + 0.5 and (whole["train_rows"] == 480).all() and (whole["test_rows"] == 240).all()
    path = str(tmp_path / "run")
    states.cross_validated(df, [1, 2], 3, [1, 2], rounds=3, resume=path)
    again = states.cross_validated(df, [1, 2], 3, [1, 2], rounds=8, resume=path).toPandas().sort_values(["states", "fold", "seed"]).reset_index(drop=True)
    assert np.allclose(again["test_ll"], whole["test_ll"]) and (again["rounds"] == whole["rounds"]).all()


def test_folds_without_rows(spark):
    df = planted(spark, 3, 5).filter("fold = 0")
    g = states.cross_validated(df, [2], 2, [1], rounds=2).toPandas().set_index("fold")
    assert g.loc[0, "train_rows"] == 0 and np.isnan(g.loc[0, "test_ll"]) and g.loc[1, "test_rows"] == 0 and np.isnan(g.loc[1, "test_ll_per_row"])
    assert states.cross_validated(df.limit(0), [2], 1, [1]).count() == 1


def test_stability_and_paths_by_plain_computation(spark):
    """Rand indices and matched profiles of all pairs of seeds against paths that are counted one by one."""
    df = planted(spark, 9, 20).withColumn("id", F.monotonically_increasing_id())
    fits = states.fit(df, [2, 3], 3, [1, 2, 5], rounds=4)
    got = {(r["states"], r["fold"], r["seed_a"], r["seed_b"]): r for r in states.stability(fits).collect()}
    way = {}
    for r in states.paths(fits, ["id"]).orderBy("id").collect():
        assert len(r["path"]) == 20 and all(1 / r["states"] <= v <= 1 + 1e-9 for v in r["top"])
        if not r["held_out"]:
            way.setdefault((r["states"], r["fold"], r["seed"]), []).extend(r["path"])
    assert len(got) == 2 * 3 * 3
    for (k, f, a, b), r in got.items():
        x, y = np.array(way[k, f, a]), np.array(way[k, f, b])
        same, alike = x[:, None] == x[None], y[:, None] == y[None]
        up = np.triu_indices(len(x), 1)
        p, q, t = same[up].sum(), alike[up].sum(), (same & alike)[up].sum()
        chance = p * q / len(up[0])
        assert r["rows"] == len(x) and abs(r["ari"] - ((t - chance) / ((p + q) / 2 - chance) if (p + q) / 2 != chance else 1.0)) < 1e-9
        m, n = fits.cells[k, f, a]["p"]["mean"], fits.cells[k, f, b]["p"]["mean"]
        best = min(itertools.permutations(range(k)), key=lambda z: sum(np.linalg.norm(n[i] - m[z[i]]) for i in range(k)))
        assert abs(r["profile_correlation"] - np.median([np.corrcoef(n[i], m[best[i]])[0, 1] for i in range(k)])) < 1e-9
    s = states.scores(fits).toPandas()
    free = 2 * s["states"] * 2 + s["states"] * (s["states"] - 1) + s["states"] - 1
    assert np.allclose(s["train_bic"], free * np.log(s["train_rows"]) - 2 * s["train_ll"]) and ((s["min_occupancy"] > 0) & (s["min_occupancy"] <= 1 / s["states"] + 1e-9)).all()


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(0)
    for t in range(200):
        n = r.integers(1, 7)
        c = r.normal(size=(n, n)) if t % 2 else r.integers(0, 4, (n, n)).astype(float)
        a = models.assign(c)
        assert sorted(a) == list(range(n)) and abs(sum(c[i, a[i]] for i in range(n)) - min(sum(c[i, z[i]] for i in range(n)) for z in itertools.permutations(range(n)))) < 1e-9
