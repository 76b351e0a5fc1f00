"""Every registered telemetry query against its SQL, and those without SQL against plain computations."""

import glob
import itertools
import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from conftest import DATA
from roomlens.operators import models, predict
from roomlens.plans import catalogue, study
from roomlens.plans.adapters import obs


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            try:
                return round(float(x), 6)
            except (TypeError, ValueError):
                return str(x)
        return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def views(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def scales(data):
    """The smallest tables, and larger ones for queries that have no rows there."""
    larger = data.replace("sf0.001", "sf0.01")
    return [(data, views(data)), (larger, views(larger))]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, scales, name):
    for folder, duck in scales:
        ours, sql = catalogue.QUERIES[name](spark, folder).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(ours.columns) == sorted(sql.columns)
        assert rows(ours) == rows(sql)
        if len(ours):
            return
    raise AssertionError("no rows at either scale")


def frame(spark, data, name):
    return catalogue.QUERIES[name](spark, data).toPandas()


def test_every_query_is_tested():
    tested = {"bootstrap_interval", "weekly_bootstrap", "record_json", "signed_rank_test", "hidden_state_grid", "hidden_state_cv", "nuisance_predictability", "spectral_features", "short_frame_features", "room_timeline", "response_intervals", "counterfactual_interval", "hidden_state_stability", "hidden_state_paths", "activity_regions", "boundary_coupling_tests", "boundary_coupling_interval"}
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == tested


def test_bootstrap_intervals_hold_the_mean_and_have_the_right_width(spark, data):
    o = obs(spark, data).filter("metric is not null").selectExpr("session_id", "date(start_dt) AS date", "metric").toPandas()
    plain = o.groupby(["session_id", "date"])["metric"].mean().groupby("session_id")
    got = frame(spark, data, "bootstrap_interval").set_index("session_id")
    for k, v in plain:
        r = got.loc[k]
        assert r["n"] == len(v) and abs(r["mean"] - v.mean()) < 1e-5
        half = 1.96 * v.std(ddof=0) / len(v) ** 0.5
        assert abs(r["low"] - (v.mean() - half)) < 0.15 * half and abs(r["high"] - (v.mean() + half)) < 0.15 * half
    w = frame(spark, data.replace("sf0.001", "sf0.01"), "weekly_bootstrap")
    assert len(w) and (w["n"] >= 2).all() and ((w["low"] <= w["mean"]) & (w["mean"] <= w["high"])).all()


def test_response_intervals(spark, data):
    larger = data.replace("sf0.001", "sf0.01")
    d = study.daily_differences(spark, larger).toPandas()
    got = frame(spark, larger, "response_intervals").set_index(["feature", "phase"])
    assert len(got) == 6
    for k, own in d.groupby(["feature", "phase"]):
        means = own.groupby("session_id")["d"].agg(["sum", "count"])
        each = [sum(means["sum"][i] for i in c) / sum(means["count"][i] for i in c) for c in itertools.product(means.index, repeat=len(means))]
        r = got.loc[k]
        assert r["clusters"] == len(means) and r["event_days"] == len(own) and abs(r["mean"] - own["d"].mean()) < 1e-5
        low, high = np.quantile(np.repeat(each, 200), [0.025, 0.975])  # every draw of clusters is as likely
        assert abs(r["low"] - low) < 0.2 * (high - low) + 1e-5 and abs(r["high"] - high) < 0.2 * (high - low) + 1e-5
        half = 1.96 * own["d"].std(ddof=0) / len(own) ** 0.5
        assert abs(r["day_low"] - (r["mean"] - half)) < 0.4 * half and abs(r["day_high"] - (r["mean"] + half)) < 0.4 * half
        assert np.isnan(r["p"]) == (len(own) < 5)
    for _, own in got.groupby("phase"):  # adjusted over the features of a phase
        p = own["p"].dropna().sort_values()
        q = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(upper=1)
        assert np.allclose(own.loc[p.index, "q"], q, atol=2e-6)


def test_signed_ranks_by_enumeration(spark):
    d = [0.5, -1.0, 2.0, 3.0, -4.0, 6.0, 0.0, 7.5]
    r = models.signed_rank(spark.createDataFrame([("a", x) for x in d], "k string, d double"), ["k"], "d").first()
    v = sorted((x for x in d if x), key=abs)
    plus = sum(i + 1 for i, x in enumerate(v) if x > 0)
    sums = [sum((i + 1) * s for i, s in enumerate(signs)) for signs in itertools.product((0, 1), repeat=len(v))]
    low = min(plus, sum(range(1, len(v) + 1)) - plus)
    assert r["n"] == len(v) and r["w_plus"] == plus and abs(r["p"] - min(1, 2 * sum(s <= low for s in sums) / len(sums))) < 1e-9
    assert len(frame(spark, DATA, "signed_rank_test")) == 2


def test_frames_by_numpy(spark, data):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    long, short = frame(spark, data, "spectral_features").set_index("frame"), frame(spark, data, "short_frame_features").set_index("frame")
    assert set(long.index) == set(e) == set(short.index)
    last = {}
    for k in sorted(e):
        x = e[k]
        m = np.abs(np.fft.rfft(x * np.hanning(len(x))))
        f = np.fft.rfftfreq(len(x), 1 / 22050)
        p = m * m
        assert abs(long.loc[k, "rms"] - np.sqrt((x * x).mean())) < 1e-4 and abs(long.loc[k, "centroid"] - (f * m).sum() / m.sum()) < 1e-2
        s = short.loc[k]
        assert s["dominant"] == round(f[m.argmax()], 6) and abs(s["band_2_5khz"] - p[(f >= 2000) & (f <= 5000)].sum() / p.sum()) < 1e-5
        bands = np.array([b.sum() for b in np.array_split(p, 10)]) / p.sum()
        assert abs(s["energy_entropy"] + (bands * np.log(bands + 1e-12)).sum() / np.log(10)) < 1e-5
        n, media = m / m.sum(), s["media_id"]
        assert abs(s["flux"] - (np.sqrt(((n - last[media]) ** 2).sum()) if media in last else 0.0)) < 1e-5
        last[media] = n


def test_records_timelines_and_states(spark, data):
    r = frame(spark, data, "record_json")
    assert len(r) == 90 and (r["errors"] == "").all() and all(isinstance(json.loads(x), dict) for x in r["record"])
    t = frame(spark, data, "room_timeline")
    assert len(t) == 3 and all(len(json.loads(x)) == n > 0 for x, n in zip(t["timeline"], t["frames"]))
    g = frame(spark, data, "hidden_state_grid")
    assert sorted(zip(g["states"], g["seed"])) == [(2, 1), (2, 2), (3, 1), (3, 2)] and np.isfinite(g["log_likelihood"]).all()


def test_hidden_state_folds(spark, data, tmp_path):
    g = frame(spark, data, "hidden_state_cv")
    assert len(g) == 99 and set(g["states"]) == set(range(2, 13)) and (g["train_rows"] + g["test_rows"]).nunique() == 1 and np.isfinite(g["test_ll_per_row"]).all()
    best = g.groupby("states")["train_ll"].max()
    assert best[12] > best[2]
    assert (g["min_occupancy"] <= 1 / g["states"] + 1e-5).all() and g.groupby("fold")["test_rows"].nunique().eq(1).all()


def test_hidden_state_stability_and_paths(spark, data):
    s = frame(spark, data, "hidden_state_stability")
    assert sorted(s["states"]) == [2, 3, 4, 6, 8] and (s["pairs"] == 9).all() and ((s["least_ari"] <= s["median_ari"]) & (s["median_ari"] <= 1)).all()
    p = frame(spark, data, "hidden_state_paths")
    days = p.groupby(["session_id", "date"]).size()
    assert (days == 3).all() and p.groupby(["session_id", "date"])["held_out"].sum().eq(1).all()  # each day is held out of one fold
    assert (p["changes"] < p["rows"]).all() and ((p["commonest"] > 0) & (p["commonest"] <= 1)).all() and (p["certainty"] >= 0.25).all()


def test_predictability(spark, data):
    r = np.random.default_rng(0)
    rows = [(g, "ab"[g % 2], "xy"[g % 2], float(r.normal())) for g in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "g int, label string, c string, v double")
    told = predict.predictability(df, "label", "g", ["c"], ["v"], folds=3).toPandas()
    blind = predict.predictability(df, "label", "g", [], ["v"], folds=3).toPandas()
    assert (told["balanced_accuracy"] == 1).all() and (told["chance"] == 0.5).all() and told["n"].sum() == 180 and (blind["balanced_accuracy"] < 0.75).all()
    assert predict.predictability(df.filter("label = 'a'"), "label", "g", ["c"], ["v"], folds=3).count() == 0
    n = frame(spark, data, "nuisance_predictability")
    assert n["n"].sum() == 1000 and ((n["balanced_accuracy"] > 0.02) & (n["balanced_accuracy"] < 0.6)).all()
