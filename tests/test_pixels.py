"""Regions of pixel tables against plain flood fills."""

import numpy as np
import pytest

from roomlens.operators import pixels
from roomlens.plans import catalogue, regions


def flood(mask, diagonal):
    """Labels by flood fill: for each pixel of the mask the first pixel (y, x) of its component."""
    out, (h, w) = {}, mask.shape
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (diagonal or 0 in (i, j))]
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in out:
            continue
        todo, out[y, x] = [(y, x)], (y, x)
        while todo:
            a, b = todo.pop()
            for i, j in steps:
                p = (a + i, b + j)
                if 0 <= p[0] < h and 0 <= p[1] < w and mask[p] and p not in out:
                    out[p] = (y, x)
                    todo.append(p)
    return out


def table(spark, masks):
    return spark.createDataFrame([(k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))], "image string, x int, y int")


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(1)
    spiral = np.zeros((23, 23), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    return {"a": rng.random((40, 31)) < 0.55, "b": rng.random((30, 50)) < 0.4, "c": np.ones((9, 5), bool), "s": spiral, "d": np.eye(20, dtype=bool)}


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("strip", [7, 64])
def test_components_are_those_of_flood_fill(spark, masks, diagonal, strip, monkeypatch):
    monkeypatch.setattr(pixels, "STRIP", strip)
    runs = pixels.labelled_runs(table(spark, masks), diagonal)
    got = {(r["image"], r["y"], x): (r["label"]["fy"], r["label"]["fx"]) for r in runs.collect() for x in range(r["lo"], r["hi"] + 1)}
    assert got == {(k, *p): v for k, m in masks.items() for p, v in flood(m, diagonal).items()}
    if strip == 7:
        for r in pixels.regions(runs).collect():
            own = [p for p, v in got.items() if p[0] == r["image"] and v == (r["label_y"], r["label_x"])]
            ys, xs = [p[1] for p in own], [p[2] for p in own]
            assert (r["area"], r["left"], r["top"], r["width"], r["height"]) == (len(own), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)


def around(m, f, empty):
    p = np.pad(m, 1, constant_values=empty)
    return f([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)


def test_growing_and_shrinking(spark, masks):
    sizes = spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in masks.items()], "image string, width int, height int")
    for name, want in (("grown", lambda m: around(m, np.any, False)), ("shrunk", lambda m: around(m, np.all, True)), ("closed", lambda m: around(around(m, np.any, False), np.all, True))):
        got = {tuple(r) for r in getattr(pixels, name)(table(spark, masks), sizes).collect()}
        assert got == {(k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(want(m)))}, name


def test_zones_that_outlines_enclose(spark):
    """Two outlined boxes of one colour, one with a gap that closing fills, one open; one of another colour; one too small; noise of the photograph."""
    h, w, red = 70, 90, (255, 0, 0)
    base = np.random.default_rng(0).integers(90, 110, (h, w, 3))
    paint = base.copy()

    def box(x, y, a, b, colour, gap=0):
        for k in range(2):
            paint[y + k, x : x + a] = paint[y + b - 1 - k, x : x + a] = paint[y : y + b, x + k] = paint[y : y + b, x + a - 1 - k] = colour
        paint[y : y + 2, x + 6 : x + 6 + gap] = base[y : y + 2, x + 6 : x + 6 + gap]

    box(5, 4, 25, 20, (250, 10, 5))
    box(45, 30, 30, 30, red, gap=2)
    box(40, 4, 20, 20, red, gap=9)
    box(5, 40, 20, 20, (0, 0, 255))
    box(70, 4, 9, 9, red)
    rows = lambda p: spark.createDataFrame([("i", x, y, *map(int, p[y, x])) for y in range(h) for x in range(w)], "image string, x int, y int, r int, g int, b int")
    got = [(r["left"], r["top"], r["width"], r["height"], r["area"]) for r in pixels.zones_of_colour(rows(base), rows(paint), red).orderBy("place").collect()]
    mask = (np.abs(paint - base).sum(2) > 20) & (np.abs(paint - np.array(red)) <= 25).all(2)
    outline = around(around(around(mask, np.any, False), np.all, True), np.any, False)
    parts = flood(~outline, False)
    out = {v for (y, x), v in parts.items() if y in (0, h - 1) or x in (0, w - 1)}
    inside = np.zeros((h, w), bool)
    for p, v in parts.items():
        inside[p] = v not in out
    want = []
    labels = flood(inside, True)
    for v in sorted(set(labels.values())):
        own = np.array([p for p, q in labels.items() if q == v])
        (t, l), (b, r) = own.min(0), own.max(0)
        if len(own) >= 120 and min(r - l, b - t) + 1 >= 10:
            want.append((int(l), int(t), int(r - l + 1), int(b - t + 1), len(own)))
    assert got == sorted(want, key=lambda z: (z[1], z[0])) and len(got) == 2
    assert pixels.zones_of_colour(rows(base), rows(base), red).count() == 0
    assert pixels.labelled_runs(rows(base).select("image", "x", "y").limit(0), True).count() == 0


def test_activity_regions(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    r = regions.raster(spark, folder).toPandas()
    got = {tuple(x) for x in catalogue.QUERIES["activity_regions"](spark, folder).select("image", "label_y", "label_x", "area", "left", "top", "width", "height").collect()}
    want = set()
    for k, own in r.groupby("image"):
        m = np.zeros((own["y"].max() + 1, own["x"].max() + 1), bool)
        hot = own[own["n"] >= regions.ACTIVE]
        m[hot["y"], hot["x"]] = True
        labels = flood(around(around(m, np.any, False), np.all, True), True)
        for v in set(labels.values()):
            p = np.array([q for q, w in labels.items() if w == v])
            (t, l), (b, e) = p.min(0), p.max(0)
            want.add((k, int(v[0]), int(v[1]), len(p), int(l), int(t), int(e - l + 1), int(b - t + 1)))
    assert got == want and len(got) > 3
