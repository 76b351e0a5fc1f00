"""Regions of images that are tables of pixels: colour masks, growing and shrinking, connected components, what an outline encloses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small_or_plain, written

#: Rows of an image that one task labels.
STRIP = 64
#: What an annotation must differ from its reference by in all channels together, and at most from its colour in each (fixed values).
CHANGE, NEAR = 20, 25
#: Regions below these sizes are noise (fixed values).
LEAST_AREA, LEAST_SIDE = 120, 10


def colour_mask(reference: DataFrame, annotated: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    """(image, x, y) of the pixels that ``annotated`` (image, x, y, r, g, b) paints in a colour near ``target`` and ``reference`` has otherwise."""
    a = annotated.select("image", "x", "y", *[F.col(c).alias(f"a_{c}") for c in "rgb"])
    both = reference.select("image", "x", "y", *"rgb").join(a, ["image", "x", "y"])
    near = [F.abs(F.col(f"a_{c}") - t) <= NEAR for c, t in zip("rgb", target, strict=True)]
    return both.filter((sum((F.abs(F.col(f"a_{c}") - F.col(c)) for c in "rgb"), F.lit(0)) > CHANGE) & near[0] & near[1] & near[2]).select("image", "x", "y")


def _around(mask: DataFrame) -> DataFrame:
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    return mask.select("image", "x", "y", step).select("image", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"))


def _inside(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """``df`` within the images (image, width, height)."""
    return df.join(small_or_plain(sizes), "image").filter("x >= 0 and y >= 0 and x < width and y < height")


def grown(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pixels at most one step away, diagonals included."""
    return _inside(_around(mask), sizes).select("image", "x", "y").distinct()


def shrunk(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pixels of ``mask`` all whose neighbours in the image belong to it."""
    edge = lambda c, n: 3 - (F.col(c) == 0).cast("int") - (F.col(c) == F.col(n) - 1).cast("int")
    n = _inside(_around(mask), sizes).groupBy("image", "x", "y", "width", "height").agg(F.count("*").alias("n"))
    own = n.filter(F.col("n") == edge("x", "width") * edge("y", "height")).select("image", "x", "y")
    return own.join(mask, ["image", "x", "y"], "left_semi")


def closed(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    return shrunk(grown(mask, sizes), sizes)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the components of edges (a, b), label the least node. In rounds, every node takes the least label beside it and then that label's own."""
    e = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(e.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = e.join(label, e["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("node").alias("_n"), F.col("next").alias("_l"))
        new = written(step.join(jump, step["next"] == jump["_n"], "left").select("node", F.col("label").alias("before"), F.least("next", F.coalesce("_l", "next")).alias("label")))
        label = new.select("node", "label")
        if new.filter("before <> label").isEmpty():
            return label


def labelled_runs(mask: DataFrame, diagonal: bool) -> DataFrame:
    """(image, y, lo, hi, label): stretches of pixels of a row, and their component, named by its first pixel (y, x). ``diagonal``: corners connect.

    A task labels one strip of ``STRIP`` rows; strips are joined where runs meet at a seam, in rounds over the parts that touch one."""
    reach = int(diagonal)
    kind = dict(mask.dtypes)["image"]

    def strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["y", "x"]).sort_values(["y", "x"], kind="stable")
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        begin = np.flatnonzero(np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)])
        ys, lo, hi = y[begin], x[begin], x[np.r_[begin[1:] - 1, len(x) - 1]]
        root = list(range(len(ys)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        first = {v: int(np.searchsorted(ys, v)) for v in np.unique(ys).tolist()}
        for k in range(len(ys)):
            above = first.get(int(ys[k]) - 1)
            while above is not None and above < len(ys) and ys[above] == ys[k] - 1 and lo[above] <= hi[k] + reach:
                if hi[above] >= lo[k] - reach:
                    a, b = find(above), find(k)
                    root[max(a, b)] = min(a, b)
                above += 1
        at = np.array([find(k) for k in range(len(ys))])
        return pd.DataFrame({"image": [key[0]] * len(ys), "y": ys, "lo": lo, "hi": hi, "fy": ys[at], "fx": lo[at]})

    m = mask.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    runs = cut(m.groupBy("image", F.floor(F.col("y") / STRIP).alias("s")).applyInPandas(strip, f"image {kind}, y long, lo long, hi long, fy long, fx long"))
    runs = runs.withColumn("own", F.struct("image", "fy", "fx")).drop("fy", "fx")
    low = runs.filter(F.col("y") % STRIP == 0).select("image", F.col("y").alias("y"), F.col("lo").alias("l2"), F.col("hi").alias("h2"), F.col("own").alias("b"))
    top = runs.filter(F.col("y") % STRIP == STRIP - 1).select("image", (F.col("y") + 1).alias("y"), "lo", "hi", F.col("own").alias("a"))
    seams = written(top.join(low, ["image", "y"]).filter((F.col("lo") <= F.col("h2") + reach) & (F.col("hi") >= F.col("l2") - reach)).select("a", "b").distinct())
    if seams.isEmpty():
        return runs.select("image", "y", "lo", "hi", F.col("own").alias("label"))
    joined = small_or_plain(connected(seams).select(F.col("node").alias("own"), F.col("label").alias("joined")))
    return runs.join(joined, "own", "left").select("image", "y", "lo", "hi", F.coalesce("joined", "own").alias("label"))


def regions(runs: DataFrame) -> DataFrame:
    """(image, label_y, label_x, area, left, top, width, height) of each component."""
    r = runs.groupBy("image", "label").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("area"), F.min("lo").alias("left"), F.min("y").alias("top"), F.max("hi").alias("_r"), F.max("y").alias("_b"))
    return r.select("image", F.col("label.fy").alias("label_y"), F.col("label.fx").alias("label_x"), "area", "left", "top", (F.col("_r") - F.col("left") + 1).alias("width"), (F.col("_b") - F.col("top") + 1).alias("height"))


def enclosed(outline: DataFrame, pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs, as ``labelled_runs`` has them, of the pixels that an outline keeps from the border of their image: the rest of the image falls into parts connected by edges, and
    those that reach a border go."""
    runs = cut(labelled_runs(pixels.select("image", "x", "y").join(outline, ["image", "x", "y"], "left_anti"), diagonal=False))
    r = regions(runs).join(small_or_plain(sizes.select("image", F.col("width").alias("w"), F.col("height").alias("h"))), "image")
    free = r.filter((F.col("left") > 0) & (F.col("top") > 0) & (F.col("left") + F.col("width") < F.col("w")) & (F.col("top") + F.col("height") < F.col("h")))
    return runs.join(small_or_plain(free.select("image", F.struct("image", F.col("label_y").alias("fy"), F.col("label_x").alias("fx")).alias("label"))), ["image", "label"], "left_semi")


def zones_of_colour(reference: DataFrame, annotated: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    """Regions that outlines of one colour enclose, in the order of their tops and lefts, without those below the least sizes: the outline is closed and grown by a step, what it
    encloses is split into components that touch, corners included."""
    sizes = reference.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    outline = cut(grown(closed(colour_mask(reference, annotated, target), sizes), sizes))
    inside = enclosed(outline, reference, sizes)
    px = inside.select("image", "y", F.explode(F.sequence("lo", "hi")).alias("x"))
    found = regions(labelled_runs(px, diagonal=True)).filter(f"area >= {LEAST_AREA} and width >= {LEAST_SIDE} and height >= {LEAST_SIDE}")
    w = Window.partitionBy("image").orderBy("top", "left", F.col("width") * F.col("height"))  # the regions of one image
    return found.withColumn("place", F.row_number().over(w))
