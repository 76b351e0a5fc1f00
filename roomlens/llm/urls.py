"""URL filter: prefix rules first, else logistic regression on hashed character n-grams of host and path.

The host runs from after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from there to
``?``, ``#`` or the end. A null url or one without ``://`` has both empty and is judged by the model. A rule fits its
host and all subdomains if the path starts with the rule's; the longest rule wins. The model is trained on a small
table of labelled urls: by default those that the rules decide, at most ``train_rows`` distinct ones taken in the order
of a hash. Without both labels to learn from every undecided url is allowed. Ties (probability exactly 0.5) are allowed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: (verdict, host, path): fixed values of the filter's contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

BUCKETS = 1 << 16
TRAIN_ROWS = 5000


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character 3- to 5-grams of host and path (each marked by where it stands)."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in (3, 4, 5):
            for k in range(max(1, len(s) - n + 1)):
                out.add(zlib.crc32((mark + s[k : k + n]).encode("utf-8", "surrogatepass")) % BUCKETS)
    return np.fromiter(out, np.int64, len(out))


def fit(rows: list[tuple[str, str, int]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adagrad over (host, path, blocked)."""
    w, g2, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    if len({y for *_, y in rows}) < 2:
        return w, -1.0
    xs = [features(h, p) for h, p, _ in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = xs[k], rows[k][2]
            scale = 1 / np.sqrt(len(x))
            e = 1 / (1 + np.exp(-np.clip(b + scale * w[x].sum(), -30, 30))) - y
            grad = e * scale + l2 * w[x]
            g2[x] += grad * grad
            gb += e * e
            w[x] -= rate * grad / np.sqrt(g2[x])
            b -= rate * e / np.sqrt(gb)
    return w, float(b)


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None,
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict (allow or block) and p_block (the model's probability).

    ``labelled``: a table (url, verdict) to train from instead of what the rules decide."""
    spark = pages.sparkSession
    bound_batches(spark)
    host, path = host_path(F.col("_u"))
    base = pages.select(id_col, F.col(url_col).cast("string").alias("_u")).select(id_col, host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("_v"))
    if labelled is None:
        known = base.filter(F.col("_v").isNotNull()).select("host", "path", "_v")
    else:
        h, p = host_path(F.col("url"))
        known = labelled.select(h.alias("host"), p.alias("path"), F.col("verdict").alias("_v"))
    # of each verdict, the urls of least hash: hashes below a bound that leaves a few more than are taken, however many pages there are
    many = {r["_v"]: r["n"] for r in known.groupBy("_v").agg(F.approx_count_distinct(F.xxhash64("host", "path"), 0.02).alias("n")).collect()}
    half = []
    for v in ("allow", "block"):
        share = min(1.0, 2 * (train_rows // 2 + 100) / max(1, many.get(v, 0)))
        low = F.col("_h") <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)
        one = known.filter(F.col("_v") == v).select("host", "path", F.xxhash64("host", "path").alias("_h")).filter(low).distinct()
        half.append(one.orderBy("_h", "host", "path").limit(train_rows // 2))
    rows = [(r["host"], r["path"], y) for y, t in enumerate(half) for r in t.collect()]
    model = spark.sparkContext.broadcast(fit(sorted(set(rows))))

    @F.pandas_udf("double")
    def p_block(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w, b = model.value
        z = np.empty(len(hosts))
        for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            x = features(h, p)
            z[k] = b + w[x].sum() / np.sqrt(max(1, len(x)))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    scored = base.withColumn("p_block", p_block("host", "path"))
    return scored.select(
        id_col, "host", "path", "rule",
        F.coalesce("_v", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block",
    )
