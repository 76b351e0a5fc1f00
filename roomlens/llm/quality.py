"""Quality rules: plain counts and base rules, then a hashed n-gram log-likelihood ratio between two multinomials.

Words are ``[^\\x20\\x09-\\x0D]+``. The ratio compares a multinomial over hashed word 1- and 2-grams of trusted documents
(label quality 1) with one over all documents; a document's score is the mean log ratio of its n-grams. The threshold
is fixed from the scores of all labelled documents and then applied to every document.

Cases: null is the empty text, which has no words and fails the base rules; documents without a score (no n-grams) get
0.0; with no trusted document all scores are 0.0 and the method keeps everything; rows of a repeated id are each judged
on their own; extra columns pass through ``measure`` and are left out of ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, mix, small_or_plain, utf8, window_hashes, word_hashes

#: Buckets of the hashed n-grams, and the count added to each bucket of both multinomials.
BUCKETS, SMOOTHING = 1 << 15, 1.0

#: The share of trusted documents that the threshold may turn away.
TRUSTED_LOSS = 0.002

#: Scores are rounded to this step for the table from which the threshold is taken.
STEP = 0.001

WINDOW = 5


def ngrams(words: list[bytes]) -> np.ndarray:
    """Buckets of the word 1- and 2-grams."""
    h = word_hashes(words)
    both = np.concatenate([mix(h), window_hashes(h, 2)])
    return (both >> np.uint64(49)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that stands at least twice in the text."""
    w = window_hashes(mix(word_hashes(words)) ^ mix(np.fromiter(map(len, words), np.uint64, len(words))), WINDOW) if words else np.zeros(0, np.uint64)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return 0
    first: dict[bytes, int] = {}  # the hash only proposes; equal words decide
    sure = np.zeros(len(w), bool)
    for k in np.flatnonzero(again).tolist():
        key = b" ".join(words[k : k + WINDOW])
        if key in first:
            sure[k] = sure[first[key]] = True
        else:
            first[key] = k
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(sure)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    solid = np.frombuffer(text.translate(None, b" \t\n\r\x0b\x0c"), np.uint8)
    word_chars = int(np.count_nonzero((solid & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return word_chars, symbols, dup, repeated_words(words)


def fit_multinomials(docs: DataFrame, trusted: DataFrame, *, id_col: str, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of every bucket. ``trusted``: one row for each trusted id. All documents are counted; what reaches the
    driver is one row for each bucket."""
    ids = small_or_plain(trusted.select(F.col(id_col).alias("_t")).distinct())
    flagged = docs.select(id_col, utf8(text_col).alias("t")).join(ids, F.col(id_col) == F.col("_t"), "left").select("t", F.col("_t").isNotNull().alias("good"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, is_good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.bincount(ngrams(text.split()), minlength=buckets)
                raw += c
                if is_good:
                    good += c
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(good[k])], ["bucket", "raw", "good"])

    sums = flagged.mapInArrow(add, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in sums.collect():
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    if good.sum() == SMOOTHING * buckets:
        return np.zeros(buckets)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def measure(docs: DataFrame, ratio: np.ndarray, *, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, the four counts, score."""
    bound_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = table.value
        for texts in it:
            rows = []
            for t in texts:
                t = bytes(t)
                words = t.split()
                score = float(r[ngrams(words)].mean()) if words else 0.0
                rows.append((len(words), *counts(t, words), round(score, 9)))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    return docs.withColumn(out, F.pandas_udf(run, kind)(utf8(text_col)))


def threshold(scores: list[tuple[float, int, int]], trusted_loss: float = TRUSTED_LOSS) -> float:
    """The cut over (score, trusted documents, distrusted documents): among cuts that turn away at most ``trusted_loss``
    of the trusted, the one that turns away most distrusted; ties go to the lowest cut. None of them: no cut."""
    total = sum(g for _, g, _ in scores)
    lost, best, best_gain, gain = 0, float("-inf"), 0, 0
    for score, good, bad in sorted(scores):
        lost += good
        gain += bad
        if lost > trusted_loss * total:
            break
        if gain > best_gain:
            best, best_gain = score, gain
    return best


def report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trusted_loss: float = TRUSTED_LOSS) -> DataFrame:
    """One row for each document: id, n_words, four counts, base_failed, kept, score."""
    good = labels.filter(F.col("quality") == 1)
    ratio = fit_multinomials(docs, good, id_col=id_col, text_col=text_col)
    m = measure(docs.select(id_col, text_col), ratio, text_col=text_col, out="_q").select(id_col, "_q.*")
    m = m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    m = cut(m)  # read twice: for the threshold and for the result
    cut_at = fit_threshold(m, labels, id_col=id_col, trusted_loss=trusted_loss)
    kept = ~F.col("base_failed") & (F.floor(F.col("score") / STEP) > F.lit(cut_at))
    return m.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def fit_threshold(measured: DataFrame, labels: DataFrame, *, id_col: str, trusted_loss: float = TRUSTED_LOSS) -> float:
    """The threshold in steps, from the labelled documents that pass the base rules; one row for each step is gathered."""
    marks = labels.groupBy(F.col(id_col).alias("_i")).agg(F.max("quality").alias("_quality")).filter(F.col("_quality").isNotNull())
    table = (
        measured.filter(~F.col("base_failed")).select(id_col, F.floor(F.col("score") / STEP).alias("s"))
        .join(small_or_plain(marks), F.col(id_col) == F.col("_i"))
        .groupBy("s").agg(F.sum((F.col("_quality") == 1).cast("int")).alias("good"), F.sum((F.col("_quality") != 1).cast("int")).alias("bad"))
    )
    return threshold([(r["s"], r["good"], r["bad"]) for r in table.collect()], trusted_loss)
