"""Periodic runs of words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least ``least`` words and
``exponent`` times q words, that no neighbouring word extends. Words are maximal stretches without ASCII white space.

Periods are dealt over levels: level L, a power of two, has those from L to 2L - 1. As words are appended, each completed block of L words gets a
catcher. It matches its block against the next 2L words; where the block stands again, q words further, the comparison of the two
suffixes goes on to the left at once and to the right with each appended word, and what it spans is a stretch in which words q apart are identical.
Such a stretch of a run has (exponent - 1) q words, hence holds a whole block. Stretches of one extent merge, and keep the smallest period.

A block that has itself a period p of at most half its length stands at many places. Two facts (by Fine and Wilf) leave few of them:
where all words from the block to its second place have period p, q is a multiple of p and no smallest period; elsewhere the stretch reaches over an end of the
words around the block that have period p, so the word there, on the left or on the right, must stand again q words further.

A word whose last occurrence is 2L words back or more ends all stretches of level L, so the catchers of a level only wake where enough words
in succession have a nearer one; these places are found for whole batches by array operations.

Cases: a null or empty text has no words and no runs; repeated rows and ids are rows of their own; a null id stays; other columns are not read. A task
holds one batch of texts, whose longest text bounds its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

from .common import bound_batches, trim, utf8

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FAR = 1 << 40


class Catcher:
    """The automaton of the block ``w[i : i + size]``, fed with the words behind it."""

    def __init__(self, w: list[int], i: int, size: int):
        self.w, self.i, self.size, self.block = w, i, size, w[i : i + size]
        fail, m = [0] * size, 0
        for k in range(1, size):
            while m and self.block[k] != self.block[m]:
                m = fail[m - 1]
            m += self.block[k] == self.block[m]
            fail[k] = m
        self.fail, self.matched, self.period = fail, 0, size - fail[-1]
        self.repeats = 2 * self.period <= size
        self.right: int | None = None  # the first word behind the block that lacks its period
        self._left: int | None = None

    def append(self, k: int, x: int) -> bool:
        """Whether the block stands again where word k, which is ``x``, is its last."""
        m = self.matched
        while m and (m == self.size or self.block[m] != x):
            m = self.fail[m - 1]
        m += self.block[m] == x
        self.matched = m
        if self.repeats and self.right is None and x != self.w[k - self.period]:
            self.right = k
        return m == self.size

    def left(self) -> int:
        """The last word before the block that lacks its period, or -1."""
        if self._left is None:
            w, x, p = self.w, self.i - 1, self.period
            while x >= 0 and w[x] == w[x + p]:
                x -= 1
            self._left = x
        return self._left


def catch(w: list[int], lo: int, hi: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches of words that are identical to those ``period`` words before or behind, for periods from ``size`` to
    twice it, as the words ``lo`` to ``hi`` of ``w`` are appended one by one."""
    live: list[Catcher] = []
    spans: dict[int, int] = {}  # period: start of the stretch that goes on
    waiting: dict[int, list[tuple[int, Catcher]]] = {}  # word: (period, catcher) for which it decides

    def begin(q: int, i: int) -> None:
        s = i
        while s and w[s - 1] == w[s - 1 + q]:
            s -= 1
        spans[q] = s

    for k in range(lo, hi):
        x = w[k]
        for q in [q for q in spans if w[k - q] != x]:
            yield spans.pop(q), k, q
        for q, c in waiting.pop(k, ()):
            if w[c.right] == x and q not in spans and w[c.i + size : c.right] == w[c.i + size + q : k]:
                begin(q, c.i)
        for c in live:
            if c.append(k, x):
                q = k - size + 1 - c.i
                if q in spans or c.repeats and c.right is None:
                    continue
                if not c.repeats or c.left() >= 0 and w[c.left()] == w[c.left() + q]:
                    begin(q, c.i)
                else:
                    waiting.setdefault(c.right + q, []).append((q, c))
        if (k + 1) % size == 0 and k + 1 - size >= lo:
            live = [c for c in live if k + 1 <= c.i + 3 * size - 2]
            live.append(Catcher(w, k + 1 - size, size))
    for q, s in spans.items():
        yield s, hi, q


def last_seen(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many words back each word stood last in its document, ``FAR`` if never."""
    order = np.lexsort((codes, doc))
    back = np.full(len(codes), FAR, np.int64)
    same = (codes[order[1:]] == codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def runs_of(words: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each document as (start, length, period), by start, then period."""
    if exponent < 3:
        raise ValueError("runs need an exponent of at least 3")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    codes = pd.factorize(np.array([x for w in words for x in w], object))[0] if sizes.sum() else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    back = last_seen(codes, doc)
    found: list[dict[tuple[int, int], int]] = [{} for _ in words]
    own: dict[int, list[int]] = {}
    size = 1
    while (need := max((exponent - 1) * size, least - 2 * size + 1)) <= sizes.max(initial=0):
        # the first word of a document stood nowhere before, so no stretch of near words reaches over two documents
        near = np.flatnonzero(np.diff(np.concatenate([[0], (back < 2 * size).view(np.int8), [0]])))
        for a, b in near.reshape(-1, 2)[near[1::2] - near[::2] >= need].tolist():
            d = int(doc[a])
            lo = int(first[d])
            if d not in own:
                own[d] = codes[lo : lo + sizes[d]].tolist()
            for s, e, q in catch(own[d], max(0, a - lo - 2 * size), b - lo, size):
                if e - s >= max(least, exponent * q):
                    found[d][s, e] = min(q, found[d].get((s, e), q))
        size *= 2
    return [sorted((s, e - s, q) for (s, e), q in f.items()) for f in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row for each document: id, n_words, runs (array of start, length, period; by start, then period) and collapsed, the text without the
    repetitions of its runs."""
    bound_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType
    out = StructType([StructField("id", kind), StructField("n_words", LongType()), StructField("runs", _parse_datatype_string(f"array<{RUN}>")), StructField("collapsed", StringType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [x.split() for x in b.column(1).to_pylist()]
            runs = runs_of(words, least, exponent)
            rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], arrow)
            text = pa.array([collapse(w, r).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, words)), pa.int64()), rows, text], names=["id", "n_words", "runs", "collapsed"])
        trim()

    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)
