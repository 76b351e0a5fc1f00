"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every whole text.

Words are maximal runs of letters, digits and non-ASCII characters after A-Z are lower-cased. A benchmark item of at
least ``window`` words gives all its windows; a shorter one, if it has words, is one window. A document word inside
any occurrence is hit. Candidates come from 64-bit window hashes and are verified word by word.

Cases: null and empty texts have no words; an item without words gives nothing; items that repeat an id count once;
an item whose id is null marks words but is not listed; extra columns pass through. The benchmark is sent in blocks
of at most ``block_chars`` characters (one longer item is a block of its own), so no broadcast grows with it, and what one block
found is written before the next is sent, so workers hold one set at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bound_batches, cut, trim, utf8, window_hashes, word_hashes

#: log2 of the most slots of the first, approximate look-up.
SLOT_BITS = 22


class WindowSet:
    """The windows of some items: sorted hashes for the scan, the items' own words for the check.

    A distinct window takes 8 bytes of hash, 8 of place and 4 for each item that has it, beside the text of the items and 4
    bytes for each of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids = sorted({i for i, _ in items if i is not None})
        at = {i: k for k, i in enumerate(self.ids)}
        self.texts: list[bytes] = []
        self.words: list[np.ndarray] = []  # where words start in the text, and one beyond its end
        found: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item, text in items:
            words = alnum_words(text)
            if words:
                sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
                found.setdefault(min(window, len(words)), []).append((word_hashes(words), len(self.texts), at.get(item, -1)))
                self.texts.append(b" ".join(words))
                self.words.append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32))
        self.sets = {n: self._sorted(n, rows) for n, rows in found.items()}

    def _window(self, text: int, start: int, n: int) -> bytes:
        own = self.words[text]
        return self.texts[text][own[start] : own[start + n] - 1]

    def _sorted(self, n: int, rows: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, ...]:
        """(slots, shift, hashes, text, start, first item, items) of the windows of ``n`` words."""
        parts = [window_hashes(h, n) for h, _, _ in rows]
        sizes = [len(x) for x in parts]
        h = np.concatenate(parts)
        text, item = (np.repeat(np.array([r[k] for r in rows], np.int32), sizes) for k in (1, 2))
        start = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
        order = np.argsort(h, kind="stable")
        h, text, item, start = h[order], text[order], item[order], start[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        # equal hashes of different words, if there are any, stay apart
        for k in np.flatnonzero(same).tolist():
            same[k] = self._window(text[k], start[k], n) == self._window(text[k - 1], start[k - 1], n)
        first = np.flatnonzero(~same)
        bits = min(SLOT_BITS, max(10, int(16 * len(first)).bit_length()))
        slots = np.zeros(1 << bits, bool)
        slots[h >> np.uint64(64 - bits)] = True
        return slots, np.uint64(64 - bits), h[first], text[first], start[first], np.append(first, len(h)), item

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the places of the items that occur."""
        hit, found = np.zeros(len(words), bool), set()
        if len(words) == 0:
            return hit, found
        h = word_hashes(words)
        for n, (slots, shift, keys, text, start, first, item) in self.sets.items():
            w = window_hashes(h, n)
            near = np.flatnonzero(slots[w >> shift])
            lo = np.searchsorted(keys, w[near])
            for k, j in zip(near.tolist(), lo.tolist(), strict=True):
                while j < len(keys) and keys[j] == w[k]:
                    if self._window(text[j], start[j], n) == b" ".join(words[k : k + n]):
                        hit[k : k + n] = True
                        found.update(item[first[j] : first[j + 1]].tolist())
                    j += 1
        found.discard(-1)
        return hit, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size; rows stream to the driver one partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), utf8(text_col).alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    if block:
        yield block


def _scan_udf(sets, cutout: bool):
    """``cutout``: also the text without the hit spans, null where no word is hit; in the same worker, which holds the set once."""
    def run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        s = sets.value
        for texts, masks, items in it:
            rows = []
            for text, mask, known in zip(texts, masks, items, strict=True):
                words = alnum_words(bytes(text))
                hit, found = s.scan(words)
                names = [s.ids[k] for k in found]
                if mask is not None:
                    hit |= np.unpackbits(np.frombuffer(bytes(mask), np.uint8), count=len(words)).astype(bool)
                    names = {*names, *known}
                clean = remove_spans(bytes(text), hit).decode("utf-8", "replace") if cutout and hit.any() else None
                rows.append((len(words), int(hit.sum()), sorted(names), np.packbits(hit).tobytes(), clean))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "mask", "clean"])
        trim()

    return F.pandas_udf(run, "n_words long, n_hit long, items array<string>, mask binary, clean string")


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 10, block_chars: int = 16_000_000, out: str = "benchmark_hits", cutout: bool = False) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items (texts of item ids, sorted), mask (bits of hit words) and clean, which
    with ``cutout`` is the text without the hit spans where there are any, else null."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = "struct<n_words:bigint,n_hit:bigint,items:array<string>,mask:binary,clean:string>"
    found, sets = docs.withColumn(out, F.lit(None).cast(kind)), None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        if sets is not None:
            # one block's set lives at a time: what is found so far is written before the next is sent
            found = cut(found)
            sets.destroy()
        sets = spark.sparkContext.broadcast(WindowSet(block, window))
        found = found.withColumn(out, _scan_udf(sets, cutout)(utf8(text_col), F.col(out)["mask"], F.col(out)["items"]))
    if sets is None:
        sets = spark.sparkContext.broadcast(WindowSet([], window))
        found = found.withColumn(out, _scan_udf(sets, cutout)(utf8(text_col), F.col(out)["mask"], F.col(out)["items"]))
    return found


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = mark(docs.select(id_col, text_col), benchmark, text_col=text_col, out="_hits", **kw)
    return m.select(
        id_col,
        F.col("_hits.n_words").alias("n_words"),
        F.col("_hits.n_hit").alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


def remove_spans(text: bytes, mask: np.ndarray) -> bytes:
    """``text`` without its hit words and what stands between consecutive hit words."""
    from .common import _WORD_TABLE

    plain = np.frombuffer(text.translate(_WORD_TABLE), np.uint8)
    word = plain != 0x20
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.ones(len(text), bool)
    for k in np.flatnonzero(mask).tolist():
        keep[starts[k] : ends[k]] = False
        if k + 1 < len(mask) and mask[k + 1]:
            keep[ends[k] : starts[k + 1]] = False
    return np.frombuffer(text, np.uint8)[keep].tobytes()


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", drop_share: float = 0.5, **kw) -> DataFrame:
    """``docs`` without benchmark passages: hit spans leave the text; a document with at least ``drop_share`` of its
    words hit goes. Columns and clean texts stay as they are."""
    m = mark(docs, benchmark, text_col=text_col, out="_roomlens_hits", cutout=True, **kw)
    h = "_roomlens_hits"
    kept = m.filter((F.col(f"{h}.n_hit") == 0) | (F.col(f"{h}.n_hit") < drop_share * F.col(f"{h}.n_words")))
    return kept.withColumn(text_col, F.coalesce(F.col(f"{h}.clean"), F.col(text_col))).drop(h)
