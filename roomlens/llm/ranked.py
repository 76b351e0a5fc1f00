"""Ranked lexical search: for each item of a query table the highest-scoring documents, by a hybrid of term-at-a-time and document-at-a-time.

Every partition of documents is an index of its own: it keeps, for some megabytes of text at a time, the postings of the items' terms with their whole
scores, which hold statistics of all documents. For an item, the lists of terms that are rare there are summed into accumulators, term at a time, and
are from then on one list with one bound, their greatest sum. That list and the long lists of frequent terms are met document at a time: by
their bounds, in ascending order, the lists whose bounds together stay below the lowest of the best scores so far name no candidates and are only looked into by
skipping (binary search from where they stand), as long as what is left of the bounds may still lift the candidate. The best of a partition go
to the next stage, which ranks them by item in two steps. Scores are integers, so every order of summing gives the same ranks.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. N documents have a term, L terms in all, n in this one; w = floor(1000 ln((2N + 2) / (2df + 1)));
m = 50 + (50 n N) div L; the score sums w ((10^9 tf) div (1000 tf + 20 m)) over the item's different terms.

Cases: null and empty texts have no terms and are never found; an item without terms finds nothing; rows that repeat an item's id are one item with all their
terms (null is an id); documents that repeat an id are ranked singly; among equal scores a null document id comes first; other columns are not read. Items go to
the workers in blocks of at most ``block_chars`` characters and ``block_items`` items (one longer item is a block of its own); each block reads the documents twice.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import alnum_words, bound_batches, trim, utf8

#: A list is short up to this share of a block's documents; bytes of text of a block of documents; parts in which an item's candidates are ranked first.
SHORT_SHARE, BLOCK_BYTES, PARTS = 1 / 32, 16 * 1024 * 1024, 64
#: What stands for a null document id, and in the rows of statistics for N and L.
NO_ID, N_ROW, L_ROW = -(1 << 63), -1, -2

Terms = dict[bytes, int]
List = tuple[int, np.ndarray, np.ndarray]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int, block_items: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their sorted different terms, in blocks of bounded size; rows stream to the driver ordered by id, one partition at a time."""
    block: dict[object, set[bytes]] = {}
    size = 0
    for r in items.select(F.col(id_col).alias("i"), utf8(text_col).alias("t")).orderBy("i").toLocalIterator():
        text = bytes(r["t"])
        if block and r["i"] not in block and (size + len(text) > block_chars or len(block) == block_items):
            yield [(i, sorted(t)) for i, t in block.items()]
            block, size = {}, 0
        block.setdefault(r["i"], set()).update(alnum_words(text))
        size += len(text)
    if block:
        yield [(i, sorted(t)) for i, t in block.items()]


def postings(texts: list[bytes], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of the given terms, by document, and the number of all terms of each document."""
    n, found, get = np.zeros(len(texts), np.int64), [], terms.get
    for k, text in enumerate(texts):
        words = alnum_words(text)
        n[k] = len(words)
        at = np.array([get(w, -1) for w in words], np.int64)
        found.append(at[at >= 0] + k * len(terms))
    key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), tf, n


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best documents of an item; ``floor`` is the score that a document must reach."""

    def __init__(self, k: int):
        self.k, self.heap, self.floor = k, [], 1

    def offer(self, score: int, doc_id: int) -> None:
        entry = (score, -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.floor = max(1, self.heap[0][0])


def accumulate(lists: list[List], floor: int) -> list[List]:
    """The sums of the short lists as one list, without documents that stay below ``floor``."""
    if not lists:
        return []
    docs, at = np.unique(np.concatenate([d for _, d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, np.concatenate([s for _, _, s in lists]))
    keep = sums >= floor
    return [(int(sums[keep].max()), docs[keep], sums[keep])] if keep.any() else []


def walk(lists: list[List], ids: list[int], best: Best) -> None:
    """Offer to ``best`` every document that may be among the best, document at a time."""
    lists = sorted(lists, key=lambda x: x[0])
    upto = np.cumsum([b for b, _, _ in lists]).tolist()
    docs, scores = [d.tolist() for _, d, _ in lists], [s.tolist() for _, _, s in lists]
    at, size, end = [0] * len(lists), [len(d) for d in docs], len(ids)
    heads = [d[0] for d in docs]
    first = 0  # lists before it name no candidates
    while first < len(lists):
        if upto[first] < best.floor:
            first += 1
            continue
        doc = min(heads[first:])
        if doc == end:
            return
        score = 0
        for j in range(first, len(lists)):
            if heads[j] == doc:
                score += scores[j][at[j]]
                at[j] += 1
                heads[j] = docs[j][at[j]] if at[j] < size[j] else end
        for j in range(first - 1, -1, -1):
            if score + upto[j] < best.floor:
                break
            at[j] = bisect_left(docs[j], doc, at[j])
            if at[j] < size[j] and docs[j][at[j]] == doc:
                score += scores[j][at[j]]
        else:
            if score >= best.floor:
                best.offer(score, ids[doc])


def search_block(texts: list[bytes], ids: list[int], terms: Terms, weights: np.ndarray, items: list[np.ndarray], n_docs: int, n_terms: int, best: list[Best]) -> None:
    """Offer the documents of one block to the items; an item is the numbers of its terms."""
    doc, term, tf, n = postings(texts, terms)
    m = 50 + (50 * n * n_docs) // n_terms
    score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    order = np.argsort(term, kind="stable")
    term, doc, score = term[order], doc[order], score[order]
    begin = np.searchsorted(term, np.arange(len(terms) + 1))
    few = max(1, int(len(texts) * SHORT_SHARE))
    for own, b in zip(items, best, strict=True):
        lists = [(int(score[lo:hi].max()), doc[lo:hi], score[lo:hi]) for lo, hi in zip(begin[own].tolist(), begin[own + 1].tolist(), strict=True) if hi > lo]
        long = [x for x in lists if len(x[1]) > few]
        walk(long + accumulate([x for x in lists if len(x[1]) <= few], b.floor - sum(x[0] for x in long)), ids, b)


def _statistics(docs: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term; counts are summed in every task, then by term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        df, n_docs, n_terms = np.zeros(len(own), np.int64), 0, 0
        for b in batches:
            _, term, _, n = postings(b.column(1).to_pylist(), own)
            df += np.bincount(term, minlength=len(own))
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [N_ROW, L_ROW])), pa.array(np.append(df[at], [n_docs, n_terms]))], names=["term", "n"])
        trim()

    rows = dict(docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    df = np.zeros(len(terms), np.int64)
    for k, n in rows.items():
        if k >= 0:
            df[k] = n
    sent.destroy()
    return rows.get(N_ROW, 0), rows.get(L_ROW, 0), df


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_chars: int = 16_000_000, block_items: int = 2000) -> DataFrame:
    """``item_id``, rank (from 1), ``id_col`` (long) and score of the ``k`` best documents of each item with a score above 0; equal scores by ascending id."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = items.select(F.col(item_id)).schema[0].dataType
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    out = StructType([StructField("item", kind), StructField("id", LongType()), StructField("score", LongType()), StructField("part", LongType())])
    found = spark.createDataFrame([], out)
    for block in item_blocks(items, item_id, item_text, block_chars, block_items):
        terms = {t: j for j, t in enumerate(sorted({t for _, own in block for t in own}))}
        n_docs, n_terms, df = _statistics(rows, terms)
        if n_docs == 0:
            break
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        # terms of weight 0 add nothing
        sent = spark.sparkContext.broadcast((terms, weights, [i for i, _ in block], [np.array([terms[t] for t in own if weights[terms[t]] > 0], np.int64) for _, own in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            terms, weights, names, own = sent.value
            best = [Best(k) for _ in own]
            texts, ids, size, part = [], [], 0, TaskContext.get().partitionId() % PARTS
            for b in batches:
                texts += b.column(1).to_pylist()
                ids += b.column(0).fill_null(NO_ID).to_pylist()
                size += b.column(1).nbytes
                if size > BLOCK_BYTES:
                    search_block(texts, ids, terms, weights, own, n_docs, n_terms, best)
                    texts, ids, size = [], [], 0
            if texts:
                search_block(texts, ids, terms, weights, own, n_docs, n_terms, best)
            for name, b in zip(names, best, strict=True):
                if b.heap:
                    own_ids = pa.array([None if i == -NO_ID else -i for _, i in b.heap], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(b.heap), to_arrow_type(kind)), own_ids, pa.array([s for s, _ in b.heap], pa.int64()), pa.array([part] * len(b.heap), pa.int64())], names=out.names)
            trim()

        found = found.unionByName(rows.mapInArrow(run, out))
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")
