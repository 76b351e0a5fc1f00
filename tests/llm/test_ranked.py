"""Ranked search against scores of all documents."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomlens.llm import queries, ranked

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def ranks_by_force(docs, items, k):
    """docs: (id, text), items: {id: text}; rows (item, rank, doc, score)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    bags = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items.items():
        rows = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(TERM.findall(lower(text))) if t in b)
            if score > 0:
                rows.append((-score, -(1 << 63) if i is None else i))
        out += [(item, r + 1, None if i == -(1 << 63) else i, -s) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return out


words = st.lists(st.sampled_from("a b c d e f g h the The é9 x_y".split()), max_size=12).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(words, max_size=40), asked=st.lists(words, min_size=1, max_size=4), k=st.sampled_from([1, 3, 50]), share=st.sampled_from([0, 0.1, 0.3, 1]), step=st.sampled_from([3, 100]))
def test_blocks_find_the_best(texts, asked, k, share, step):
    """All lists long, some short, all short; several blocks of documents, whose ids descend."""
    docs = [(1000 - j, t) for j, t in enumerate(texts)]
    own = [sorted({w for w in ranked.alnum_words(t.encode())}) for t in asked]
    terms = {t: j for j, t in enumerate(sorted({t for o in own for t in o}))}
    doc, term, _, n = ranked.postings([t.encode() for t in texts], terms)
    if not (n > 0).any():
        return
    df = np.bincount(term, minlength=len(terms))
    weights = np.array([ranked.weight(int((n > 0).sum()), int(x)) for x in df], np.int64)
    best, before = [ranked.Best(k) for _ in asked], ranked.SHORT_SHARE
    ranked.SHORT_SHARE = share
    try:
        for lo in range(0, len(docs), step):
            part = docs[lo : lo + step]
            ranked.search_block([t.encode() for _, t in part], [i for i, _ in part], terms, weights, [np.array([terms[t] for t in o if weights[terms[t]] > 0], np.int64) for o in own], int((n > 0).sum()), int(n.sum()), best)
    finally:
        ranked.SHORT_SHARE = before
    got = [(j, r + 1, -i, s) for j, b in enumerate(best) for r, (s, i) in enumerate(sorted(b.heap, reverse=True))]
    assert got == ranks_by_force(docs, dict(enumerate(asked)), k)


def test_query_is_its_sql(spark, data):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS FROM '{data}/{name}.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_ranked_search"](spark, data).collect())
    assert got == sorted(duckdb.sql(queries.RANKED_SQL).fetchall()) and len(got) > 500


@pytest.mark.parametrize("kw", [{}, {"block_chars": 1}, {"block_items": 2}])
def test_odd_rows(spark, kw):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (4, "ALPHA-gamma É"), (5, "word " * 30_000), (6, "... !"), (7, "delta")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string")
    items = {None: "beta", "a": "alpha word", "b": "", "c": "nowhere", "d": "é alpha alpha"}
    q = spark.createDataFrame([(i, t, 9) for i, t in items.items()], "item_id string, text string, doc_id int")
    want = ranks_by_force(docs, items, 3)
    assert sorted(map(tuple, ranked.search(d, q, k=3, **kw).collect()), key=str) == sorted(want, key=str)
    assert ranked.search(d.limit(0), q, **kw).count() == 0 and ranked.search(d, q.limit(0), **kw).count() == 0
