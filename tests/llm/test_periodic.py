"""Periodic runs against brute force."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomlens.llm import periodic, queries


def runs_by_force(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        x = 0
        while x + q < len(w):
            s = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            e = x + q
            if x > s and e - s >= max(least, exponent * q) and not any(all(w[y] == w[y + p] for y in range(s, e - p)) for p in range(1, q)):
                found[s, e] = q
            x += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_force(w, runs):
    return b" ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs))


unit = st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9)
text = st.lists(st.tuples(unit, st.integers(1, 9), st.lists(st.sampled_from([b"a", b"b", b"d"]), max_size=2)), max_size=5).map(lambda parts: [x for u, k, rest in parts for x in u * k + rest])


@settings(max_examples=400, deadline=None)
@given(docs=st.lists(text, max_size=4), least=st.sampled_from([1, 6, 11]), exponent=st.sampled_from([3, 4, 5]))
def test_runs_are_those_of_brute_force(docs, least, exponent):
    got = periodic.runs_of(docs, least, exponent)
    assert got == [runs_by_force(d, least, exponent) for d in docs]
    assert [periodic.collapse(d, r) for d, r in zip(docs, got, strict=True)] == [collapsed_by_force(d, r) for d, r in zip(docs, got, strict=True)]


def test_words_with_runs_inside_runs():
    w = ([b"a"] * 300 + [b"b"]) * 6
    assert periodic.runs_of([w])[0] == sorted([(301 * k, 300, 1) for k in range(6)] + [(0, len(w), 301)])
    x, y = [b"a"], [b"a", b"b"]
    while len(y) < 3000:
        x, y = y, y + x
    assert periodic.runs_of([y]) == [[]]  # Fibonacci words hold no fourth power
    with pytest.raises(ValueError, match="exponent"):
        periodic.runs_of([[b"a"]], exponent=2)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_query_on_the_table(spark, data):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op13_periodic_runs"](spark, data).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) > 5
    for r in got:
        w = planted(r["doc_id"], (texts[r["doc_id"]] or "").encode().split())
        runs = runs_by_force(w) if len(w) < 700 else periodic.runs_of([w])[0]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed_by_force(w, runs)).hexdigest()


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x " * 9, 3), (3, "a b " * 5, 4), (3, "a b " * 5, 4), (4, "ü v " * 40_000, 5)], "doc_id long, text string, runs int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find(odd).collect()))
    assert got == [(0, 9, [(0, 9, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 10, [(0, 10, 2)], "a b"), (3, 10, [(0, 10, 2)], "a b"), (4, 40_000, [(0, 40_000, 1)], "ü v")]
    assert periodic.find(odd.limit(0)).count() == 0
    plain = queries.with_planted_runs(odd.filter("doc_id is null or doc_id < 4")).collect()
    assert len(plain) == 5 and {r["doc_id"]: r["text"] for r in plain}[2] == ""
