"""Byte-level BPE against the public library."""

import functools
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roomlens.llm import byte_pairs, queries

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PATTERN = regex.compile(public_tokenizers.PATTERN)


@functools.cache
def both(name):
    own = byte_pairs.Codec(public_tokenizers.path(name))
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def as_rows(texts):
    return pa.array([PATTERN.findall(t) for t in texts], pa.list_(pa.string()))


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abething XZ0129.,'\n\t é日🙂　\x1c"), max_size=120) | st.text(max_size=40), max_size=6))
def test_ids_are_those_of_the_library(name, texts):
    own, library = both(name)
    ids = own.encode(as_rows(texts))
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert [x.decode() for x in own.decode(ids).to_pylist()] == texts


@pytest.mark.parametrize("every", [True, False])
def test_long_words_and_overlapping_pairs(every, monkeypatch):
    own, library = both(FILES[0])
    assert own.every  # each token is what its bytes contract to
    monkeypatch.setattr(own, "every", every)
    monkeypatch.setattr(byte_pairs, "SHORT_BYTES", 4)
    monkeypatch.setattr(byte_pairs, "QUERY_BYTES", 300)
    own.forget()
    texts = ["x" * 700, " " * 301 + "a", "ab" * 90, "aaabaaab" * 20, "thethingsinthe" * 9, "é" * 77, "", "q" * 5]
    assert own.encode(as_rows(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]
    own.forget()


def test_memo_and_unknown_ids(monkeypatch):
    own, library = both(FILES[0])
    monkeypatch.setattr(byte_pairs, "MEMO_WORDS", 3)
    for k in range(4):
        texts = [f"some zyxq{k} words", "some other"]
        assert own.encode(as_rows(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert own.decode(pa.array([None, []], pa.list_(pa.int32()))).to_pylist() == [b"", b""]
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode(pa.array([[50256]], pa.list_(pa.int32())))


def test_query_on_the_table_and_odd_rows(spark, data):
    _, library = both(FILES[0])
    path, pattern = public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op12_byte_bpe"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    odd = spark.createDataFrame([(1, None, 3), (2, "", 1), (None, "no id", 0), (4, "two  spaces　wide\n", 1), (4, "two  spaces　wide\n", 2), (5, "word " * 40000, 0)], "doc_id long, text string, n_tokens int")
    rows = {(r["doc_id"], r["n_tokens"]) for r in byte_pairs.report(odd, path, pattern).collect()}
    assert rows == {(1, 0), (2, 0), (None, 2), (4, len(library.encode_ordinary("two  spaces　wide\n"))), (5, len(library.encode_ordinary("word " * 40000)))}
    back = byte_pairs.decode(byte_pairs.encode(odd, path, pattern), path)
    assert sorted(x[0] for x in back.select(F.decode("data", "utf-8")).collect()) == sorted(t or "" for _, t, _ in [tuple(r) for r in odd.collect()])
    assert byte_pairs.report(odd.limit(0), path, pattern).count() == 0
