"""Byte-level BPE: encoding by recursive DuckDB queries in each partition, decoding by ordered aggregation.

Spark splits a text into the matches of the pattern. A partition's distinct matches ("words" here) go to DuckDB as rows
(word, first byte, end, token id, id of the next token); the table of merges has a row for each two tokens that together are a
token. A recursive query joins rows to it and contracts each word's leftmost pair of lowest rank until no pair of any word
is a token. A word that is itself a token is that token. Words longer than ``SHORT_BYTES`` contract in a round all pairs of their
lowest rank that do not overlap, from the left: a contraction makes no pair of lower rank, as each token is what
its own bytes contract to (``is_closed``; where a vocabulary is not so, they too contract one pair a round). Decoding cuts ids
before tokens that begin with a space and puts the bytes of each different piece together by an ordered aggregation.

Cases: a null text is empty and has no ids; bytes that are no UTF-8 become U+FFFD, and so decode; repeated rows and ids stay; a null
array of ids decodes to no bytes; an id that the vocabulary lacks is an error; other columns are not read. A worker keeps the
words and pieces of one partition, about ``MEMO_WORDS`` of each at a time. Letters and numbers are those of Java's Unicode tables.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import BATCH_BYTES, bound_batches, trim

#: Bytes up to which a word contracts one pair a round; words that one query gets; bytes of long words that one query gets; words that a
#: partition's memo holds before it starts anew; ids of a piece that is decoded.
SHORT_BYTES, QUERY_WORDS, QUERY_BYTES, MEMO_WORDS, PIECE_IDS = 48, 20_000, 1 << 18, 400_000, 8

#: Characters of the property White_Space.
SPACES = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: One pair a round. p is rank, first byte and end of the first token, packed, so that the least p is the leftmost pair of lowest rank.
#: c, d, m: where the contracted pair begins, where its second token begins, what it becomes.
ONE_PAIR = """WITH RECURSIVE t AS (
 SELECT 0 AS k, w, s, s + 1 AS e, id, nid, (rank::BIGINT << 16) + (s << 8) + s + 1 AS p FROM bytes_of_words LEFT JOIN merges ON pair = (id::BIGINT << 17) + nid
 UNION ALL
 (WITH best AS (SELECT w, (min(p) >> 8) & 255 AS c, min(p) & 255 AS d, min(p) >> 16 AS m FROM t GROUP BY w HAVING min(p) IS NOT NULL),
  r AS MATERIALIZED (SELECT t.*, c, d, m FROM t JOIN best USING (w)),
  fresh AS (SELECT any_value(k) AS k, w, any_value(c) AS s, max(e) AS e, any_value(m) AS id, arg_max(nid, s) AS nid FROM r WHERE s = c OR s = d GROUP BY w
   UNION ALL SELECT k, w, s, e, id, m FROM r WHERE e = c)
  SELECT k + 1, w, s, e, id, nid, p FROM r WHERE s <> c AND s <> d AND e <> c
  UNION ALL
  SELECT k + 1, w, s, e, id, nid, (rank::BIGINT << 16) + (s << 8) + e FROM fresh LEFT JOIN merges ON pair = (id::BIGINT << 17) + nid))
SELECT w, list(id ORDER BY s) AS ids FROM t JOIN (SELECT w, max(k) AS k FROM t GROUP BY w) USING (w, k) GROUP BY w"""

#: All pairs of the lowest rank in a round; of pairs that overlap in a chain, the first, third, fifth. Only the last row of a place is kept.
ALL_PAIRS = """WITH RECURSIVE t(w, s, k, id) USING KEY (w, s) AS (
 SELECT w, s, 0, id FROM bytes_of_words
 UNION ALL
 (WITH n AS (SELECT *, row_number() OVER o AS n, lead(id) OVER o AS nid FROM t WINDOW o AS (PARTITION BY w ORDER BY s)),
  q AS (SELECT n.*, rank, min(rank) OVER (PARTITION BY w) AS low FROM n LEFT JOIN merges ON pair = (id::BIGINT << 17) + nid),
  h AS (SELECT *, coalesce(rank = low, false) AND @PICK AS hit FROM q WHERE low IS NOT NULL),
  x AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY s), false) AS eaten FROM h)
  SELECT w, s, k + 1, CASE WHEN hit THEN low ELSE id END FROM x WHERE NOT eaten))
SELECT w, list(id ORDER BY s) AS ids FROM t JOIN (SELECT w, max(k) AS k FROM t GROUP BY w) USING (w, k) GROUP BY w"""
EVERY = "(n - coalesce(max(CASE WHEN rank IS DISTINCT FROM low THEN n END) OVER (PARTITION BY w ORDER BY n), 0)) % 2 = 1"
FIRST = "n = min(CASE WHEN rank = low THEN n END) OVER (PARTITION BY w)"

#: Each piece's bytes, aggregated by place and put in that order; rows hold (piece, place, id).
DECODE = f"""SELECT piece, unhex(concat({", ".join(f"max(CASE WHEN place = {k} THEN hex END)" for k in range(PIECE_IDS))})) AS bytes
 FROM pieces JOIN vocabulary USING (id) GROUP BY piece ORDER BY piece"""


def split_words(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` in ``text``, null as the empty text; its white space is that of Unicode."""
    own = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(own), F.lit(0))


class Codec:
    """A vocabulary of ranks in DuckDB, of one Python worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rank = self.rank
        both = [(rank[t[:k]] << 17 | rank[t[k:]], r) for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", pa.table({"pair": pa.array([p for p, _ in both], pa.int64()), "rank": pa.array([r for _, r in both], pa.int32())}))
        self._table("vocabulary", pa.table({"id": pa.array(rank.values(), pa.int32()), "hex": [t.hex() for t in rank]}))
        self.tokens, self.token_ids = pa.array(list(rank), pa.binary()), pa.array(rank.values(), pa.int32())
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.known = np.zeros(max(rank.values()) + 1, bool)
        self.known[list(rank.values())] = True
        self.spaced = np.zeros(len(self.known), bool)
        self.spaced[[r for t, r in rank.items() if t[:1] == b" "]] = True
        self.every = True
        self.every = self.is_closed()
        self.forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("_rows", rows)
        self.con.execute(f"CREATE TABLE {name} AS FROM _rows")
        self.con.unregister("_rows")

    def forget(self) -> None:
        """Start the memos of words and of decoded pieces anew."""
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        self.pieces, self.bytes = pa.array([], pa.binary()), pa.array([], pa.large_binary())

    def is_closed(self) -> bool:
        """Whether each token is what its bytes contract to, one pair a round."""
        return all(self.contract(self.tokens.slice(k, QUERY_WORDS), one=True).equals(pa.ListArray.from_arrays(pa.array(range(len(own) + 1), pa.int32()), own))
                   for k in range(0, len(self.tokens), QUERY_WORDS) for own in [self.token_ids.slice(k, QUERY_WORDS)])

    def _run(self, query: str, words: pa.BinaryArray) -> pa.ListArray:
        words = pa.concat_arrays([words])
        size = pc.binary_length(words).to_numpy()
        ends = np.cumsum(size)
        first = int(np.frombuffer(words.buffers()[1], np.int32)[words.offset])
        data = self.byte[np.frombuffer(words.buffers()[2], np.uint8)[first : first + ends[-1]]]
        following = np.append(data[1:], np.int32(0))
        following[ends - 1] = (1 << 17) - 1  # no id
        self.con.register("bytes_of_words", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "s": (np.arange(len(data)) - np.repeat(ends - size, size)).astype(np.int32),
                                                      "id": data, "nid": following}))
        found = self.con.sql(query + " ORDER BY w").to_arrow_table()["ids"].combine_chunks()
        self.con.unregister("bytes_of_words")
        return found.cast(pa.list_(pa.int32()))

    def contract(self, words: pa.BinaryArray, one: bool = False) -> pa.ListArray:
        """The ids of words of at least one byte, by the recursive queries alone; ``one``: one pair a round."""
        size = pc.binary_length(words).to_numpy()
        short = size <= (255 if one else SHORT_BYTES)
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        few, many = words.filter(pa.array(short)), words.filter(pa.array(~short))
        parts = [self._run(ONE_PAIR, few.slice(k, QUERY_WORDS)) for k in range(0, len(few), QUERY_WORDS)]
        query, upto, lo = ALL_PAIRS.replace("@PICK", EVERY if self.every else FIRST), np.cumsum(size[~short]), 0
        while lo < len(many):
            hi = max(lo + 1, int(np.searchsorted(upto, QUERY_BYTES + (upto[lo - 1] if lo else 0), "right")))
            parts.append(self._run(query, many.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *parts]).take(pa.array(np.argsort(order, kind="stable")))

    def encode(self, words: pa.ListArray) -> pa.ListArray:
        """The ids of rows of words."""
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary
        if len(self.words) > MEMO_WORDS:
            self.forget()
        fresh = own.filter(pc.invert(pc.is_in(own, value_set=self.words)))
        at = pc.index_in(fresh.cast(pa.binary()), value_set=self.tokens)
        whole = at.is_valid()
        rest = fresh.filter(pc.invert(whole))
        single = self.token_ids.take(at.drop_null())
        self.words = pa.concat_arrays([self.words, fresh.filter(whole), rest])
        self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(pa.array(range(len(single) + 1), pa.int32()), single), self.contract(rest.cast(pa.binary()))])
        found = self.ids.take(pc.index_in(own, value_set=self.words).take(coded.indices))
        bounds = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
        rows = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(bounds[rows].astype(np.int32)), found.flatten())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of rows of ids, as large binary."""
        flat = ids.flatten().to_numpy()
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.known) or not self.known[flat].all()):
            raise ValueError("an id that the vocabulary does not have")
        rows = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        if not len(flat):
            return pa.array([b""] * len(ids), pa.large_binary())
        begins = self.spaced[flat]
        begins[rows[rows < len(flat)]] = True
        start = np.flatnonzero(begins)
        begins |= (np.arange(len(flat)) - np.repeat(start, np.diff(np.append(start, len(flat))))) % PIECE_IDS == 0
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(flat)))
        # pieces as texts of equal size, -1 where a piece has no id
        table = np.append(flat, np.full(PIECE_IDS, -1, np.int32)).astype(np.int32)[start[:, None] + np.arange(PIECE_IDS)]
        table[np.arange(PIECE_IDS) >= size[:, None]] = -1
        bounds = np.arange(len(start) + 1, dtype=np.int32) * (4 * PIECE_IDS)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(table)]).dictionary_encode()
        own = coded.dictionary
        if len(self.pieces) > MEMO_WORDS:
            self.forget()
        new = pc.invert(pc.is_in(own, value_set=self.pieces))
        fresh = own.filter(new)
        if len(fresh):
            _, first = np.unique(coded.indices.to_numpy(), return_index=True)
            rows_of = table[first[new.to_numpy(zero_copy_only=False)]]
            piece, place = np.nonzero(rows_of >= 0)
            self.con.register("pieces", pa.table({"piece": piece.astype(np.int32), "place": place.astype(np.int8), "id": rows_of[piece, place]}))
            data = self.con.sql(DECODE).to_arrow_table()["bytes"].combine_chunks().cast(pa.large_binary())
            self.con.unregister("pieces")
            self.pieces, self.bytes = pa.concat_arrays([self.pieces, fresh]), pa.concat_arrays([self.bytes, data])
        found = self.bytes.take(pc.index_in(own, value_set=self.pieces).take(coded.indices))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy())]).astype(np.int64)
        joined = np.frombuffer(found.buffers()[2], np.uint8)[np.frombuffer(found.buffers()[1], np.int64)[found.offset] :]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[np.searchsorted(start, rows)]), pa.py_buffer(joined)])


_OPEN: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    if path not in _OPEN:
        _OPEN[path] = Codec(path)
    return _OPEN[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``BATCH_BYTES``, so that a query has enough to do."""
    own, size = [], 0
    for b in batches:
        own.append(b)
        size += b.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(own)
            own, size = [], 0
    if own:
        yield pa.concat_batches(own)


def _mapped(docs: DataFrame, id_col: str, column: Column, fields: list[StructField], path: str, row_columns) -> DataFrame:
    """Rows of the id and what ``row_columns(codec, values)`` gives for each batch of ``column``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in gathered(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *row_columns(own, b.column(1))], names=["id", *(f.name for f in fields)])
        own.forget()
        trim()

    kind = docs.select(F.col(id_col)).schema[0].dataType
    got = docs.select(F.col(id_col).alias("id"), column.alias("values")).mapInArrow(run, StructType([StructField("id", kind), *fields]))
    return got.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (array of int) of each text, each match of ``pattern`` by itself."""
    return _mapped(docs, id_col, split_words(F.col(text_col), pattern), [StructField("ids", ArrayType(IntegerType()))], path, lambda c, words: [c.encode(words)])


def decode(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and data: the bytes that each row's ids stand for."""
    return _mapped(rows, id_col, F.col(ids_col).cast("array<int>"), [StructField("data", BinaryType())], path, lambda c, ids: [c.decode(ids).cast(pa.binary())])


def _digests(c: Codec, words: pa.ListArray) -> list[pa.Array]:
    ids = c.encode(words)
    data = c.decode(ids)
    flat, rows = ids.flatten().cast(pa.string()), ids.offsets
    text = pc.binary_join(pa.ListArray.from_arrays(rows, flat), " ")
    sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
    return [ids.value_lengths().cast(pa.int64()), sha(text), sha(data)]


def report(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 (of the decimal ids, one space between), decoded_sha256 (of the bytes decoded from them)."""
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _mapped(docs, id_col, split_words(F.col(text_col), pattern), fields, path, _digests)
