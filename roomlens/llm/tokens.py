"""Token ids by the public tokenizers: texts are cut into pieces whose ids do not depend on each other, by array operations.

Both vocabularies split texts before their merges so that nothing reaches over white space but one space that stands before
a word, nor from a letter to a sign after it. A text is therefore cut

* before every run of ASCII white space, before the last character of such a run if something follows, and after a run
  that does not end in a space;
* between a letter and an ASCII sign, and between an ASCII sign other than the apostrophe and an ASCII letter (letters here are
  A-Z, a-z and U+00C0 to U+027F without the two signs among them).

Each piece has the same ids alone as in its text. A worker keeps the ids of pieces of up to ``BYTES`` bytes in a direct-mapped
table of ``SLOTS`` slots, which compares whole pieces, so its memory is fixed and nothing rests on hashes; a piece that
is not there goes to the library and takes its slot. Two kinds of texts go to the library whole: those that hold the
text of an added token, and those in which ASCII white space meets other white space (one run may hold both).

The result is that of the library's tokenizer as its file sets it up, with ``add_special_tokens=False``. Ids fit 16 bits.
Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core

#: Slots of the table, bytes of a piece and ids that a slot holds (about 42 bytes a slot); bytes of text cut at a time.
SLOT_BITS, BYTES, IDS = 19, 24, 8
SLOTS = 1 << SLOT_BITS
SLICE_BYTES = 1 << 19

_SPACE, _LETTER, _SIGN = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[33:127] = True
_SIGN[48:58] = False
_SIGN &= ~_LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = r"[\x09-\x0D\x20]"
#: The UTF-8 bytes of other white space: U+0085, 00A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F, 3000.
_OTHER = r"(?:\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)"
#: Masks of the first k bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of several texts; text k is ``offsets[k]`` to ``offsets[k + 1]``."""
    space, letter, sign = _SPACE[data], _LETTER[data], _SIGN[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True  # also the end
    at = begins[:-1].copy()
    last = space & begins[1:]
    last[:-1] |= space[:-1] & space[1:]  # white space that is the end of a text, or goes on
    at[1:] |= space[1:] & ~(space[:-1] & last[1:])
    at[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    ends = letter.copy()  # the last byte of a letter
    lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
    ends[1:] |= lead & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    at[1:] |= sign[1:] & ends[:-1]
    at[1:] |= letter[1:] & sign[:-1] & (data[:-1] != 39)
    return np.flatnonzero(at)


def words(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first ``BYTES`` bytes of each piece as words of 8 bytes, zero beyond its end."""
    padded = np.zeros(len(data) + BYTES, np.uint8)
    padded[: len(data)] = data
    every = np.ndarray((len(data) + BYTES - 7,), "<u8", padded, strides=(1,))
    return [every[at + k] & _FIRST[np.clip(size - k, 0, 8)] for k in range(0, BYTES, 8)]


class PieceTokenizer:
    """``encode(texts)`` gives (ids, ends): the uint16 ids of all texts, and where each text's ids end."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()]
        self.odd = f"(?i){'|'.join([*added, _ASCII + _OTHER, _OTHER + _ASCII])}"
        self.lower = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("A") == "a"
        # ids that end a word where the vocabulary marks word ends, else ids that begin with the space before a word
        self.suffix = self.tok.model.end_of_word_suffix
        self.edge = np.zeros(1 << 16, bool)
        for word, k in self.tok.get_vocab().items():
            self.edge[k] = word.endswith(self.suffix) if self.suffix else word.startswith("\u0120")
        self.keys = [np.zeros(SLOTS, np.uint64) for _ in range(BYTES // 8)]
        self.sizes = np.zeros(SLOTS, np.uint8)  # bytes of the piece, 0: free
        self.n = np.zeros(SLOTS, np.uint8)
        self.pool = np.zeros(SLOTS * IDS, np.uint16)  # behind the slots' ids stand those that have none, for one slice

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) by the library alone."""
        found = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint16, int(n.sum())), n

    def together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of a space and letters, encoded as one text and cut between the words."""
        ids, _ = self.whole(["".join(pieces)])
        at = np.flatnonzero(self.edge[ids])
        n = np.diff(at + 1, prepend=0) if self.suffix else np.diff(at, append=len(ids))
        return (ids, n) if len(n) == len(pieces) and n.sum() == len(ids) else self.whole(pieces)

    def fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of different pieces."""
        texts = [x.decode("utf-8", "replace") for x in pieces]
        plain = np.array([x[0] == " " and x[1:].isalpha() for x in texts])
        a, k = self.together([x for x, p in zip(texts, plain, strict=True) if p])
        b, m = self.whole([x for x, p in zip(texts, plain, strict=True) if not p])
        n = np.empty(len(texts), np.int64)
        n[plain], n[~plain] = k, m
        of = np.repeat(plain, n)
        ids = np.empty(len(of), np.uint16)
        ids[of], ids[~of] = a, b
        return ids, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string or binary array without nulls."""
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        ids, sizes, lo = [], [], 0
        while lo < len(texts):
            if odd[lo]:
                found, n = self.whole([texts[lo].as_py().decode("utf-8", "replace")])
                hi = lo + 1
            else:
                hi = min(len(texts), max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES))))
                hi = lo + int(odd[lo:hi].argmax()) if odd[lo:hi].any() else hi
                base, end = int(bounds[lo]), int(bounds[hi])
                found, n = self._plain(np.frombuffer(texts.buffers()[2], np.uint8, end - base, base) if end > base else np.zeros(0, np.uint8), bounds[lo : hi + 1] - base)
            ids.append(found)
            sizes.append(n)
            lo = hi
        return np.concatenate([np.zeros(0, np.uint16), *ids]), np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) == 0:
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        if self.lower:
            data = _LOWER[data]
        at = cuts(data, offsets)
        size = np.diff(np.append(at, len(data)))
        key = words(data, at, size)
        with np.errstate(over="ignore"):
            slot = sum((w * np.uint64(c) for w, c in zip(key, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F), strict=True)), size.astype(np.uint64))
            slot = (((slot ^ (slot >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        have = self.sizes[slot] == size
        for w, k in zip(key, self.keys, strict=True):
            have &= k[slot] == w
        first, n = slot * IDS, self.n[slot].astype(np.int64)
        miss = np.flatnonzero(~have)
        if len(miss):
            raw = data.tobytes()
            order: dict[bytes, int] = {}
            kind = np.fromiter((order.setdefault(raw[a:b], len(order)) for a, b in zip(at[miss].tolist(), (at + size)[miss].tolist(), strict=True)), np.int64, len(miss))
            ids, k = self.fresh(list(order))
            start = np.cumsum(k) - k
            if len(self.pool) < SLOTS * IDS + len(ids):
                self.pool = np.concatenate([self.pool[: SLOTS * IDS], ids])
            else:
                self.pool[SLOTS * IDS : SLOTS * IDS + len(ids)] = ids
            first[miss], n[miss] = SLOTS * IDS + start[kind], k[kind]
        ends = np.cumsum(n)
        # id j of a piece stands in the pool j places behind its first
        out = self.pool[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))]
        if len(miss):
            keep = miss[(size[miss] <= BYTES) & (n[miss] <= IDS)]
            s = slot[keep]
            # of several pieces for one slot the last stays
            _, last = np.unique(s[::-1], return_index=True)
            keep = keep[len(s) - 1 - last]
            s = slot[keep]
            for w, k in zip(key, self.keys, strict=True):
                k[s] = w[keep]
            self.sizes[s], self.n[s] = size[keep], n[keep]
            for j in range(IDS):
                on = n[keep] > j
                self.pool[s[on] * IDS + j] = self.pool[first[keep[on]] + j]
            if len(self.pool) > SLOTS * (IDS + 1):
                self.pool = self.pool[: SLOTS * IDS].copy()
        upto = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        return out, np.diff(upto)


_OPEN: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _OPEN:
        _OPEN[path] = PieceTokenizer(path)
    return _OPEN[path]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ends where ``end_id`` follows each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
