"""Toxicity: a linear-chain conditional random field over words, two states (clean, toxic).

Training tokens are labelled from document labels: of the words and word beginnings (``PREFIXES``), those that
stand in toxic training documents significantly more often than in clean ones, and far above their share of these, are
offending, and their places in toxic documents get the label toxic. This is tested over all training texts, and, since one language may be rare, once more
within each of ``GROUPS`` groups of texts that are alike in their letters (k-means of trigram profiles of the texts alone; neither a language column nor any
other but text and label is read). The field scores a word, its
beginnings, its neighbours and the change of state, so inflected forms share weight, whatever the language;
forward-backward marginals of every word of the whole text give the document's four features (highest marginal, logs of the
summed marginals, of the offending words and of the summed marginals per thousand words), and logistic regression on these gives the score.
Offending offsets are the code points of words whose marginal is at least 0.5.

The training set is a bounded sample of labelled documents: at most ``TOXIC_DOCS`` toxic and ``CLEAN_DOCS`` clean ones,
taken in the order of a hash of their id from rows whose crc32(id) mod 4 is not 2. Everything else covers all rows.

Cases: a null text is empty; an empty text has no words and gets the score of the features 0, 0; ids that repeat in the
labels, and texts that repeat, are toxic if one row says so; rows with a null id or label do not train; without toxic or clean training documents the score is 0.0 for all; extra columns pass
through ``tag``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WORD_TABLE, alnum_words, bound_batches, cut, held_out, trim, utf8, word_hashes

TOXIC_DOCS, CLEAN_DOCS = 2000, 4000
#: A window of training words, and how many windows a training document gives at most.
SPAN, WINDOWS = 41, 4
#: An offending term stands in so many toxic training documents (of its group) at least, with this log ratio to the clean
#: ones; by chance, at most ``ALPHA`` such terms are expected in a group (Chernoff bound, shared out over its terms).
LEAST, LOG_RATIO, ALPHA = 3, 3.0, 0.05
#: Bytes of the beginnings of a word that are terms and features.
PREFIXES = (4, 5, 6, 7, 8)
#: score >= this is predicted toxic.
DECISION = 0.3
#: Groups of texts by their letters, and the parts into which trigrams are hashed.
GROUPS, PROFILE = 6, 512
#: Words of one lane of the two-level scan.
LANE = 256


def chain_marginals(e: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every word of a stream of documents. ``e``: log potential of toxic against clean; ``starts``: first
    words of documents; ``trans``: 2x2 log potentials. A matrix for each word carries the forward vector on; at a start
    both rows are equal, which forgets the document before. Lanes are multiplied out side by side, joined, then run."""
    n = len(e)
    if n == 0:
        return np.zeros(0)
    lanes = -(-n // LANE)
    size = lanes * LANE
    psi = np.ones(size)
    psi[:n] = np.exp(np.clip(e, -30, 30))
    t = np.exp(trans)
    m = [np.full(size, x) for x in (t[0, 0], t[0, 1], t[1, 0], t[1, 1])]
    for x in m:
        x[starts] = x[n:] = 1.0
    m[1] *= psi
    m[3] *= psi
    a, b, c, d = (np.ascontiguousarray(x.reshape(lanes, LANE).T) for x in m)
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(LANE):
        p, q, r, s = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        if k % 8 == 7:
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
    top = np.maximum(np.maximum(p, q), np.maximum(r, s))
    p, q, r, s = (x / top for x in (p, q, r, s))
    first, last = np.empty((2, lanes)), np.empty((2, lanes))
    u, v = 1.0, 1.0
    for k, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        first[:, k] = u, v
        u, v = u * w + v * y, u * x + v * z
        h = u + v
        u, v = u / h, v / h
    u, v = 1.0, 1.0
    for k, (w, x, y, z) in reversed(list(enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)))):
        last[:, k] = u, v
        u, v = w * u + x * v, y * u + z * v
        h = u + v
        u, v = u / h, v / h
    fwd, bwd = np.empty((LANE, lanes)), np.empty((LANE, lanes))
    u, v = first
    for k in range(LANE):
        u, v = u * a[k] + v * c[k], u * b[k] + v * d[k]
        h = u + v
        u, v = u / h, v / h
        fwd[k] = v
    u, v = last
    for k in range(LANE - 1, -1, -1):
        h = u + v
        u, v = u / h, v / h
        bwd[k] = v
        u, v = a[k] * u + b[k] * v, c[k] * u + d[k] * v
    on = fwd * bwd
    return np.ascontiguousarray((on / (on + (1 - fwd) * (1 - bwd))).T).reshape(-1)[:n]


def terms(words: set[bytes]) -> set[bytes]:
    """The words, marked =, and their beginnings, marked ^."""
    return {b"=" + x for x in words} | {b"^" + x[:k] for x in words for k in PREFIXES if len(x) >= k}


def families(found: dict[bytes, int]) -> set[bytes]:
    """The significant terms without beginnings that stand in hardly more toxic documents than one word: those are no family."""
    best: dict[bytes, int] = {}
    for t, p in found.items():
        if t[:1] == b"=":
            for k in PREFIXES:
                best[b"^" + t[1 : k + 1]] = max(p, best.get(b"^" + t[1 : k + 1], 0))
    return {t for t, p in found.items() if t[:1] == b"=" or p - best.get(t, 0) >= LEAST}


def prefix_hashes(words: list[bytes]) -> np.ndarray:
    """(beginnings, words): a hash of each beginning, told apart by its length; 0 where the word is shorter."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.stack([np.where(sizes >= k, word_hashes([x[:k] for x in words]) | np.uint64(k << 32), np.uint64(0)) for k in PREFIXES])


def places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted ``keys``; their number if it does not."""
    if len(keys) == 0:
        return np.zeros(h.shape, np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, at, len(keys))


def fit_chain(words: np.ndarray, y: np.ndarray, prefixes: np.ndarray | None = None, epochs: int = 10, batch: int = 128, rate: float = 0.5, l2: float = 1e-4) -> dict:
    """Adagrad on the likelihood of windows. ``words``: (windows, SPAN) hashes, 0 beyond the text; ``y``: labels 0 or 1;
    ``prefixes``: the hashes of the beginnings of each distinct word other than 0, in the order of the word hashes.
    Features: the word before, the word, the word after (each hashed whole), the beginnings of the word that several words
    have, a bias, and the transitions."""
    keys = np.unique(words[words != 0])
    n = len(keys) + 1
    at = np.where(words != 0, np.searchsorted(keys, words), len(keys))
    heads = np.zeros((len(PREFIXES), len(keys)), np.uint64) if prefixes is None else prefixes
    heads_of, often = np.unique(heads[heads != 0], return_counts=True)
    pkeys = heads_of[often >= 2]
    stems = np.hstack([places(pkeys, heads), np.full((len(PREFIXES), 1), len(pkeys))])
    pw, gp = np.zeros(len(pkeys) + 1), np.full(len(pkeys) + 1, 1e-2)
    w, b, tr = np.zeros((3, n)), -2.0, np.zeros((2, 2))
    gw, gb, gt = np.full((3, n), 1e-2), 1e-2, np.full((2, 2), 1e-2)
    rng = np.random.default_rng(11)
    off = np.full((len(at), 1), len(keys))
    feats = np.stack([np.hstack([off, at[:, :-1]]), at, np.hstack([at[:, 1:], off])])
    size = at.shape[1]
    for _ in range(epochs):
        order = rng.permutation(len(at))
        for lo in range(0, len(order), batch):
            k = order[lo : lo + batch]
            f, lab = feats[:, k], y[k]
            stem = stems[:, f[1]]
            e = np.clip(b + w[0][f[0]] + w[1][f[1]] + w[2][f[2]] + pw[stem].sum(0), -30, 30)
            psi = np.stack([np.ones_like(e), np.exp(e)], 2)
            t = np.exp(tr)
            al, be = np.empty_like(psi), np.ones_like(psi)
            al[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
            for i in range(1, size):
                x = (al[:, i - 1] @ t) * psi[:, i]
                al[:, i] = x / x.sum(1, keepdims=True)
            for i in range(size - 2, -1, -1):
                x = (psi[:, i + 1] * be[:, i + 1]) @ t.T
                be[:, i] = x / x.sum(1, keepdims=True)
            p = al * be
            p = p[..., 1] / p.sum(2)
            pair = al[:, :-1, :, None] * t * (psi * be)[:, 1:, None, :]
            pair = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
            seen = np.zeros((2, 2))
            np.add.at(seen, (lab[:, :-1].ravel(), lab[:, 1:].ravel()), 1)
            d = (p - lab) / len(k)
            for j in range(3):
                g = np.bincount(f[j].ravel(), d.ravel(), n) + l2 * w[j]
                g[-1] = 0
                gw[j] += g * g
                w[j] -= rate * g / np.sqrt(gw[j])
            g = np.bincount(stem.ravel(), np.broadcast_to(d, stem.shape).ravel(), len(pw)) + l2 * pw
            g[-1] = 0
            gp += g * g
            pw -= rate * g / np.sqrt(gp)
            g = d.sum()
            gb += g * g
            b -= rate * g / np.sqrt(gb)
            g = (pair - seen) / len(k)
            gt += g * g
            tr -= rate * g / np.sqrt(gt)
    return {"keys": keys, "w": w, "pkeys": pkeys, "pw": pw, "bias": float(b), "trans": tr}


def emissions(model: dict, words: list[list[bytes]], h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log potential of toxic against clean of each word of the stream; neighbours do not reach over document ends."""
    keys, w = model["keys"], model["w"]
    if len(keys) == 0:
        return np.full(len(h), model["bias"])
    at = places(keys, h)
    e = model["bias"] + w[1][at]
    if len(model["pkeys"]) and len(h):
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        flat = [x for own in words for x in own]
        e += model["pw"][places(model["pkeys"], prefix_hashes([flat[k] for k in first.tolist()]))].sum(0)[of]
    before, after = w[0][at], w[2][at]
    add = np.empty_like(e)
    add[1:] = before[:-1]
    add[starts] = 0
    e += add
    add[:-1] = after[1:]
    add[-1:] = 0
    add[starts[1:] - 1] = 0
    return e + add


def stream(texts) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all their hashes, and where texts with words start."""
    words = [alnum_words(bytes(t)) for t in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    h = np.concatenate([word_hashes(x) for x in words]) if len(words) else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    return words, h, begin[sizes > 0]


def doc_features(p: np.ndarray, words: list[list[bytes]]) -> np.ndarray:
    out, k = np.zeros((len(words), 4)), 0
    for i, x in enumerate(words):
        if x:
            part = p[k : k + len(x)]
            total = part.sum()
            out[i] = part.max(), np.log1p(total), np.log1p((part >= 0.5).sum()), np.log1p(1000 * total / len(x))
            k += len(x)
    return out


def letter_profile(text: bytes) -> np.ndarray:
    """Square roots of the counts of hashed trigrams of bytes, A-Z lower-cased and other signs as spaces, to length 1."""
    x = np.frombuffer(text.translate(_WORD_TABLE), np.uint8).astype(np.uint32)
    tri = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - PROFILE.bit_length() + 1)
    v = np.sqrt(np.bincount(tri, minlength=PROFILE))
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def letter_groups(profiles: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Centres of ``GROUPS`` groups: the group that varies most is cut in two across its main direction and both halves settle by k-means, until there are
    enough; then all do."""
    def settle(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            of = (x @ c.T).argmax(1)
            c = np.array([x[of == k].mean(0) if (of == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        return c

    parts = [profiles]
    while len(parts) < GROUPS:
        k = max(range(len(parts)), key=lambda j: len(parts[j]) * parts[j].var(0).sum())
        x = parts.pop(k)
        away = x - x.mean(0)
        main = away @ np.linalg.eigh(away.T @ away)[1][:, -1]
        c = settle(x, np.array([x[main <= 0].mean(0) if (main <= 0).any() else x[0], x[main > 0].mean(0) if (main > 0).any() else x[0]]))
        of = (x @ c.T).argmax(1)
        parts += [x[of == 0], x[of == 1]] if 0 < of.sum() < len(x) else [x, x[:1]]
    return settle(profiles, np.array([x.mean(0) for x in parts]))


def offsets(text: bytes, on: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the words marked in ``on``."""
    plain = np.frombuffer(text.translate(_WORD_TABLE), np.uint8)
    edge = np.diff(np.concatenate([[0], (plain != 0x20).view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1)[on], np.flatnonzero(edge == -1)[on]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(x), int(y)) for x, y in zip(points[a], points[b], strict=True)]


def fit_scores(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge: the bias, then a weight for each feature."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> dict:
    """Train the field and the document score on the bounded sample; what reaches the driver is bounded by it."""
    spark = docs.sparkSession
    bound_batches(spark)
    marks = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_i")).agg(F.max("toxic").alias("_y")).withColumn("_h", F.xxhash64("_i"))
    )
    pick = marks.filter("_y = 1").orderBy("_h", "_i").limit(toxic_docs).unionByName(marks.filter("_y != 1").orderBy("_h", "_i").limit(clean_docs))
    texts = docs.select(F.col(id_col).alias("_i"), utf8(text_col).alias("t")).join(F.broadcast(pick.select("_i", "_y")), "_i").select("t", F.col("_y").cast("int").alias("y"))
    sample = cut(texts.groupBy("t").agg(F.max("y").alias("y")))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([letter_profile(t).astype(np.float32).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["p"])

    known = sorted(bytes(r["p"]) for r in sample.mapInArrow(profiles, "p binary").collect())
    centres = letter_groups(np.frombuffer(b"".join(known), np.float32).reshape(-1, PROFILE)) if known else np.zeros((GROUPS, PROFILE))
    own = lambda t: str(int((centres @ letter_profile(t)).argmax()))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own(t) for t in b.column(0).to_pylist()], pa.string())], ["t", "y", "l"])

    sample = cut(sample.mapInArrow(grouped, "t binary, y int, l string"))

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, y, ls = [], [], []
            for t, l, group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of_text = terms(set(alnum_words(t)))
                for name in ("", group):
                    w += of_text
                    y += [int(l == 1)] * len(of_text)
                    ls += [name] * len(of_text)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(y, pa.int32()), pa.array(ls, pa.string())], ["w", "y", "l"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    if not pos or not neg:
        return {"keys": np.zeros(0, np.uint64), "w": np.zeros((3, 1)), "pkeys": np.zeros(0, np.uint64), "pw": np.zeros(1), "bias": -30.0, "trans": np.zeros((2, 2)), "score": None, "lexicon": []}
    by_word = cut(sample.mapInArrow(word_rows, "w binary, y int, l string").groupBy("l", "w").agg(F.sum("y").alias("p"), F.count("*").alias("n")).filter(F.col("n") >= LEAST))
    docs_of = sample.select("y", F.explode(F.array(F.lit(""), "l")).alias("l")).groupBy("l").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("all"))
    per_group = docs_of.join(by_word.groupBy("l").agg(F.count("*").alias("tests")), "l")
    p, n, q = F.col("p"), F.col("n"), F.col("pos") / F.col("all")
    ratio = F.log((p + 0.5) / (F.col("pos") + 1)) - F.log((n - p + 0.5) / (F.col("all") - F.col("pos") + 1))
    # n times the divergence of the term's toxic share from the group's: minus the log of its chance is at least that
    chance = p * F.log(p / (n * q)) + F.when(p < n, (n - p) * F.log((n - p) / (n * (1 - q)))).otherwise(0.0)
    sure = (p >= LEAST) & (ratio >= LOG_RATIO) & (p > n * q) & (F.when(p >= LEAST, chance) >= F.log(F.col("tests") / ALPHA))
    found: dict[str, dict[bytes, int]] = {}
    for x in by_word.filter(p >= LEAST).join(F.broadcast(per_group), "l").filter(sure).select("l", "w", "p").collect():
        found.setdefault(x["l"], {})[bytes(x["w"])] = x["p"]
    lexicon = {group: families(x) for group, x in found.items()}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ys = [], []
            for t, l, group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = alnum_words(t)
                if not words:
                    continue
                bad = lexicon.get("", set()) | lexicon.get(group, set())
                on = {x for x in set(words) if not bad.isdisjoint(terms({x}))}
                marked = np.array([x in on for x in words])
                lab = (marked & (l == 1)).astype(np.int8)
                hot = np.flatnonzero(marked)
                mid = [*hot[:: max(1, len(hot) // WINDOWS)][: WINDOWS - 1], len(words) // 2]
                for m in mid:
                    lo = max(0, int(m) - SPAN // 2)
                    hs.append(b" ".join(words[lo : lo + SPAN]))
                    ys.append(lab[lo : lo + SPAN].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ys, pa.binary())], ["h", "y"])

    rows = sorted((bytes(r["h"]), bytes(r["y"])) for r in sample.mapInArrow(windows, "h binary, y binary").collect())
    hs, ys = np.zeros((len(rows), SPAN), np.uint64), np.zeros((len(rows), SPAN), np.int64)
    seen: dict[int, bytes] = {}
    for k, (h, y) in enumerate(rows):
        words = h.split(b" ")
        own = word_hashes(words)
        hs[k, : len(words)], ys[k, : len(words)] = own, np.frombuffer(y, np.int8)
        seen.update(zip(own.tolist(), words, strict=True))
    seen.pop(0, None)
    model = fit_chain(hs, ys, prefix_hashes([seen[k] for k in sorted(seen)])) | {"score": None, "lexicon": sorted((group, t) for group, x in lexicon.items() for t in x)}
    shared = spark.sparkContext.broadcast(model)

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            words, h, starts = stream(b.column(0).to_pylist())
            x = doc_features(chain_marginals(emissions(m, words, h, starts), starts, m["trans"]), words)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(4)], b.column(1)], [*"abcd", "y"])
        trim()

    got = sorted(tuple(r) for r in sample.mapInArrow(feats, "a double, b double, c double, d double, y int").collect())
    # the sample holds toxic documents at another rate than the labels: weigh by shifting the bias
    true = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rate = true.get(1, 0) / max(1, sum(true.values()))
    w = fit_scores(np.array([g[:4] for g in got]), np.array([float(g[4] == 1) for g in got]))
    w[0] += np.log(rate / (1 - rate)) - np.log(pos / neg) if 0 < rate < 1 else 0.0
    return model | {"score": w}


def tag(docs: DataFrame, model: dict, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: score (0 to 1), max_marginal, spans (offending code-point offsets)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in it:
            words, h, starts = stream(texts)
            p = chain_marginals(emissions(m, words, h, starts), starts, m["trans"])
            x = doc_features(p, words)
            w = m["score"]
            score = np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            spans, k = [], 0
            for t, own in zip(texts, words, strict=True):
                on = p[k : k + len(own)] >= 0.5
                spans.append([{"start": a, "end": b} for a, b in offsets(bytes(t), on)] if on.any() else [])
                k += len(own)
            yield pd.DataFrame({"score": score.round(9), "max_marginal": x[:, 0], "spans": spans})
        trim()

    kind = "score double, max_marginal double, spans array<struct<start:long,end:long>>"
    return docs.withColumn(out, F.pandas_udf(run, kind)(utf8(text_col)))


def report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", decision: float = DECISION, **kw) -> DataFrame:
    """One row for each document: id, held_out, score, predicted, spans (start:end, comma-joined)."""
    m = tag(docs.select(id_col, text_col), fit(docs, labels, id_col=id_col, text_col=text_col, **kw), text_col=text_col, out="_t")
    spans = F.array_join(F.transform("_t.spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return m.select(id_col, held_out(id_col).alias("held_out"), F.col("_t.score").alias("score"),
                    (F.col("_t.score") >= decision).cast("int").alias("predicted"), spans.alias("spans"))


def reject(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", decision: float = DECISION, **kw) -> DataFrame:
    """``docs`` without those predicted toxic; columns stay as they are."""
    m = tag(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **kw), text_col=text_col, out="_roomlens_tox")
    return m.filter(F.col("_roomlens_tox.score") < decision).drop("_roomlens_tox")
