"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Kinds: email, ip, card, phone. The base finds leftmost non-overlapping matches of each kind and drops those that fail
its check. The network finds what the patterns cannot: other separators, a missing plus, at-signs in brackets, full-width
digits. It is trained in numpy from labelled spans: by default the base spans of at most ``TRAIN_DOCS`` documents with a digit
or at-sign, in the order of a hash of the text; each also stands, with its label, in forms that no base pattern matches
(``disguise``); windows of the same documents without spans stand beside them.

The network reads windows of ``SPAN`` characters every ``STEP``. Each window is decoded by Viterbi over the tags O and
begin/inside of each kind, a character takes the tag and its forward-backward posterior from the window in which it stands most
central, and tags are joined to spans over the whole text. A span is added if its least posterior is at least ``SURE``, its
digits or parts are in its kind's range (``plausible``), and it overlaps no base span. A span must hold a digit or an at-sign
(``_SIGNS``), so only windows within ``AROUND`` characters of one are run; a span reaches at most so far from its last sign.

Cases: null is the empty text, which has no spans; positions are code points, ends exclusive; repeated rows are judged
each on its own; with no training window only base spans are found; extra columns pass through ``find`` and ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, trim

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)

#: Window, step, hidden size of each direction, embedding size, most training documents and windows.
SPAN, STEP, HIDDEN, EMBED = 48, 24, 16, 12
TRAIN_DOCS, TRAIN_WINDOWS = 600, 4000
#: Characters on each side of a sign in which windows are run; least posterior of the tags of an added span.
AROUND, SURE = 64, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """An address is the run of local characters before an at-sign and the domain after it; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


_HAS_DIGIT = re.compile("[0-9]")


#: What every span holds: a digit, also a full-width one, or an at-sign, also a full-width one or the word in brackets.
_SIGNS = re.compile(r"[0-9@\uFF10-\uFF19\uFF20]|[\[({<] ?at ?[\])}>]", re.I)
_WIDE = {k: k - 0xFEE0 for k in range(0xFF01, 0xFF5F)}


def codes(text: str) -> np.ndarray:
    """ASCII characters as they are, their full-width forms like them, other letters and signs as 127, in one array."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 0xFF01) & (c <= 0xFF5E), c - 0xFEE0, c)
    return np.where(c < 127, c, 127).astype(np.uint8)


def disguise(kind: int, found: str) -> list[str]:
    """Forms of a base span that no base pattern matches as a whole."""
    wide = found.translate({k - 0xFEE0: k for k in range(0xFF10, 0xFF1A)})
    if kind == 0:
        local, domain = found.split("@")
        return [f"{local} [at] {domain}", f"{local}(at){domain}", f"{local}\uFF20{domain}", f"{local} @ {domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}"]
    if kind == 1:
        return [found.replace(".", "[.]"), found.replace(".", " . "), found.replace(".", "(.)"), wide]
    digits = re.sub("[^0-9]", "", found)
    if kind == 2:
        four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [".".join(four), "/".join(four), "_".join(four), "  ".join(four), "\u2013".join(four), wide]
    return [found[1:].lstrip(), "00 " + found[1:].lstrip(), "+" + re.sub("[^0-9]+", "/", found[1:]).strip("/"), re.sub("[ -]", "\u2013", found[1:]), "\uFF0B" + wide[1:]]


def disguised(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with each span in another form, chosen by a hash, and where the spans then stand."""
    parts, out, end, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a < end:
            continue
        forms = disguise(kind, text[a:b])
        form = forms[hashlib.blake2b(f"{a}:{text[a:b]}".encode("utf-8", "replace"), digest_size=4).digest()[0] % len(forms)]
        parts += [text[end:a], form]
        size += a - end
        out.append((kind, size, size + len(form)))
        size += len(form)
        end = b
    return "".join([*parts, text[end:]]), out


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def posteriors(e: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, backward, log partition) of a chain with scores ``e`` (T, B, tags) and transitions ``tr``."""
    al = np.empty_like(e)
    al[0] = e[0]
    for t in range(1, len(e)):
        x = al[t - 1][:, :, None] + tr
        m = x.max(1)
        al[t] = e[t] + m + np.log(np.exp(x - m[:, None]).sum(1))
    m = al[-1].max(1)
    z = m + np.log(np.exp(al[-1] - m[:, None]).sum(1))
    be = np.zeros_like(e)
    for t in range(len(e) - 2, -1, -1):
        x = tr + (e[t + 1] + be[t + 1])[:, None, :]
        m = x.max(2)
        be[t] = m + np.log(np.exp(x - m[:, :, None]).sum(2))
    return np.exp(al + be - z[:, None]), al, be, z


class Net:
    """Embedding, one LSTM in each direction, a linear layer to tags, and tag transitions."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {"emb": r.normal(0, 0.3, (129, EMBED)).astype(f), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)).astype(f), "bias": np.zeros(TAGS, f), "trans": np.zeros((TAGS, TAGS), f)}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.3, (EMBED, 4 * HIDDEN)).astype(f)
            self.p["h" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(f)
            b = np.zeros(4 * HIDDEN, f)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.p["c" + d] = b

    def _run(self, c: np.ndarray, d: str, keep: bool):
        """Hidden states (T, B, HIDDEN) of direction ``d`` over codes (B, T)."""
        p, (n, size) = self.p, c.shape
        table = p["emb"] @ p["x" + d] + p["c" + d]
        h, s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, memo = np.empty((size, n, HIDDEN), np.float32), []
        for t in range(size) if d == "f" else range(size - 1, -1, -1):
            z = table[c[:, t]] + h @ p["h" + d]
            g = _sig(z[:, : 3 * HIDDEN])
            u = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            if keep:
                memo.append((t, h, s, i, f, o, u))
            s = f * s + i * u
            h = o * np.tanh(s)
            hs[t] = h
        return hs, memo

    def scores(self, c: np.ndarray) -> np.ndarray:
        hs = np.concatenate([self._run(c, "f", False)[0], self._run(c, "b", False)[0]], 2)
        return hs @ self.p["out"] + self.p["bias"]

    def decode(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags and their posteriors (B, T); windows without a span have posterior 0."""
        e, tr = self.scores(c), self.p["trans"] + _FORBID
        size, n, _ = e.shape
        back = np.empty((size, n, TAGS), np.uint8)
        v = e[0] + _FORBID[0]
        for t in range(1, size):
            x = v[:, :, None] + tr
            back[t] = x.argmax(1)
            v = x.max(1) + e[t]
        tags = np.empty((n, size), np.uint8)
        tags[:, -1] = v.argmax(1)
        for t in range(size - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        sure = np.zeros((n, size), np.float32)
        on = np.flatnonzero(tags.any(1))
        if len(on):
            marg, _, _, _ = posteriors(e[:, on].astype(np.float64), tr.astype(np.float64))
            sure[on] = np.take_along_axis(marg, tags[on].T[:, :, None].astype(np.int64), 2)[:, :, 0].T
        return tags, sure

    def grads(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of tags ``y`` (B, T) and its gradients."""
        p, (n, size) = self.p, c.shape
        (hf, mf), (hb, mb) = self._run(c, "f", True), self._run(c, "b", True)
        hs = np.concatenate([hf, hb], 2)
        e = (hs @ p["out"] + p["bias"]).astype(np.float64)
        tr = p["trans"].astype(np.float64)
        marg, al, be, z = posteriors(e, tr)
        pair = np.exp(al[:-1, :, :, None] + tr + (e[1:] + be[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        b, t = np.arange(n)[:, None], np.arange(size)
        gold = e[t, b, y].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
        de = marg
        de[t, b, y] -= 1
        de = (de / n).astype(np.float32)
        g = {"trans": pair}
        np.add.at(g["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        g["trans"] = (g["trans"] / n).astype(np.float32)
        g["out"] = np.tensordot(hs, de, ((0, 1), (0, 1)))
        g["bias"] = de.sum((0, 1))
        dh = de @ p["out"].T
        g["emb"] = np.zeros_like(p["emb"])
        for d, memo, part in (("f", mf, dh[:, :, :HIDDEN]), ("b", mb, dh[:, :, HIDDEN:])):
            nh, ns = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            gh, table = np.zeros_like(p["h" + d]), np.zeros((129, 4 * HIDDEN), np.float32)
            for t, h0, s0, i, f, o, u in reversed(memo):
                s1 = f * s0 + i * u
                th = np.tanh(s1)
                h1 = part[t] + nh
                ds = h1 * o * (1 - th * th) + ns
                dz = np.concatenate([ds * u * i * (1 - i), ds * s0 * f * (1 - f), h1 * th * o * (1 - o), ds * i * (1 - u * u)], 1)
                gh += h0.T @ dz
                np.add.at(table, c[:, t], dz)
                nh, ns = dz @ p["h" + d].T, ds * f
            g["h" + d], g["c" + d] = gh, table.sum(0)
            g["x" + d] = p["emb"].T @ table
            g["emb"] += table @ p["x" + d].T
        return float((z - gold).mean()), g


def _forbidden() -> np.ndarray:
    """An inside tag follows only its own begin or inside."""
    f = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        f[:, 2 + 2 * k] = -1e4
        f[1 + 2 * k, 2 + 2 * k] = f[2 + 2 * k, 2 + 2 * k] = 0
    return f


_FORBID = _forbidden()


def plausible(kind: int, found: str) -> bool:
    """Whether a decoded span is in its kind's range: numbers of digits, parts, the card's check digit, an at-sign."""
    found = found.translate(_WIDE)
    digits = [x for x in re.split("[^0-9]+", found) if x]
    joined = "".join(digits)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[\[({<] ?at ?[\])}>]) ?[A-Za-z0-9-]+(( ?[\[({<] ?dot ?[\])}>] ?|\.)[A-Za-z0-9-]+)+", found, re.I))
    if kind == 1:
        return len(digits) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in digits) and not re.search("[A-Za-z]", found)
    if kind == 2:
        return 13 <= len(joined) <= 19 and luhn(joined) and not re.search("[A-Za-z]", found)
    return 9 <= len(joined) <= 15 and not re.search("[A-Za-z]", found)


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(size, np.int64)
    for kind, a, b in reversed(spans):
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


def train(windows: list[tuple[bytes, bytes]], steps: int = 350, batch: int = 48, rate: float = 0.02) -> Net | None:
    """Adam over (codes, tags) windows; half of a batch holds spans."""
    if not windows:
        return None
    c = np.array([np.frombuffer(a, np.uint8) for a, _ in windows]).reshape(-1, SPAN)
    y = np.array([np.frombuffer(b, np.uint8) for _, b in windows]).reshape(-1, SPAN).astype(np.int64)
    hot, cold = np.flatnonzero(y.any(1)), np.flatnonzero(~y.any(1))
    if not len(hot):
        return None
    net, r = Net(), np.random.default_rng(3)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        k = np.concatenate([r.choice(hot, batch // 2), r.choice(cold if len(cold) else hot, batch // 2)])
        _, g = net.grads(c[k], y[k])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, x in g.items():
            x = x * min(1.0, 5 / max(norm, 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * x
            v[name] = 0.99 * v[name] + 0.01 * x * x
            net.p[name] = (net.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows within ``AROUND`` characters of a sign."""
    at = np.fromiter((m.start() for m in _SIGNS.finditer(text)), np.int64)
    if not len(at):
        return at
    last = max(0, -(-(len(text) - SPAN) // STEP))
    lo = np.maximum(0, (at - AROUND - SPAN) // STEP + 1)
    hi = np.minimum((at + AROUND) // STEP, last)
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, np.minimum(lo, last), 1)
    np.add.at(edge, hi + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:-1]) * STEP


def added_spans(net: Net | None, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the network that overlap no base span, for each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if net is None:
        return out
    todo = []
    for k, t in enumerate(texts):
        starts = window_starts(t)
        if len(starts):
            c = codes(t)
            todo += [(k, s, c) for s in starts.tolist()]
    merged: dict[int, dict[int, tuple[int, int, float]]] = {}
    for lo in range(0, len(todo), 4096):
        part = todo[lo : lo + 4096]
        w = np.full((len(part), SPAN), 128, np.uint8)
        for i, (_, s, c) in enumerate(part):
            w[i, : len(c[s : s + SPAN])] = c[s : s + SPAN]
        tags, sure = net.decode(w)
        for i, (k, s, c) in enumerate(part):
            own = merged.setdefault(k, {})
            for j in range(len(c[s : s + SPAN])):
                # room to the nearer edge of the window; the ends of the text are no edges
                room = min(j if s else SPAN, SPAN - 1 - j if s + SPAN < len(c) else SPAN)
                if s + j not in own or own[s + j][0] < room:
                    own[s + j] = (room, int(tags[i, j]), float(sure[i, j]))
    for k, own in merged.items():
        taken, t = base[k], texts[k]
        run: tuple[int, int] | None = None
        end, least = -2, 1.0
        for at in [*sorted(own), len(t) + 2]:
            tag = own[at][1] if at in own else 0
            kind = (tag - 1) // 2 if tag else -1
            if run and (at != end + 1 or tag == 0 or kind != run[0] or tag % 2 == 1):
                a, b = run[1], end + 1
                if least >= SURE and plausible(run[0], t[a:b]) and not any(p < b and a < q for _, p, q in taken):
                    out[k].append((run[0], a, b))
                run = None
            if tag % 2 == 1:
                run, least = (kind, at), 1.0
            if tag:
                least = min(least, own[at][2])
            end = at
    return out


def fit(docs: DataFrame, *, text_col: str = "text", train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Net | None:
    """Train from the base spans of a bounded sample; windows, not texts, reach the driver."""
    bound_batches(docs.sparkSession)
    t = F.col(text_col).cast("string")
    key = docs.filter(t.rlike("[0-9@]")).select(F.xxhash64(t).alias("h")).distinct().orderBy("h").limit(train_docs)
    sample = docs.select(t.alias("t"), F.xxhash64(t).alias("h")).join(F.broadcast(key), "h", "left_semi").select("t")

    @F.pandas_udf("array<struct<h:long,c:binary,y:binary>>")
    def cuts(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base, got = base_spans(text), []
            for t, spans, only in ((text, base, False), (*disguised(text, base), True)):
                if only and not spans:
                    continue
                c, y, starts = codes(t), tags_of(len(t), spans), window_starts(t)
                for s in starts[:: max(1, len(starts) // 60)]:
                    x, z = np.full(SPAN, 128, np.uint8), np.zeros(SPAN, np.uint8)
                    x[: len(c[s : s + SPAN])] = c[s : s + SPAN]
                    z[: len(y[s : s + SPAN])] = y[s : s + SPAN]
                    if only and not z.any() or s and z[0] and z[0] % 2 == 0:  # a span cut by the window's start is no example of a begin
                        continue
                    x, z = x.tobytes(), z.tobytes()
                    got.append({"h": int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "big"), "c": x, "y": z})
            out.append(got)
        return pd.Series(out)

    w = cut(sample.select(F.explode(cuts("t")).alias("w")).select("w.*").distinct())
    hot, cold = w.filter(F.hex("y").rlike("[1-9A-F]")), w.filter(~F.hex("y").rlike("[1-9A-F]"))
    rows = [(bytes(r["c"]), bytes(r["y"])) for part in (hot, cold) for r in part.orderBy("h", "c").limit(train_windows // 2).collect()]
    return train(rows)


def put_kinds(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans go as one under the first's kind."""
    parts, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            parts += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def find(docs: DataFrame, net: Net | None, *, text_col: str = "text", out: str = "pii", replace: bool = False) -> DataFrame:
    """``docs`` with a struct column ``out``: base and spans, arrays of (kind, start, end) by kind, then start, and redacted, which with
    ``replace`` is the text with its spans replaced where there are any, else null."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            base = [base_spans(t) for t in texts]
            more = added_spans(shared.value, list(texts), base)
            pack = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
            every = [sorted(b + m) for b, m in zip(base, more, strict=True)]
            new = [put_kinds(t, s) if replace and s else None for t, s in zip(texts, every, strict=True)]
            yield pd.DataFrame({"base": [pack(b) for b in base], "spans": [pack(s) for s in every], "redacted": pd.Series(new, dtype=object)})
        trim()

    one = "array<struct<kind:string,start:long,end:long>>"
    return docs.withColumn(out, F.pandas_udf(run, f"base {one}, spans {one}, redacted string")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans)."""
    m = find(docs.select(id_col, text_col), fit(docs, text_col=text_col), text_col=text_col, out="_p")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("_p.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    count = [of(k) for k in KINDS]
    return m.select(id_col, *count, F.sha2(joined("_p.base").cast("binary"), 256).alias("base_sha256"), joined("_p.spans").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans go as one under the first's kind."""
    m = find(docs, fit(docs, text_col=text_col), text_col=text_col, out="_roomlens_pii", replace=True)
    return m.withColumn(text_col, F.coalesce(F.col("_roomlens_pii.redacted"), F.col(text_col))).drop("_roomlens_pii")
