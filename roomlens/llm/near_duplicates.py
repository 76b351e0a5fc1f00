"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets, and its classes.

A document's set holds the hashes of its distinct ``shingle``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; one
shingle of all words if there are fewer). Two documents link when 100 * intersection >= ``percent`` * union. Sets that are
equal are one node (a 64-bit fingerprint), so copies never meet pairwise. Links between different sets come from:

* small sets (up to the boundary): for each partner size the fixed-size subsets that a link needs are enumerated; two sets
  that share one link, so a bucket gives a star, not pairs;
* larger sets: an inverted list for each shingle of the prefix that a link must touch, rare shingles first. A light list
  (up to ``LIGHT`` sets, of a size step of a longer one four times as many) proposes pairs, filtered by size and position and, pair by pair, by parity sketches, whose differing
  bits bound the difference of two sets from below; so long texts that share a shingle by chance are not chained into one
  class. A heavy list proposes a star; what stars connect is a class, whose pairs the sketches judge. What the judged pairs
  connect is a candidate class, judged by the sets themselves. A class is one task, or if large is cut into blocks of bounded
  size, of which only those of near sizes meet, each two in a task of their own, which gives a spanning forest of its pairs.

The boundary is the size at which enumerating subsets stops being cheaper than prefix entries and their expected list work.
Classes are connected components by rounds of large-star and small-star. The shingle order needs which shingles are common:
each partition sends those it has seen ``LOCAL`` times, at most ``COMMON`` are kept; the order changes work, never results.

Cases: null and empty texts have no set, link with nothing and keep their own id; rows of a repeated id with different texts
are separate nodes whose class is the smallest id; null ids are ignored as smallest id if any other is there; extra
columns are left out. Results are exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_hot, small_or_plain, trim, utf8, window_hashes

SHINGLE, PERCENT = 3, 90
#: A partition names a shingle as common from so many documents on; so many are kept at most (16 bytes each).
LOCAL, COMMON = 2, 1 << 20
#: Most sets of a light list, and times as many of a size step of a heavy list; most sets and shingles of a block of a heavy class.
LIGHT, STEP_LIGHT, BLOCK_SETS, BLOCK_SHINGLES = 32, 4, 128, 400_000
#: Edges of one task of a component round.
EDGES = 20_000
#: Most sets of very many copies that are sent to all tasks.
HOT_SETS = 200_000
#: Sizes over this are never enumerated; it bounds the table of sizes sent to the driver.
SMALLEST_LARGE = 48


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def largest(n: int, percent: int = PERCENT) -> int:
    """Largest size linked with n."""
    return 100 * n // percent


def prefix(n: int, percent: int = PERCENT) -> int:
    """Shingles of which one must be shared: n less the smallest intersection, plus one."""
    return n - -(-percent * n // 100) + 1


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(window_hashes(h, min(shingle, len(h))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parity of how many hashes fall on each of about half as many bits as the set has hashes (a power of two, 256 at least)."""
    width = max(256, 1 << max(0, (len(s) // 2 - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def nodes_and_common(docs: DataFrame, shingle: int) -> DataFrame:
    """One pass over the texts (i, t): a row (i, fp, n, sk) for each document, and rows (s, k) of the shingles that a
    partition has seen in at least ``LOCAL`` documents."""
    id_type = dict(docs.dtypes)["i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, keys, ns, schema = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), None

        def fold():
            nonlocal keys, ns
            k, n = np.unique(np.concatenate(held), return_counts=True)
            # shingles seen once are let go when the table is folded: they are not common here
            allk = np.concatenate([keys, k[n > 1]])
            alln = np.concatenate([ns, n[n > 1]])
            keys, at = np.unique(allk, return_inverse=True)
            ns = np.bincount(at, alln, len(keys)).astype(np.int64)

        names = ["i", "fp", "n", "sk", "s", "k"]
        for b in batches:
            schema = b.schema.field(0).type
            own = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            held += own
            have += sum(map(len, own))
            none = pa.nulls(len(b), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(x) if len(x) else None for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()),
                 pa.array([sketch(x) if len(x) else None for x in own], pa.binary()), none, none], names)
            if have > 500_000:
                fold()
                held, have = [], 0
        if held:
            fold()
        on = ns >= LOCAL
        if on.any():
            none = pa.nulls(int(on.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(none), schema), none, none, pa.nulls(len(none), pa.binary()), pa.array(signed(keys[on])), pa.array(ns[on])], names)
        held.clear()
        trim()

    return docs.mapInArrow(run, f"i {id_type}, fp long, n long, sk binary, s long, k long")


def common_shingles(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the common shingles, sorted by hash; a higher rank is more common. All shingles from the least count
    on that leaves at most ``COMMON`` of them, found from the table of counts."""
    counts = cut(found.filter("s is not null").groupBy("s").agg(F.sum("k").cast("int").alias("k")))
    room, least = COMMON, 1 << 30
    for r in sorted(counts.groupBy(F.least("k", F.lit(1 << 14)).alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["k"]
    top = counts.filter(F.col("k") >= least).toArrow()
    h, k = top.column("s").to_numpy().view(np.uint64), top.column("k").to_numpy()
    order = np.lexsort((h, k))
    rank = np.empty(len(h), np.int32)
    rank[order] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def ordered(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], take: int) -> np.ndarray:
    """The first ``take`` shingles of the global order: uncommon ones by hash, then common ones from rare to frequent."""
    keys, rank = common
    if len(keys):
        at = np.searchsorted(keys, s)
        at[at == len(keys)] = 0
        r = np.where(keys[at] == s, rank[at], 0)
        rare = s[r == 0]
        if len(rare) >= take:
            return rare[:take]
        return s[np.lexsort((s, r))][:take]
    return s[:take]


def subset_cost(n: int, percent: int) -> int:
    """Subsets that a set of size n enumerates over all partner sizes."""
    cost = 0
    for m in range(-(-percent * n // 100), largest(n, percent) + 1):
        t = need(n, m, percent)
        if t <= min(n, m) and not (n == m == t):
            cost += math.comb(n, t)
    return cost


def boundary(sizes: dict[int, int], percent: int, list_work: float) -> int:
    """Largest size up to which enumeration costs no more than prefix entries with ``list_work`` comparisons each."""
    best, gain, total = 0, 0.0, 0.0
    for n in range(1, SMALLEST_LARGE + 1):
        total += sizes.get(n, 0) * (prefix(n, percent) * (1 + list_work) - subset_cost(n, percent))
        if total >= gain:
            best, gain = n, total
    return best


def entries(texts: DataFrame, common, small: int, shingle: int, percent: int) -> DataFrame:
    """Bucket entries (key, fp, n, at, kind) of every document: kind 0 is a list entry; else a subset entry, whose two
    sides (1, 2) are the sizes n < m, or 3 where both sizes are equal."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one partition need no second entry
        for b in batches:
            key, fp, size, at, kind = [], [], [], [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, shingle)
                n = len(s)
                if n == 0:
                    continue
                f = fingerprint(s)
                if f in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(f)
                if n <= small:
                    for m in range(-(-percent * n // 100), min(largest(n, percent), small) + 1):
                        k = need(n, m, percent)
                        if k > min(n, m) or n == m == k:
                            continue
                        side = 3 if n == m else 1 if n < m else 2
                        salt = xxhash.xxh3_64_intdigest(f"{min(n, m)}:{max(n, m)}")
                        for sub in itertools.combinations(s.tolist(), k):
                            key.append(xxhash.xxh3_64_intdigest(np.array(sub, np.uint64).tobytes(), salt) - (1 << 63))
                            kind.append(side)
                            at.append(0)
                            fp.append(f)
                            size.append(n)
                if largest(n, percent) > small:  # a link with a large set is possible
                    p = ordered(s, common=shared.value, take=prefix(n, percent))
                    key += signed(p).tolist()
                    kind += [0] * len(p)
                    at += range(len(p))
                    fp += [f] * len(p)
                    size += [n] * len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), pa.array(at, pa.int32()), pa.array(kind, pa.int8())],
                ["key", "fp", "n", "at", "kind"])
        seen.clear()
        trim()

    return texts.mapInArrow(run, "key long, fp long, n int, at int, kind byte")


def light_pairs(buckets: DataFrame, small: int, percent: int) -> DataFrame:
    """Pairs proposed by lists of at most STEP_LIGHT * LIGHT sets; ``buckets``: (key, sets array<struct<at,fp,n>>)."""
    a, b = F.col("a"), F.col("b")
    one = buckets.select("sets", F.posexplode("sets").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("sets", F.col("i") + 2, STEP_LIGHT * LIGHT)).alias("b"))
    least = F.ceil(F.lit(percent) * (a["n"] + b["n"]) / F.lit(100 + percent))
    rest = F.least(a["n"] - a["at"], b["n"] - b["at"])  # shingles from here on, this one included
    fits = (F.greatest(a["n"], b["n"]) * percent <= F.least(a["n"], b["n"]) * 100) & (F.greatest(a["n"], b["n"]) > small)
    # at the first shared prefix shingle nothing before is shared, so the intersection is at most ``rest``; one list where it is enough proposes the pair
    return two.filter(fits & (rest >= least)).select(F.least(a["fp"], b["fp"]).alias("u"), F.greatest(a["fp"], b["fp"]).alias("v")).distinct()


def possible_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sketches allow, each judged by itself. ``reps``: (fp, n, sk)."""
    side = lambda k: reps.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("sk").alias(f"sk{k}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "sku", "skv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy() + b.column(3).to_numpy()
            differ = np.fromiter(itertools.starmap(differing, zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)), np.int64, len(b))
            at = pa.array(np.flatnonzero(differ <= allowed(size, percent)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])
        trim()

    return met.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of edges (u, v), label the smallest node; large-star and small-star rounds until
    nothing changes. A round has a task for each ``EDGES`` edges, as each task of each exchange leaves two files, however few its rows."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    parts = e.count() // EDGES + 1
    e = e.coalesce(parts)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
        large = join_hot(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = join_hot(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").coalesce(parts).distinct()
        e = cut(small.coalesce(parts))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    low = e.groupBy("u").agg(F.min("v").alias("label"))
    return low.select(F.col("u").alias("node"), "label").unionByName(low.select(F.col("label").alias("node"), "label").distinct())


def forest(ok: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs marked in ``ok``; between two sides, if both are there, only pairs across count."""
    if left.any() and not left.all():
        ok = ok & (left[:, None] != left[None, :])
    root = list(range(len(ok)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(ok)):
        for j in np.flatnonzero(ok[i, :i]).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((i, j))
    return out


def allowed(size: np.ndarray, percent: int) -> np.ndarray:
    """Most elements that differ between linked sets whose sizes sum to ``size``."""
    return size - 2 * -(-percent * size // (100 + percent))


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ between two sketches; a wider one is folded onto a narrower one by exclusive or."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def possible(sketches: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that sizes and sketches allow. Bits that differ are at most the elements that differ, and a link allows so
    many of these; a wider sketch is folded onto a narrower one by exclusive or."""
    width = np.array([8 * len(x) for x in sketches])
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in sketches]
    size = n[:, None] + n[None, :]
    allow = allowed(size, percent)
    ok = np.zeros((len(n), len(n)), bool)
    for w in np.unique(width):
        rows = np.flatnonzero(width >= w)
        x = np.array([np.bitwise_xor.reduce(bits[k].reshape(-1, w), axis=0) for k in rows], np.float32)
        ones = x.sum(1)
        differ = ones[:, None] + ones[None, :] - 2 * (x @ x.T)
        here = np.minimum(width[rows][:, None], width[rows][None, :]) == w
        ok[np.ix_(rows, rows)] |= here & (differ <= allow[np.ix_(rows, rows)])
    return ok & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))


def linked(sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that link, by exact intersections: products of the incidence matrix of the shingles that some, not all, share."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    _, tok, times = np.unique(flat, return_inverse=True, return_counts=True)
    every = int((times == m).sum())
    on = (times[tok] > 1) & (times[tok] < m)
    owner, tok = owner[on], tok[on]
    used, tok = np.unique(tok, return_inverse=True)
    both = np.zeros((m, m), np.float32)
    for lo in range(0, len(used), 4096):
        k = (tok >= lo) & (tok < lo + 4096)
        x = np.zeros((m, min(4096, len(used) - lo)), np.float32)
        x[owner[k], tok[k] - lo] = 1
        both += x @ x.T
    return (both.astype(np.int64) + every) * (100 + percent) >= percent * (n[:, None] + n[None, :])


def tasks(nodes: DataFrame, percent: int) -> DataFrame:
    """Tasks of candidate classes. ``nodes``: (label, fp, n, rest). A class of bounded size is one task; a larger one is cut by
    size step and hash into blocks of bounded size, and each two blocks of equal or next steps are a task (two linked sets
    are at most one step apart). Rows: task key (label, pc, po, qc, qo), left (side of the first block), fp, n, rest."""
    step = math.log(100 / percent)
    x = nodes.withColumn("c", F.floor(F.log("n") / step).cast("int"))
    counts = x.groupBy("label", "c").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    ks = F.map_from_entries(F.collect_list(F.struct("c", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("k"))))
    # classes of more than one task, with the blocks of each size step (a few dozen); all others are one task
    large = cut(counts.groupBy("label").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), ks.alias("ks")).filter((F.col("m") > BLOCK_SETS) | (F.col("s") > BLOCK_SHINGLES)).select("label", "ks"))
    x = join_hot(x, large, "label", "left").withColumn("c", F.when(F.col("ks").isNull(), 0).otherwise(F.col("c")))
    x = x.withColumn("ks", F.coalesce("ks", F.create_map(F.lit(0), F.lit(1))))
    k = lambda d: F.coalesce(F.col("ks")[F.col("c") + d], F.lit(0))
    x = x.withColumn("o", F.pmod(F.xxhash64("fp"), k(0).cast("long")).cast("int"))
    here = F.struct(F.col("c").alias("c"), F.col("o").alias("o"))
    to = lambda d: F.transform(F.sequence(F.lit(0), F.greatest(k(d) - 1, F.lit(0))), lambda j: F.struct((F.col("c") + d).alias("c"), j.cast("int").alias("o")))
    none = F.slice(to(0), 1, 0)
    others = F.flatten(F.array(to(0), F.when(k(-1) > 0, to(-1)).otherwise(none), F.when(k(1) > 0, to(1)).otherwise(none)))
    dealt = x.withColumn("other", F.explode(others)).withColumn("p", F.least(here, F.col("other"))).withColumn("q", F.greatest(here, F.col("other")))
    return dealt.select("label", F.col("p.c").alias("pc"), F.col("p.o").alias("po"), F.col("q.c").alias("qc"), F.col("q.o").alias("qo"), (here == F.col("p")).alias("left"), "fp", "n", "rest")


KEY = ["label", "pc", "po", "qc", "qo"]


def solve(rows: DataFrame, kernel) -> DataFrame:
    """Edges (u, v): a spanning forest of each task's pairs by ``kernel(payloads, sizes)``. ``rows``: (task key, left, fp, n,
    load binary). A task's rows meet sorted in one partition; Python holds one task at a time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select(*KEY, "left", "fp", "n", "load").repartition(parts, *KEY).sortWithinPartitions(*KEY, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> pa.RecordBatch:
            fps, got = list(held), []
            if len(fps) > 1:
                left, n, load = zip(*held.values(), strict=True)
                got = forest(kernel(list(load), np.array(n, np.int64)), np.array(left, bool))
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i, _ in got], pa.int64()), pa.array([fps[j] for _, j in got], pa.int64())], ["u", "v"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(9)]
            for *k, left, fp, n, load in zip(*cols, strict=True):
                if k != now:
                    if held:
                        yield done()
                    now, held = k, {}
                held[fp] = (left, n, load)
        if held:
            yield done()
        held = {}
        trim()

    return met.mapInArrow(run, "u long, v long")


def with_sets(dealt: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Task rows with their sets, made from the texts (i, t) of the representatives."""
    rows = texts.join(small_or_plain(dealt), F.col("i").eqNullSafe(F.col("rest"))).select(*KEY, "left", "fp", "n", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[bytes, tuple[int, bytes]] = {}
            keep, s = [], []
            for k, (fp, t) in enumerate(zip(b.column(6).to_pylist(), b.column(8).to_pylist(), strict=True)):
                if t not in made:
                    x = shingle_set(t, shingle)
                    made[t] = (fingerprint(x) if len(x) else 0, x.tobytes())
                if made[t][0] == fp:  # a repeated id may bring another text
                    keep.append(k)
                    s.append(made[t][1])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(8)), pa.array(s, pa.binary())], [*KEY, "left", "fp", "n", "load"])
        trim()

    return rows.mapInArrow(run, "label long, pc int, po int, qc int, qo int, left boolean, fp long, n long, load binary")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: id, n_shingles, component_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("i"), utf8(text_col).alias("t"))
    found = cut(nodes_and_common(texts, shingle))
    common = common_shingles(found)
    rows = found.filter("s is null").select("i", "fp", "n", "sk")
    # one row for each different set: its smallest id, and one text row that has it
    reps = cut(rows.filter("fp is not null").groupBy("fp").agg(F.min("i").alias("rep"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.count("*").alias("copies")))
    sizes = {r["n"]: r["k"] for r in reps.filter(F.col("n") <= SMALLEST_LARGE).groupBy("n").agg(F.count("*").alias("k")).collect()}
    small = boundary(sizes, percent, list_work=1.0)

    # single entries are most; they end in the count, only fuller buckets go on with their sets
    entry = entries(texts.select("t"), common, small, shingle, percent)
    # one exchange by key serves the grouping and the counts; a common list spills, it is not held
    dealt = entry.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    grouped = dealt.groupBy("key", "kind", "fp").agg(F.first("n").alias("n"), F.min("at").alias("at"))
    own = Window.partitionBy("key")
    full = cut(grouped.select("*", F.count("*").over(own).alias("k"), F.min(F.when(F.col("kind") != 2, F.col("fp"))).over(own).alias("x"),
                              F.min(F.when(F.col("kind") != 1, F.col("fp"))).over(own).alias("y")).filter("k > 1"))
    sub = full.filter("kind <> 0")
    stars = sub.filter((F.col("kind") != 2) & F.col("y").isNotNull()).select(F.col("fp").alias("u"), F.col("y").alias("v")).unionByName(
        sub.filter((F.col("kind") != 1) & F.col("x").isNotNull()).select(F.col("fp").alias("u"), F.col("x").alias("v")))
    lists = full.filter("kind = 0")
    # a heavy list is first split by size: linked sets are at most one size step apart
    step = math.log(100 / percent)
    c = F.floor(F.log("n") / step).cast("int")
    part = Window.partitionBy("key", "c")
    split = lists.filter(F.col("k") > LIGHT).select("key", "fp", "n", "at", F.explode(F.array(c, c + 1)).alias("c"))
    split = cut(split.select("*", F.count("*").over(part).alias("k"), F.min("fp").over(part).alias("x")))
    packed = F.sort_array(F.collect_list(F.struct("at", "fp", "n"))).alias("sets")
    light = lists.filter(F.col("k") <= LIGHT).groupBy("key").agg(packed).select("sets")
    light = light.unionByName(split.filter(F.col("k").between(2, STEP_LIGHT * LIGHT)).groupBy("key", "c").agg(packed).select("sets"))
    heavy = split.filter(F.col("k") > STEP_LIGHT * LIGHT).select(F.col("fp").alias("u"), F.col("x").alias("v"))
    # pairs, and classes of heavy lists, are first cut down by sketches, a hundredth of the sets' size, then by the sets themselves
    wide = components(heavy).join(reps, F.col("node") == F.col("fp")).select("label", "fp", "n", F.col("sk").alias("rest"))
    near = solve(tasks(cut(wide), percent).withColumnRenamed("rest", "load"), lambda x, n: possible(x, n, percent))
    near = near.unionByName(possible_pairs(light_pairs(light, small, percent), reps, percent))
    narrow = components(near).join(reps, F.col("node") == F.col("fp")).select("label", "fp", "n", F.col("rep").alias("rest"))
    exact = with_sets(cut(tasks(cut(narrow), percent)), texts, shingle)
    edges = solve(exact, lambda x, n: linked([np.frombuffer(b, np.uint64) for b in x], n, percent)).unionByName(stars)
    label = components(edges)
    known = cut(label.join(reps, label["node"] == reps["fp"]).select("label", "fp", "rep"))
    low = known.groupBy("label").agg(F.min("rep").alias("low"))
    of_class = join_hot(known, low, "label").select("fp", "low")
    ids = cut(reps.join(of_class, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), "copies"))
    # sets of very many copies are few enough to be sent; the others meet their rows by a join, rows without a set by none
    least = max(1000, (ids.agg(F.sum("copies")).first()[0] or 0) // HOT_SETS + 1)
    hot = ids.filter(F.col("copies") >= least).select("fp", F.col("component_id").alias("_hot"))
    rows = rows.drop("sk").join(small_or_plain(hot), "fp", "left")
    cold = rows.filter(F.col("fp").isNotNull() & F.col("_hot").isNull()).drop("_hot").join(ids.drop("copies"), "fp", "left")
    rest = rows.filter(F.col("fp").isNull() | F.col("_hot").isNotNull()).withColumnRenamed("_hot", "component_id")
    return cold.unionByName(rest).select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "i").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the one of smallest id of each class; columns stay as they are. Where ids repeat, rows are told apart by id and
    text, so rows of one id with unlike texts all stay, and of rows equal in both one does; null ids come last. Where they do not,
    a null id stays."""
    many = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter(F.col("count") > 1).limit(1).count()
    key, keyed = id_col, docs
    if many:
        key = "_roomlens_key"
        keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("h")))
    c = classes(keyed.select(key, text_col), id_col=key, text_col=text_col, **kw)
    gone = cut(c.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_roomlens_gone")).distinct())
    kept = keyed.join(small_or_plain(gone), F.col(key) == F.col("_roomlens_gone"), "left_anti")
    return kept.dropDuplicates([key]).drop(key) if many else kept
