"""HTML extraction by nearest-URL page differencing.

Markup is read into lines (the blocks of a page, white space folded, character references decoded), each with the zone in
which it stands: the article, page furniture (menus, headers and footers outside an article, sidebars, forms, adverts,
notices, reader comments), or neither. The text is all lines of the article and all unzoned lines that are no boilerplate, in page order.

Boilerplate is found by differencing. Pages are sorted by host, path, id and url. A page that shares nearly all unzoned lines (``COPY_SHARE``)
with the page before it on its host is a copy, as is one with the same lines; copies in succession are one run, however long. A page is paired with the pages
next to its run, the last of the run before and the first of the run behind; lines are aligned by longest common subsequence, and unzoned
lines that a pair shares are deleted. So every page is compared past its copies, and copies of one text keep it.
Unzoned lines that nearly all different pages of a host have (``HOST_SHARE``, at least ``HOST_PAGES``) go too, and do not count where copies are told; pages
whose lines outside the furniture are equal count as one, and a page of nothing else keeps its lines. Lines inside an article always stay.

Cases: null html or url is the empty text; a page without a neighbour on its host keeps its unzoned lines; unclosed and
cut markup is read as far as it goes; repeated rows each give a row; ties in the order do not change which lines are shared.
Sorting goes by the rank over all pages; pages meet the one before in chunks of ``CHUNK`` ranks, runs are numbered by range partitions, and a run's two
neighbours are looked up once and joined to its pages, so a host or a run with a third of all pages is many groups.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, small_or_plain
from .urls import host_path

#: Pages of one group, the share of equal lines that makes a neighbour a copy.
CHUNK, COPY_SHARE = 64, 0.8
#: An unzoned line of this share of a host's different pages, and of so many at least, belongs to the host.
HOST_SHARE, HOST_PAGES = 0.9, 3

ARTICLE, FURNITURE, OTHER = 2, 1, 0

#: Elements whose content is no text, page furniture, and elements inside a line (fixed names of HTML).
RAW = ("script", "style", "template", "noscript", "textarea", "svg", "iframe", "title")
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head")
INLINE = ("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike "
          "strong sub sup time tt u var wbr").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words of class, id or role that mark furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|menu|nav\w*|newsletter|"
    r"notices?|popup|promo\w*|related|replies|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE, _VOID, _RAW, _ASIDE = map(frozenset, (INLINE, VOID, RAW, ASIDE))
_ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of every block in page order."""
    out: list[tuple[str, int]] = []
    buf: list[str] = []
    stack: list[tuple[str, int]] = []  # elements that set a zone
    zone, at = OTHER, 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buf)).split())
        if text:
            out.append((text, zone))
        buf.clear()

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            buf.append(page[at:])
            break
        buf.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = m[1] == "/"
        if name in _RAW:
            if not closing:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _INLINE:
            if name == "br":
                buf.append(" ")
            continue
        flush()
        if closing:
            if any(n == name for n, _ in stack):
                while stack:
                    n, zone = stack.pop()
                    if n == name:
                        break
            continue
        if name in _VOID:
            continue
        inside = zone
        marked = bool(m[3]) and zone != FURNITURE and any(MARKS.search(x) for a in _ATTR.findall(m[3]) for x in a if x)
        if marked or (name in _ASIDE and not (name == "header" and zone == ARTICLE)):
            inside = FURNITURE
        elif name == "article" and zone != FURNITURE:
            inside = ARTICLE
        if inside != zone or any(n == name for n, _ in stack):
            stack.append((name, zone))
            zone = inside
    flush()
    return out


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b`` (bit-parallel rows, then a walk back)."""
    both = set(a) & set(b)
    pa_ = [k for k, x in enumerate(a) if x in both]
    pb = [x for x in b if x in both]
    where: dict = {}
    for j, x in enumerate(pb):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(pb)) - 1
    v, rows = full, [full]
    for k in pa_:
        u = v & where[a[k]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit j of row i: the length grows at column j
    out, j = [], len(pb)
    for i in range(len(pa_), 0, -1):
        if j == 0:
            break
        now, before = rows[i], rows[i - 1]
        mask = (1 << j) - 1
        if (~now & mask).bit_count() == (~before & mask).bit_count():
            continue
        while (~now & ((1 << (j - 1)) - 1)).bit_count() == (~now & ((1 << j) - 1)).bit_count():
            j -= 1
        out.append(pa_[i - 1])
        j -= 1
    return out[::-1]


def free_lines(own: list, zones: bytes, of_host: set) -> set[int]:
    """Places of unzoned lines that do not belong to the whole host."""
    return {k for k, z in enumerate(zones) if z == OTHER and own[k] not in of_host}


def is_copy(own: list, zones: bytes, other: list, their: bytes, of_host: set) -> bool:
    """Whether two pages share nearly all of their free lines, of which a single one makes no copy, or have the same lines outside the furniture."""
    if [x for x in zip(own, zones) if x[1] != FURNITURE] == [x for x in zip(other, their) if x[1] != FURNITURE]:
        return True
    free = free_lines(own, zones, of_host)
    most = max(len(free), len(free_lines(other, their, of_host)))
    return most > 1 and len(free) >= COPY_SHARE * most and len(free.intersection(common(own, other))) >= COPY_SHARE * most


def shared_lines(own: list, zones: bytes, others: list[tuple[list, bytes]], of_host: set) -> list[int]:
    """Places of free lines of a page that it shares with the pages beside its run, if those are no copies of it."""
    free, gone = free_lines(own, zones, of_host), set()
    for other, their in others if free else ():
        if not is_copy(own, zones, other, their, of_host):
            gone |= free.intersection(common(own, other))
    return sorted(gone)


def line_hash(text: str) -> int:
    """A 64-bit hash of a line, signed."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def main_text(own: list[tuple[str, int]], gone: set[int], of_host: set[int] = frozenset()) -> str:
    """The lines of the article and the unzoned ones that remain, in page order."""
    kept = [(t, z) for k, (t, z) in enumerate(own) if z != FURNITURE and not (z == OTHER and k in gone)]
    less = [(t, z) for t, z in kept if z != OTHER or line_hash(t) not in of_host] if of_host else kept
    return "\n\n".join(t for t, _ in less or kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_pages: int = CHUNK) -> DataFrame:
    """One row for each page: id, url, text, n_chars."""
    spark = pages.sparkSession
    bound_batches(spark)
    host, path = host_path(F.col("u"))
    base = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("x"))
    base = base.withColumn("k", F.xxhash64(F.col("i").cast("string"), "u", "x"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [lines(t) for t in b.column(5).to_pylist()]
            hashes = [np.fromiter((xxhash.xxh3_64_intdigest(t) for t, _ in x), np.uint64, len(x)).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(hashes, pa.binary()), pa.array([bytes(z for _, z in x) for x in own], pa.binary())], ["k", "i", "u", "h", "p", "t", "z"])

    id_type = dict(base.dtypes)["i"]
    kind = f"k long, i {id_type}, u string, h string, p string, t binary, z binary"
    order = ["h", "p", "i", "u", "k"]
    # only hashes and zones of lines are sorted and paired; the texts are read again where they are cut
    light = cut(base.select("k", "i", "u", host.alias("h"), path.alias("p"), "x").mapInArrow(read, kind))

    def text_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sets = [], []
            for t, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, z = np.frombuffer(t, np.int64), np.frombuffer(z, np.uint8)
                prints.append(xxhash.xxh3_64_intdigest(h[z != FURNITURE].tobytes()) >> 1 if (z != FURNITURE).any() else None)
                sets.append(np.unique(h[z == OTHER]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["h", "f", "ls"])

    unlike = light.filter("h is not null").select("h", "t", "z").mapInArrow(text_lines, "h string, f long, ls array<long>").filter("f is not null").dropDuplicates(["h", "f"])
    unlike = cut(unlike)
    n_pages = unlike.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= HOST_PAGES)
    often = cut(unlike.select("h", F.explode("ls").alias("l")).groupBy("h", "l").agg(F.count("*").alias("m")).filter(F.col("m") >= HOST_PAGES))
    # a host has hardly more such lines than its shortest page has
    of_host = cut(often.join(small_or_plain(n_pages), "h").filter(F.col("m") >= HOST_SHARE * F.col("n")).groupBy("h").agg(F.collect_set("l").alias("ls")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = light.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "h", "p", "t", "z")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            k = len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * k, pa.int64()), pa.array(range(n, n + k), pa.int64())], [*b.schema.names, "part", "at"])
            n += k

    ranked = cut(ranged.mapInArrow(number, "k long, h string, p string, t binary, z binary, part long, at long"))
    # rows of the partitions before: one row for each partition
    before = ranked.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("off"))
    ranked = ranked.join(F.broadcast(before), "part").withColumn("r", F.col("off") + F.col("at")).drop("part", "at", "off")
    ranked = ranked.join(small_or_plain(of_host), "h", "left")
    chunk = F.floor(F.col("r") / chunk_pages).cast("long")
    dealt = ranked.withColumn("c", F.explode(F.array_distinct(F.array(chunk, F.when(F.col("r") % chunk_pages == chunk_pages - 1, chunk + 1).otherwise(chunk)))))

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """(r, s): s is r where a run begins, else -1."""
        pdf = pdf.sort_values("r", kind="stable")
        rows, before = [], None
        for r, h, t, z, ls in zip(pdf["r"].tolist(), pdf["h"].tolist(), pdf["t"], pdf["z"], pdf["ls"], strict=True):
            own, zones = np.frombuffer(t, np.int64).tolist(), bytes(z)
            if r // chunk_pages == key[0]:
                goes_on = before is not None and before[0] == h and h is not None and is_copy(own, zones, *before[1:], set() if ls is None else set(ls))
                rows.append((r, -1 if goes_on else r))
            before = (h, own, zones)
        return pd.DataFrame(rows, columns=["r", "s"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), -1
        for b in batches:
            s = np.maximum(np.maximum.accumulate(b.column(1).to_numpy()), last)
            last = int(s[-1]) if len(s) else last
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array([part] * len(s), pa.int64())], ["r", "s", "part"])

    begun = dealt.groupBy("c").applyInPandas(begin, "r long, s long").repartitionByRange(parts, "r").sortWithinPartitions("r")
    begun = cut(begun.mapInArrow(carry, "r long, s long, part long"))
    last = begun.groupBy("part").agg(F.max("s").alias("m")).select("part", F.max("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    begun = begun.join(F.broadcast(last), "part").select("r", F.greatest("s", "m").alias("s"))  # one row for each partition
    sides = begun.groupBy("s").agg(F.max("r").alias("e")).select("s", F.explode(F.array(F.col("s") - 1, F.col("e") + 1)).alias("r"))
    beside = sides.join(ranked.select("r", "h", "t", "z"), "r").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("r", "h", "t", "z"))).alias("beside"))
    met = ranked.join(begun, "r").join(beside, "s").select("k", "h", "t", "z", "ls", "beside")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines_of = lambda x: np.frombuffer(x, np.int64).tolist()
        for b in batches:
            keys, found = [], []
            for k, h, t, z, ls, others in zip(*[c.to_pylist() for c in b.columns], strict=True):
                gone = shared_lines(lines_of(t), z, [(lines_of(o["t"]), o["z"]) for o in others if o["h"] == h], set(ls or ())) if h is not None else []
                if gone:
                    keys.append(k)
                    found.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["k", "gone"])

    gone = cut(met.mapInArrow(differ, "k long, gone array<int>").groupBy("k").agg(F.min("gone").alias("gone")))

    @F.pandas_udf("string")
    def text(xs: pd.Series, gones: pd.Series, hosts: pd.Series) -> pd.Series:
        sets = [[set() if g is None else {int(k) for k in g} for g in part] for part in (gones, hosts)]
        return pd.Series([main_text(lines(x), g, h) for x, g, h in zip(xs, *sets, strict=True)], dtype=object)

    out = base.withColumn("h", host).join(small_or_plain(gone), "k", "left").join(small_or_plain(of_host), "h", "left").select("i", "u", text("x", "gone", "ls").alias("text"))
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
