"""Licence scans: sparse TF-IDF cosine of texts to licence templates, then inheritance from the nearest ancestor directory.

Every line, every sentence of a block of lines, and also what follows in either from each word on with which a notice begins, is compared with every notice (each sentence of a
template, the template, headers, SPDX forms): term frequencies of its words, weighed by how few licences hold a word, cosine of the sparse vectors.
Words unknown to the notices count in the line's length with the largest weight, so a long sentence that only mentions a licence scores low. Blocks
without the marks of comments, and the whole text, are compared with notices and full licence texts alike. The products are only summed where the weight of
the known words lets the cosine reach ``LEAST``, which loses nothing. A single word is no notice. The best of the whole text decides; it
must score ``LEAST``; reserved rights decide only where no licence is found. A text that is a full licence text, or whose matched lines or blocks hold
at least ``FILE_SHARE`` of its words, is a licence file and stands for its directory; reserved rights are no licence and stand for none.
A file without a licence of its own inherits that of the nearest directory above it that has a licence file.

Cases: null and empty texts have no licence of their own; a null path lies in the root directory; several licence files of
a directory: the best score, then the smallest licence name; repeated rows each give a row; an empty table gives no
rows; extra columns are left out. Directories, not files, are joined, so a directory with a third of all files is one row.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
import string
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, small_or_plain

LEAST, FILE_SHARE = 0.6, 0.5

#: Short notices of common licences (fixed texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person. Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted. Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "Licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


#: Further notices: headers of files as the licences give them (fixed texts).
_FREE = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, "
         "either version {} of the License, or (at your option) any later version.")
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "GPL-3.0": [_FREE.format("GNU General Public License", 3)],
    "GPL-2.0": [_FREE.format("GNU General Public License", 2)],
    "LGPL-3.0": [_FREE.format("GNU Lesser General Public License", 3)],
    "AGPL-3.0": [_FREE.format("GNU Affero General Public License", 3)],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
}
#: Full licence texts, one file for each licence.
TEXTS = Path(__file__).with_name("licence_texts")
RESERVED = "Proprietary"

_SENTENCE = re.compile(r"(?<=[.;:!?])\s+(?=[A-Z(\"])")
#: Marks of comments before a line.
MARKS = "#*/;%!<>-"


class Vectors:
    """Sparse TF-IDF vectors of named texts, by word."""

    def __init__(self, texts: list[tuple[str, str]]):
        words = [(k, Counter(_WORD.findall(v.lower()))) for k, v in texts]
        names = {k for k, _ in words}
        holds = Counter(w for _, w in {(k, w) for k, c in words for w in c})
        self.idf = {w: math.log((1 + len(names)) / (1 + n)) + 1 for w, n in holds.items()}
        self.most = math.log(1 + len(names)) + 1
        #: The weight that known words must have at least for each unknown word, as the square of their sum.
        self.need = LEAST * LEAST / (1 - LEAST * LEAST) * self.most * self.most - 1e-9
        self.names, self.rows = [], {}
        for at, (name, c) in enumerate(sorted(words, key=lambda x: x[0])):
            v = {w: n * self.idf[w] for w, n in c.items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            self.names.append(name)
            for w, x in v.items():
                self.rows.setdefault(w, []).append((at, x / size))

    def best(self, c: Counter) -> tuple[float, str]:
        """(cosine, name) of the nearest text; the first name at ties. (0, "") where it is below ``LEAST``."""
        own, counts = self.idf.keys() & c.keys(), c.values()
        here = [(w, c[w], self.idf[w]) for w in own]
        known = sum([n * n * x * x for _, n, x in here])
        size = known + (sum(map(operator.mul, counts, counts)) - sum([n * n for _, n, _ in here])) * self.most * self.most
        # the templates have length 1 and only known words, so no cosine is above this share
        if len(c) < 2 or known < (LEAST * LEAST - 1e-9) * size:
            return 0.0, ""
        dots: dict[int, float] = {}
        for w, n, x in here:
            for at, y in self.rows[w]:
                dots[at] = dots.get(at, 0.0) + n * x * y
        if not dots or max(dots.values()) < (LEAST - 1e-9) * math.sqrt(size):
            return 0.0, ""
        at = max(dots, key=lambda k: (round(dots[k], 12), -k))
        return dots[at] / math.sqrt(size), self.names[at]


class Templates:
    """Vectors of notices and of full licence texts."""

    def __init__(self, texts: dict[str, str] | None = None):
        notices = []
        for name, text in (texts or TEMPLATES).items():
            ids = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name] if name != RESERVED else []
            forms = [text, *_SENTENCE.split(text), *(f"SPDX-License-Identifier: {x}" for x in ids), *(HEADERS.get(name, []) if texts is None else [])]
            notices += [(name, x) for x in dict.fromkeys(forms) if _WORD.search(x.lower())]
        self.notices = Vectors(notices)
        self.first = {_WORD.findall(x.lower())[0] for _, x in notices}
        self.full = Vectors([(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))] if texts is None else [])

    def best(self, line: str) -> tuple[float, str]:
        """(cosine, name) of the nearest notice; the first name at ties."""
        return self.notices.best(Counter(_WORD.findall(line.lower())))

    def near(self, words: list[str]) -> tuple[float, str]:
        """The nearest notice of a line or sentence, or of what follows from a word on with which a notice begins."""
        known, other, found, need, k = 0.0, 0, (0.0, ""), self.notices.need, len(words)
        for x in reversed([*map(self.notices.idf.get, words)]):
            k -= 1
            if x is None:
                other += 1
            else:
                known += x
            # the square of a sum is at least the sum of squares, so no cosine of LEAST is passed over
            if known * known >= need * other and (k == 0 or words[k] in self.first):
                found = max(found, self.notices.best(Counter(words[k:])))
        return found

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """(licence, score, share of the words in matched lines or blocks) of a whole text."""
        found: dict[str, float] = {}

        def match(score: float, name: str, part: str) -> int:
            if score < LEAST:
                return 0
            found[name] = max(score, found.get(name, 0.0))
            return len(part.split())

        hit, block, every = 0, [], Counter()
        for line in [*text.split("\n"), ""]:
            bare = line.lstrip(MARKS + string.whitespace).rstrip("*/>-" + string.whitespace)
            if bare:
                block.append((line, bare))
                continue
            if not block:
                continue
            words = [_WORD.findall(x.lower()) for x, _ in block]
            lines = sum(match(*self.near(w), x) for (x, _), w in zip(block, words, strict=True))
            whole = " ".join(x for _, x in block)
            sentences = _SENTENCE.split(whole)
            # a block of one line that is one sentence has been compared
            parts = sum(match(*self.near(_WORD.findall(x.lower())), x) for x in sentences) if len(block) > 1 or len(sentences) > 1 else 0
            c = Counter(words[0]) if len(words) == 1 else Counter(itertools.chain.from_iterable(words))
            hit += max(lines, parts, match(*self.notices.best(c), whole), match(*self.full.best(c), whole))
            every.update(c)
            block = []
        hit = max(hit, match(*self.full.best(every), text))
        if not found:
            return None, 0.0, 0.0
        name = min(found, key=lambda k: (k == RESERVED, -found[k], k))
        return name, round(found[name], 9), min(1.0, hit / len(text.split()))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty text."""
    p = F.coalesce(path, F.lit(""))
    return F.regexp_replace(p, "/?[^/]*$", "")


def scan(files: DataFrame, *, id_col: str = "doc_id", path: Column, text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each file: id, path, licence, score, origin (own, inherited or none), from_dir."""
    bound_batches(files.sparkSession)

    shared = files.sparkSession.sparkContext.broadcast(Templates(templates))

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for texts in it:
            yield pd.DataFrame([t.scan(x) for x in texts], columns=["licence", "score", "share"])

    udf = F.pandas_udf(run, "licence string, score double, share double")
    rows = cut(files.select(F.col(id_col).alias("i"), path.cast("string").alias("p"), udf(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("m")).select("i", "p", "m.*", parent(F.col("p")).alias("d")))
    own = rows.filter(F.col("licence").isNotNull() & (F.col("licence") != RESERVED) & (F.col("share") >= FILE_SHARE))
    licensed = own.groupBy("d").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("f")).select(F.col("d").alias("a"), F.col("f.licence").alias("l"))
    parts = F.split("d", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    dirs = rows.select("d").distinct().select("d", F.explode(F.array_distinct(above)).alias("a"))
    near = dirs.join(small_or_plain(licensed), "a").groupBy("d").agg(F.max_by(F.struct("a", "l"), F.length("a")).alias("n"))
    out = rows.join(small_or_plain(cut(near)), "d", "left")
    return out.select(
        F.col("i").alias(id_col), F.col("p").alias("path"), F.coalesce("licence", "n.l").alias("licence"), "score",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("n.a")).alias("from_dir"))
