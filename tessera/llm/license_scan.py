"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Stretches of a text are sparse vectors of adjacent word pairs, weighted by
term frequency and the inverse document frequency over all documents, and
compared with the vectors of known notices.  Scored are every line, the whole
text and, with line breaks as spaces, every window of a template's length (or
a quarter more, for marks at line beginnings) that begins at one of its pairs:
a notice inside a paragraph or wrapped over lines counts as one on its own
line.  Stretches without a template's pair have cosine 0.  A pair outside the
templates counts in a stretch's length as often as it stands there, each time
with the weight of a pair no document has.

A document that contains a whole licence (``file_least`` of the word pairs of
one of the texts in ``licenses/``, each as often as it stands there) has that
licence, of several the one with the most pairs found; any other has that of
its best stretch at or above ``least``, one without a version only if no other
is.  A document is a licence file if it contains a whole licence, if it is a
notice and nothing else (cosine at or above ``file_least``), or if its name
says so and it has a notice; the
licence of a directory's best such file covers all documents below it that
have no notice of their own, the nearest directory first.  Directories are
resolved once each, by joining their ancestors with the licensed directories.

Defined results: null and empty texts have no notice but may inherit; a null
path has no directory and inherits nothing; repeated rows are rows like any
other; ties go to the smaller licence name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import ship, values, written

#: Short notices by licence identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    # usual header blocks
    *((name, f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} "
             f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, what, mark, kind, version in (
          ("GPL-2.0", "program", ";", "General Public License", "2"), ("GPL-3.0", "program", ":", "General Public License", "3"),
          ("AGPL-3.0", "program", ":", "Affero General Public License", "3"),
          ("LGPL-2.1", "library", ";", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", ":", "Lesser General Public License", "3"))),
    ("GPL", "You should have received a copy of the GNU General Public License"),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License"),
    ("AGPL", "You should have received a copy of the GNU Affero General Public License"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Names without a version: taken only if no other notice is found.
UNVERSIONED = {"GPL", "LGPL", "AGPL"}
#: A text that has all of one licence but this title is another.
TITLES = {"GPL-3.0": ("AGPL-3.0", re.compile(r"(?i)gnu\s+affero\s+general\s+public\s+license\W+version\s+3,\s+19\s+november"))}
WORD = re.compile(r"\w+")
#: Rows whose hits are scored in one task.
ROWS_A_TASK = 4000
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"


def pairs(text: str) -> list[tuple[str, str]]:
    words = WORD.findall(text.lower())
    return list(zip(words, words[1:], strict=False))


def license_texts() -> list[tuple[str, str]]:
    """(name, text) of whole licences without their appendices; of the CC BY family the paragraph before section 1."""
    folder = resources.files(__package__) / "licenses"
    return sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))


def _vocabulary(templates) -> dict[tuple[str, str], int]:
    known: dict[tuple[str, str], int] = {}
    for _, text in templates:
        for p in pairs(text):
            known.setdefault(p, len(known))
    return known


HITS = ("struct<size:int,pos:array<int>,at:array<int>,line:array<int>,begin:array<int>,pairs:array<int>,"
        "text:string,share:double,text_line:int>")


class _Finder:
    """Known word pairs of a text by their place."""

    def __init__(self, known: dict[tuple[str, str], int]):
        self.ids: dict[str, int] = {}
        for p in known:
            for w in p:
                self.ids.setdefault(w, len(self.ids))
        keys = np.array([self.ids[a] * len(self.ids) + self.ids[b] for a, b in known], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (-1: in no known pair), and where each line's words begin."""
        found: list[int] = []
        begin = [0]
        for line in text.lower().split("\n"):
            found += [self.ids.get(w, -1) for w in WORD.findall(line)]
            begin.append(len(found))
        return np.array(found, np.int64), np.array(begin, np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known pairs, and which they are."""
        pos = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))
        key = words[pos] * len(self.ids) + words[pos + 1]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[k] == key
        return pos[same], self.order[k[same]]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


class _Texts:
    """Whole licences by the numbers of their pairs."""

    def __init__(self, texts, known: dict[tuple[str, str], int], least: float):
        self.names, self.least, self.size, self.texts = [n for n, _ in texts], least, len(known), []
        for _, text in texts:
            at = np.array([known[p] for p in pairs(text)], np.int64)
            self.texts.append((*np.unique(at, return_counts=True), int(at[0]), len(at)))
        self.shortest = min((t[3] for t in self.texts), default=np.inf)

    def contained(self, pos: np.ndarray, at: np.ndarray) -> tuple[str, float, int] | None:
        """(name, share of its pairs, place of its first pair) of the licence with the most pairs found."""
        if len(at) < self.least * self.shortest:
            return None
        counts, best = np.bincount(at, minlength=self.size), None
        for name, (which, n, first, size) in zip(self.names, self.texts, strict=True):
            found = int(np.minimum(counts[which], n).sum())
            if found >= self.least * size and (best is None or found > best[0]):
                best = (found, name, round(found / size, 9), first)
        if best is None:
            return None
        place = np.flatnonzero(at == best[3])
        return best[1], best[2], int(pos[place[0]] if len(place) else pos[0])


def _candidates(text: Column, templates, texts, file_least: float) -> Column:
    """Column: number of words, the template pairs (``at``) by place (``pos``) and the lines that have one:
    ``line``, place of its first word (``begin``), number of pairs inside it (``pairs``); and the whole licence
    contained (``text``) with the share of its pairs and the line where it begins."""
    known = _vocabulary(templates)
    notices = len(known)
    every = _vocabulary([*templates, *texts])
    finder, whole = _Finder(every), _Texts(texts, every, file_least)

    @F.arrow_udf(HITS)
    def candidates(texts: pa.Array) -> pa.Array:
        sizes, lists, inside = [], [[] for _ in range(5)], []
        for text in values(texts):
            words, begin = finder.words(text or "")
            pos, at = finder.hits(words)
            found = whole.contained(pos, at)
            if found:
                name, share, place = found
                other, title = TITLES.get(name, (name, None))
                found = (other if title and title.search(text) else name, share, int(np.searchsorted(begin, place, "right") - 1))
            inside.append(found or (None, None, None))
            pos, at = pos[at < notices], at[at < notices]
            line = np.unique(np.searchsorted(begin, pos, "right") - 1)
            sizes.append(len(words))
            for to, part in zip(lists, (pos, at, line, begin[line], np.maximum(begin[line + 1] - begin[line] - 1, 0)), strict=True):
                to.append(part.astype(np.int32))
        kinds = (pa.string(), pa.float64(), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int32()), *map(_lists, lists), *(pa.array([x[i] for x in inside], k) for i, k in enumerate(kinds))],
            names=["size", "pos", "at", "line", "begin", "pairs", "text", "share", "text_line"])

    return candidates.asNondeterministic()(text)


def _best(hits: Column, idf: np.ndarray, unseen: float, templates, least: float) -> Column:
    """Column: best template of the lines and windows, and of the whole text, with cosines."""
    known = _vocabulary(templates)
    vectors = np.zeros((len(templates), len(known)))
    for k, (_, text) in enumerate(templates):
        for p in pairs(text):
            vectors[k, known[p]] += 1
    lengths = vectors.sum(axis=1).astype(int)
    vectors *= idf
    vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-12)
    names = [name for name, _ in templates]

    def scored(at: np.ndarray, pos: np.ndarray, begin: np.ndarray, end: np.ndarray, dots: np.ndarray, squares: np.ndarray, of: np.ndarray):
        """(stretch, template, cosine) for stretches [begin, end) of pairs that reach ``least`` with the templates ``of``."""
        i, j = np.searchsorted(pos, begin), np.searchsorted(pos, end)
        rest = (end - begin - (j - i)) * unseen**2
        # with every pair once the length is smallest
        bound = (dots[of][:, j] - dots[of][:, i]) / np.sqrt(np.maximum(squares[j] - squares[i] + rest, 1e-12))
        for s in np.flatnonzero((bound >= least - 1e-6).any(axis=0)).tolist():
            which, n = np.unique(at[i[s] : j[s]], return_counts=True)
            w = n * idf[which]
            cosine = np.round(vectors[of][:, which] @ w / np.sqrt(w @ w + rest[s]), 9)
            for k in np.flatnonzero(cosine >= least).tolist():
                yield s, of[k], float(cosine[k])

    @F.arrow_udf("struct<license:string,score:double,line:int,whole:string,whole_score:double>")
    def best(rows: pa.Array) -> pa.Array:
        out = []
        every = np.arange(len(templates))
        columns = {f.name: rows.field(f.name) for f in rows.type}
        flat = {c: (columns[c].offsets.to_numpy(), columns[c].values.to_numpy()) for c in ("pos", "at", "line", "begin", "pairs")}
        for r, size in enumerate(columns["size"].to_pylist()):
            pos, at, line, begin, inside = (v[o[r] : o[r + 1]].astype(np.int64) for o, v in flat.values())
            found: list[tuple[float, str, int]] = []
            whole: list[tuple[float, str]] = []
            if len(pos):
                dots = np.concatenate([np.zeros((len(vectors), 1)), np.cumsum(vectors[:, at] * idf[at], axis=1)], axis=1)
                squares = np.concatenate([[0.0], np.cumsum(idf[at] ** 2)])
                line_of = lambda place: int(line[np.searchsorted(begin, place, "right") - 1])  # noqa: B023, E731
                found += [(-c, names[k], int(line[s])) for s, k, c in scored(at, pos, begin, begin + inside, dots, squares, every)]
                whole += [(-c, names[k]) for _, k, c in scored(at, pos, np.array([0]), np.array([size - 1]), dots, squares, every)]
                for t, length in enumerate(lengths.tolist()):
                    start = pos[vectors[t, at] > 0]
                    for n in {length, length + length // 4}:
                        end = np.minimum(start + n, size - 1)
                        found += [(-c, names[k], line_of(start[s])) for s, k, c in scored(at, pos, start, end, dots, squares, every[t : t + 1])]
            top = min(found, key=lambda x: (x[1] in UNVERSIONED, *x), default=None)
            whole.sort(key=lambda x: (x[1] in UNVERSIONED, *x))
            out.append({"license": top and top[1], "score": top and -top[0], "line": top and top[2],
                        "whole": whole[0][1] if whole else None, "whole_score": -whole[0][0] if whole else None})
        return pa.array(out, pa.struct([("license", pa.string()), ("score", pa.float64()), ("line", pa.int32()),
                                        ("whole", pa.string()), ("whole_score", pa.float64())]))

    return best.asNondeterministic()(hits)


def scan(df: DataFrame, path: Column, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6,
         file_least: float = 0.9, templates=TEMPLATES, texts=None) -> DataFrame:
    """A row per row of ``df``: doc_id, path, license, origin (``notice``, ``inherited`` or null), score, line
    (of the notice or where the whole licence begins) and licensed_by (the directory whose licence is inherited).
    ``texts`` are the whole licences, as ``templates`` are the notices; ``license_texts()`` by default."""
    ship(df)
    texts = license_texts() if texts is None else texts
    rows = written(df.select(F.col(id_col).alias("doc_id"), path.alias("path"), _candidates(F.col(text_col), templates, texts, file_least).alias("hits")),
                   "license-hits")
    known = _vocabulary(templates)
    n = rows.count()
    counts = rows.select(F.explode(F.array_distinct("hits.at")).alias("at")).groupBy("at").count().collect()  # a row a template pair
    df_of = np.zeros(len(known))
    for at, count in counts:
        df_of[at] = count
    idf = np.log((n + 1) / (df_of + 1)) + 1
    # the hits are small files: as many tasks as rows ask for, not as there are files
    dealt = rows.repartition(max(1, -(-n // ROWS_A_TASK)))
    scored = dealt.select("doc_id", "path", _best(F.col("hits"), idf, float(np.log(n + 1) + 1), templates, least).alias("b"), F.col("hits.text").alias("t"),
                         F.col("hits.share").alias("share"), F.col("hits.text_line").alias("t_line"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    named = F.substring_index("path", "/", -1).rlike(FILE_NAME)
    scored = written(scored.select("doc_id", "path", folder.alias("dir"), F.coalesce("t", "b.license").alias("license"),
                                   F.when(F.col("t").isNotNull(), F.col("share")).otherwise(F.col("b.score")).alias("score"),
                                   F.when(F.col("t").isNotNull(), F.col("t_line")).otherwise(F.col("b.line")).alias("line"),
                                   F.coalesce("t", "b.whole").alias("whole"), F.coalesce("share", "b.whole_score").alias("whole_score"),
                                   F.coalesce(named, F.lit(False)).alias("named")), "license-scores")
    file_license = F.coalesce(F.when(F.col("whole_score") >= file_least, F.col("whole")), F.when(F.col("named"), F.col("license")))
    files = (scored.where(F.col("dir").isNotNull() & file_license.isNotNull())
             .select("dir", file_license.alias("name"), F.coalesce("whole_score", "score").alias("s")))
    licensed = files.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("s")).alias("s"), "name"))["name"].alias("name"))
    # a folder's ancestors: itself, every prefix of whole parts, the root
    parts = F.split("dir", "/")
    ancestors = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")),
                                          F.array(F.lit(""))))
    folders = scored.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors).alias("above"))
    nearest = folders.join(licensed, "above").groupBy("dir").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "name")).alias("near"))
    nearest = written(nearest.select(F.col("dir").alias("d"), F.col("near.above").alias("licensed_by"), F.col("near.name").alias("name")), "license-dirs")
    out = scored.join(nearest, F.col("dir") == F.col("d"), "left")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "name").alias("license"),
        F.when(own, "notice").when(F.col("name").isNotNull(), "inherited").alias("origin"),
        "score", "line", F.when(~own, F.col("licensed_by")).alias("licensed_by"))
