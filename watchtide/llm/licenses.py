"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Groups of words become sparse vectors of word weights and meet the template vectors; the best
template above ``LEAST`` names the group's licence. Groups are every run of as many words as
a template has, so that a notice may lie in a long line or over several, and every line. A
bound from running sums says which runs can reach ``LEAST``; those are scored exactly. A
file's own licence is that of its first notice. Files without one take that of the nearest
directory above that has a licence file, by a join on directory paths.

Weights: the template words' inverse document frequency over the templates; words no
template has weigh as much as the rarest, so a sentence that only mentions a licence is far
from every template. The templates are a small fixed table.

Defined cases: null text has no licence of its own; a null path has no directory and so
inherits nothing; of several licence files in one directory the smallest path counts; ties
between templates go to the smaller name; rows are scored one by one, also if they share an
id; repeated rows give repeated rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.llm.common import stored

LEAST = 0.6
#: Words of a long text that are scored at a time, about.
PIECE = 65536
# Licence names and how notices word them.
TEMPLATES = (
    ("All-Rights-Reserved", "Copyright. All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software under the terms of the GNU General Public License version 3"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
TOKEN = "[a-z0-9]+(?:[.-][0-9a-z]+)*"
LICENCE_NAME = "(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"


def _template_weights(templates) -> tuple[list[tuple[str, str, float]], float, dict[str, float]]:
    """(template key, word, unit weight) rows, weight of unknown words, idf by word."""
    words = [re.findall(TOKEN, text.lower()) for _, text in templates]
    n = len(templates)
    seen = {w: sum(w in set(x) for x in words) for w in {w for x in words for w in x}}
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
    rows = []
    for i, ((name, _), found) in enumerate(zip(templates, words, strict=True)):
        weights = {w: found.count(w) * idf[w] for w in found}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        rows += [(f"{name}#{i}", w, v / norm) for w, v in weights.items()]
    return rows, math.log((1 + n) / 2) + 1, idf


class Templates:
    """Template vectors, and the best template of every group of words that may be a notice."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        rows, self.unknown, self.idf = _template_weights(templates)
        self.least = least
        self.names = sorted({key for key, _, _ in rows})
        self.vectors: dict[str, dict[str, float]] = {key: {} for key in self.names}
        for key, word, weight in rows:
            self.vectors[key][word] = weight
        self.sizes = {f"{name}#{i}": len(re.findall(TOKEN, text.lower())) for i, (name, text) in enumerate(templates)}
        self.codes = {word: k + 1 for k, word in enumerate(sorted(self.idf))}
        values = [self.unknown] + [self.idf[word] for word in sorted(self.idf)]
        self.values = np.array(values)
        self.parts = {
            key: np.array([0.0] + [vector.get(word, 0.0) for word in sorted(self.idf)]) for key, vector in self.vectors.items()
        }
        # A group without a telling word reaches ``least`` with no template: the words left out
        # of a template, shortest first, are too few of its weight.
        telling: set[str] = set()
        for vector in self.vectors.values():
            left = 0.0
            for word in sorted(vector, key=lambda w: (len(w), w)):
                left += vector[word] ** 2
                if left >= (least - 1e-6) ** 2:
                    telling.add(word)
        self.telling = np.array([False] + [word in telling for word in sorted(self.idf)])
        self.any = re.compile("|".join(re.escape(w) for w in sorted(telling)) or "(?!)")

    def cosines(self, words: list[str]) -> tuple[float, str]:
        """(minus the cosine, template) of the best template that shares two words; one word,
        such as a German "mit", is no notice."""
        counts = Counter(words)
        weights = {w: n * self.idf.get(w, self.unknown) for w, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        dots = [(sum(v * vector.get(w, 0.0) for w, v in weights.items()), key) for key, vector in self.vectors.items() if len(vector.keys() & counts) > 1]
        return min(((-round(dot / norm, 6), key) for dot, key in dots), default=(0.0, ""))

    def passages(self, words: list[str], lines: list[int], begun: bool = False, cut: bool = False) -> list[tuple[int, int, float, str]]:
        """(begin, end, minus the cosine, template) of the groups above ``least``: as many
        consecutive words as a template has, over line ends, and the words of each whole line
        (not of a first one ``begun`` before, or a last one ``cut``)."""
        code = np.array([self.codes.get(w, 0) for w in words], dtype=np.int64)
        if not self.telling[code].any():
            return []
        line = np.array(lines)
        start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        end = np.concatenate([start[1:], [len(line)]])
        start, end = start[begun : len(start) - cut], end[begun : len(end) - cut]
        square = np.concatenate([[0.0], np.cumsum(self.values[code] ** 2)])
        groups = set()
        for key, part in self.parts.items():
            size = min(self.sizes[key], len(words))
            dot = np.concatenate([[0.0], np.cumsum(self.values[code] * part[code])])
            # Without repeated words the norm is at least this, so the cosine at most that.
            most = (dot[size:] - dot[:-size]) / np.sqrt(square[size:] - square[:-size])
            groups.update((int(i), int(i) + size) for i in np.flatnonzero(most >= self.least - 1e-6))
            most = (dot[end] - dot[start]) / np.sqrt(square[end] - square[start])
            groups.update((int(start[k]), int(end[k])) for k in np.flatnonzero(most >= self.least - 1e-6))
        found = [(i, j, *self.cosines(words[i:j])) for i, j in sorted(groups)]
        return [f for f in found if -f[2] >= self.least]

    def first(self, text: str) -> tuple[int, str, float] | None:
        """(line, licence, cosine) of the first notice. Long texts are read some words at a time."""
        text = text.lower()
        if not self.any.search(text):
            return None
        words: list[str] = []
        lines: list[int] = []
        again = 8 * max(self.sizes.values())
        line, at, begun = 0, 0, False
        for match in re.finditer(TOKEN, text):
            line += text.count("\n", at, match.start())
            at = match.start()
            # A cut is where a line ends, or in a line far longer than a template; all groups that
            # begin in the last words are looked at again with what follows.
            if len(words) >= PIECE and (line != lines[-1] or len(words) >= 2 * PIECE):
                found = self._best(self.passages(words, lines, begun, line == lines[-1]), lines, len(words) - again // 2)
                if found:
                    return found
                begun = lines[-again - 1] == lines[-again]
                words, lines = words[-again:], lines[-again:]
            words.append(match.group())
            lines.append(line)
        return self._best(self.passages(words, lines, begun), lines, len(words)) if words else None

    @staticmethod
    def _best(found: list[tuple[int, int, float, str]], lines: list[int], upto: int) -> tuple[int, str, float] | None:
        """The first notice, if it begins before ``upto``: a notice is a passage that overlaps
        no better notice."""
        taken = bytearray(len(lines))
        notices = []
        for begin, end, cosine, key in sorted(found, key=lambda f: (f[2], f[3], f[0], f[1])):
            if not any(taken[begin:end]):
                taken[begin:end] = b"\1" * (end - begin)
                notices.append((begin, key, cosine))
        begin, key, cosine = min(notices, default=(upto, "", 0.0))
        return (lines[begin], key.rpartition("#")[0], -cosine) if begin < upto else None


def detect(files: DataFrame, templates=TEMPLATES, least: float = LEAST, keep: tuple[str, ...] = ("doc_id", "path")) -> DataFrame:
    """``keep``, line, license, cosine of every row: its first notice, nulls without one."""
    rows = files.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = rows.schema.fields[: len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            found = [known.first(t.as_py() or "") or (None, None, None) for t in batch.column(len(keep))]
            kinds = (pa.int32(), pa.string(), pa.float64())
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], [*keep, "line", "license", "cosine"])

    added = [("line", T.IntegerType()), ("license", T.StringType()), ("cosine", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in added)]))


def role(license: Column) -> Column:
    """Path of a document in the role of a file. Directories are source, language and hundreds of
    ids; a document with a notice is the licence file of one of the three levels, by its id."""
    levels = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none"))]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    level = F.pmod(F.col("doc_id"), F.lit(3))
    notice = F.concat(F.lit("LICENSE-"), name)
    return (
        F.when(license.isNull(), F.concat_ws("/", *levels, F.concat(F.lit("doc-"), name)))
        .when(level == 0, F.concat_ws("/", *levels[:1], notice))
        .when(level == 1, F.concat_ws("/", *levels[:2], notice))
        .otherwise(F.concat_ws("/", *levels, notice))
    )


def as_files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents in the role of files."""
    found = detect(docs, keep=("doc_id", "source", "lang", "text"))
    return found.select("doc_id", role(F.col("license")).alias("path"), "text")


def scan_documents(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``scan`` of the documents in the role of files; every text is read once."""
    found = detect(docs, templates, least, ("doc_id", "source", "lang"))
    return inherit(found.select("doc_id", role(F.col("license")).alias("path"), "license", "cosine"))


def folder_of(path: Column) -> Column:
    """Directory of a path; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per file (doc_id, path, text): doc_id, path, license, cosine, origin (own, directory or
    null), from_path (the licence file it comes from)."""
    return inherit(detect(files, templates, least).select("doc_id", "path", "license", "cosine"))


def inherit(found: DataFrame) -> DataFrame:
    """``scan`` from each file's own licence (doc_id, path, license, cosine)."""
    files = stored(found, "licenses-own")
    # The licence file of a directory.
    named = files.filter(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_NAME))
    folders = named.groupBy(folder_of(F.col("path")).alias("folder")).agg(
        F.min(F.struct("path", "license", "cosine")).alias("file")
    )
    # Every directory that files are in, once, with all directories above it.
    places = files.filter("path is not null").select(folder_of(F.col("path")).alias("place")).distinct()
    parts = F.split("place", "/", -1)
    above = places.select(
        "place",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder"),
    ).distinct()
    nearest = above.join(folders, "folder").groupBy("place").agg(
        F.max(F.struct(F.length("folder").alias("depth"), "file")).alias("near")
    )
    rows = files.withColumn("place", folder_of(F.col("path"))).join(nearest, "place", "left")
    has, near = F.col("license").isNotNull(), F.col("near.file")
    return rows.select(
        "doc_id",
        "path",
        F.coalesce("license", near["license"]).alias("license"),
        F.when(has, F.col("cosine")).otherwise(near["cosine"]).alias("cosine"),
        F.when(has, "own").when(near.isNotNull(), "directory").alias("origin"),
        F.when(has, F.col("path")).otherwise(near["path"]).alias("from_path"),
    )
