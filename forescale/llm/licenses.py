"""License scans: sparse TF-IDF cosine of statements and licence files to templates, then inheritance along directories.

A first pass over all texts counts in how many each template term stands; that gives the weights. A second pass compares
each line that holds a telling template term, blocks of up to ``BLOCK_LINES`` neighbouring lines with such a line, and each
text as a whole, with every template: the cosine of their weighted term counts, terms of no template weighing as if never
seen. A text of which a line or block reaches ``SIMILARITY`` has that licence; a
text that reaches it as a whole is a licence file and gives its licence to its directory. Files without a licence of
their own take that of the nearest directory above them that has one, by joining the directories' ancestors.

Files are reduced to their directories before ancestors are joined; a directory with a third of all files is one row there.

Defined results: a null or empty text has no licence of its own; equal cosines go to the smaller licence name; of several
licence files in a directory the one with the highest cosine counts, then the smaller name; a null path has no directory
and inherits nothing; repeated rows are scanned each. Extra columns are kept; the output names replace clashing ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.llm.common import pieces, staged

SIMILARITY = 0.6
BLOCK_LINES = 8

#: Statements and headers of well-known licences; a parameter of ``scan``.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

_TERM = re.compile(r"[^\W_]+(?:\.\d+)*")
_SCAN = T.StructType([T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("file_licence", T.StringType()), T.StructField("file_cosine", T.DoubleType())])


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


@dataclass
class Weighted:
    """Templates as weighted unit vectors."""

    names: list[str]
    vectors: list[dict[str, float]]
    weight: dict[str, float]
    unseen: float

    @staticmethod
    def of(templates: dict[str, tuple[str, ...]], found: dict[str, int], texts: int) -> Weighted:
        weight = {t: math.log((1 + texts) / (1 + found.get(t, 0))) + 1 for t in vocabulary(templates)}
        out = Weighted([], [], weight, math.log(1 + texts) + 1)
        for name in sorted(templates):
            for text in templates[name]:
                out.names.append(name)
                out.vectors.append(out.unit(Counter(terms(text))))
        return out

    def unit(self, counts: Counter) -> dict[str, float]:
        raw = {t: n * self.weight.get(t, self.unseen) for t, n in counts.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / length for t, v in raw.items()}

    def best(self, counts: Counter) -> tuple[float, str | None]:
        """Highest cosine and its licence."""
        known = [t for t in counts if t in self.weight]
        if not known:
            return 0.0, None
        length = math.sqrt(sum((n * self.weight.get(t, self.unseen)) ** 2 for t, n in counts.items()))
        most, name = 0.0, None
        for own, vector in zip(self.names, self.vectors):
            dot = sum(counts[t] * self.weight[t] * vector[t] for t in known if t in vector) / length
            if dot > most + 1e-12:
                most, name = dot, own
        return most, name


def vocabulary(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({t for texts in templates.values() for text in texts for t in terms(text)})


def telling(templates: dict[str, tuple[str, ...]]) -> re.Pattern:
    """Finds terms that name a licence or speak of one."""
    named = {t for t in vocabulary(templates) if re.match("licen|apache|gnu|mit$|bsd|mozilla|mpl|creative|copyright|redistribut|permi|cc$|noncommercial", t)}
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(named)))})(?![^\W_])", re.I)


def term_counts(files: DataFrame, templates: dict[str, tuple[str, ...]]) -> tuple[dict[str, int], int]:
    """Texts that hold each template term, and all texts; as many rows as there are template terms."""
    known = frozenset(vocabulary(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts[""] += 1
                counts.update(known.intersection(terms(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found, found.pop("", 0)


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``files``, then licence and cosine of its best line, file_licence and file_cosine of the whole text."""
    weighted = Weighted.of(templates, *term_counts(files, templates))
    pattern = telling(templates)
    kept = [f for f in files.schema.fields if f.name not in _SCAN.names]
    schema = T.StructType([*kept, *_SCAN.fields])

    def scanned(text: str) -> tuple:
        lines = text.split("\n")
        told = [i for i, line in enumerate(lines) if pattern.search(line)]
        if not told:
            return (None, None), (None, None)
        near = {i for t in told for i in range(max(0, t - BLOCK_LINES + 1), min(len(lines), t + BLOCK_LINES))}
        counts = {i: Counter(terms(lines[i])) for i in sorted(near)}
        most, name = 0.0, None
        for start in counts:
            block: Counter = Counter()
            after = bisect_left(told, start)
            for end in range(start, min(len(lines), start + BLOCK_LINES)):
                block.update(counts.get(end, ()))
                if after == len(told) or told[after] > end:
                    continue
                cosine, own = weighted.best(block)
                if own and (cosine > most + 1e-12 or abs(cosine - most) <= 1e-12 and own < (name or own)):
                    most, name = cosine, own
        whole, whole_name = weighted.best(Counter(terms(text)))
        return (name, most) if most >= similarity else (None, None), (whole_name, whole) if whole >= similarity else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [(*line, *whole) for line, whole in map(scanned, (t or "" for t in batch.column("text").to_pylist()))]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=schema.names)

    return files.mapInArrow(run, schema)


def folder(path):
    """Directory of a path, without the slash; empty for a path without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``licence`` filled from the nearest directory above, and ``from_folder``, where it comes from."""
    kept = [c for c in scanned.columns if c not in ("licence", "from_folder")]
    rows = scanned.select(F.struct(*scanned.columns).alias("row"), folder(F.col("path")).alias("folder"), "file_licence", "file_cosine")
    best = F.min(F.struct((-F.round("file_cosine", 9)).alias("cosine"), "file_licence"))["file_licence"]
    given = rows.where("file_licence is not null and folder is not null").groupBy(F.col("folder").alias("above")).agg(best.alias("given"))
    given = staged(given, "licence-folders")
    folders = rows.select("folder").where("folder is not null").distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    climbed = folders.select("folder", F.inline(above)).join(given, "above")
    nearest = climbed.groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("nearest"))
    nearest = staged(nearest, "nearest-folders")
    joined = rows.join(nearest, "folder", "left")
    licence = F.coalesce("row.licence", "nearest.given")
    origin = F.when(F.col("row.licence").isNull(), F.col("nearest.above"))
    return joined.select(*[F.col("row")[c].alias(c) for c in kept], licence.alias("licence"), origin.alias("from_folder"))
