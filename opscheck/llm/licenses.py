"""License scans by sparse TF-IDF cosine, with inheritance from the nearest ancestor directory.

Templates span the term space; the inverse document frequency of their terms is counted over all
files. A file's passages are compared with every template: its lines, runs of neighbouring lines that hold a distinctive term,
and, in a licence file, the whole text. A passage without any distinctive term of a template can't reach
``similarity`` with it (those are the terms without which a template keeps too little of its length), so such
passages are skipped without loss. The best template is the file's own license.

The license of a licence file also holds for its directory; a file without its own takes that of
the nearest ancestor directory that has one, found by a join of all ancestors of its path.

Defined results: NULL and empty texts have no license of their own; a NULL path has no directory; of equal
scores the smaller license name wins, in a directory with several licence files the highest score; repeated rows get a
row each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opscheck.operators.keyed import probe

# Customary notices of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
_TERM = re.compile(r"\w+")
_LINES = re.compile(r"[^\n]+")


@dataclass(frozen=True)
class LicenseParameters:
    similarity: float = 0.7


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Space:
    """Unit vectors of the templates, and the distinctive terms of them all."""

    def __init__(self, frequencies: dict[str, int], n_files: int, templates, p: LicenseParameters):
        vocabulary = {t for _, text in templates for t in terms(text)}
        self.idf = {t: math.log((1 + n_files) / (1 + frequencies.get(t, 0))) + 1 for t in vocabulary}
        self.templates, self.p = [(name, self.vector(text)) for name, text in templates], p
        self.distinctive = set()
        for _, vector in self.templates:
            left = 0.0  # squared length that the commonest terms can give
            for t in sorted(vector, key=lambda t: (self.idf[t], t)):
                left += vector[t] ** 2
                if left >= p.similarity ** 2 - 1e-9:
                    self.distinctive.add(t)

    def vector(self, text: str) -> dict[str, float]:
        counts = Counter(t for t in terms(text) if t in self.idf)
        weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / length for t, w in weights.items()}

    def best(self, passages: list[str]) -> tuple[str | None, float]:
        """The most similar template over all passages; none below the threshold."""
        top: tuple[float, str] | None = None
        for vector in map(self.vector, dict.fromkeys(passages)):
            for name, template in self.templates:
                score = sum(w * template.get(t, 0.0) for t, w in vector.items())
                if score >= self.p.similarity and (top is None or (-score, name) < (-top[0], top[1])):
                    top = (score, name)
        return (top[1], min(1.0, top[0])) if top else (None, 0.0)

    def passages(self, text: str, whole: bool) -> list[str]:
        if not any(t in text.lower() for t in self.distinctive):
            return []
        found, run, after = [text] if whole else [], [], -1
        for m in _LINES.finditer(text):
            if self.distinctive.isdisjoint(terms(m[0])):
                continue
            found.append(m[0])
            if run and m.start() == after:
                run.append(m[0])
            else:
                if len(run) > 1:
                    found.append(" ".join(run))
                run = [m[0]]
            after = m.end() + 1
        return found + ([" ".join(run)] if len(run) > 1 else [])


def licensed_files(files: DataFrame, templates=TEMPLATES, p: LicenseParameters = LicenseParameters()) -> DataFrame:
    """``path``, ``own`` license and ``score``, ``license`` that holds, and ``origin``, the directory it is inherited from.

    ``files`` has ``path`` and ``text``; a column ``file_id`` is passed on.
    """
    rows = files.select(F.col("file_id").cast("string"), F.col("path"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = {t for _, text in templates for t in terms(text)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = Counter(), 0
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                found.update(vocabulary.intersection(terms(text)))
        yield pd.DataFrame([("", n), *found.items()], columns=["term", "n"])

    counted = rows.select("text").mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    frequencies = {r["term"]: r["n"] for r in counted.collect()}  # no more than the templates' terms
    space = Space(frequencies, frequencies.get("", 0), templates, p)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [space.best(space.passages(t, bool(w))) for t, w in zip(batch["text"], batch["is_licence"], strict=True)]
            yield batch.drop(columns="text").assign(own=[b[0] for b in best], score=[b[1] for b in best])

    name = F.element_at(F.split("path", "/"), -1)
    marked = rows.withColumn("is_licence", F.coalesce(F.regexp_like(name, F.lit(LICENCE_FILES)), F.lit(False)))
    scanned = marked.mapInPandas(scan, "file_id string, path string, is_licence boolean, own string, score double")
    folder = F.when(F.contains("path", F.lit("/")), F.expr("left(path, length(path) - locate('/', reverse(path)))")).otherwise("")
    scanned = scanned.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    holding = (scanned.filter("is_licence AND own IS NOT NULL").groupBy("folder")
               .agg(F.max_by("own", F.struct("score", F.struct(F.col("own")))).alias("license")))
    # a folder and all above it; distinct folders are few beside the files
    folders = scanned.filter("folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    above = F.expr("transform(sequence(0, size(parts)), n -> array_join(slice(parts, 1, n), '/'))")
    climbed = folders.withColumn("parts", parts).select("folder", F.explode(F.array_distinct(above)).alias("ancestor"))
    inherited = (probe(climbed, holding.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder")
                 .agg(F.max_by(F.struct(F.col("ancestor").alias("origin"), "license"), F.length("ancestor")).alias("inherited")))
    joined = probe(scanned, inherited, "folder", "left")
    origin = F.when(F.col("own").isNull(), F.col("inherited.origin"))
    return joined.select("file_id", "path", "own", "score", F.coalesce("own", "inherited.license").alias("license"),
                         origin.alias("origin"))
