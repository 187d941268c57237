"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the path tree."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, sized
from .licence_texts import WHOLE_TEXTS

# Header lines and openings of licence files, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004",
        "Released under the Apache 2.0 license.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Released under the GNU GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the Simplified BSD License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved."],
}
#: The cosine to a whole licence text from which a text counts as that licence's file.
WHOLE = 0.8
#: Names of files that are a licence file as soon as they hold a licence at all.
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]es?|copying(?:\.lesser)?)(?:[-_.][^/]*)?$"
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_UNIT = re.compile(r"(?<=[.!?])\s+|\n+")
_PARAGRAPH, _SENTENCE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+"), re.compile(r"(?<=[.!?])\s+")


def terms(text: str) -> list[str]:
    """Words and pairs of words."""
    words = _WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def units(paragraph: str) -> list[list[str]]:
    """A paragraph as a whole, its lines, its sentences over line breaks, and the sentences of each line."""
    out = [[paragraph]]
    for parts in (paragraph.split("\n"), _SENTENCE.split(paragraph), _UNIT.split(paragraph)):
        if parts not in out:
            out.append(parts)
    return out


def templates() -> list[tuple[str, str, str]]:
    """``(licence, kind, text)``: headers and paragraphs (``unit``), those of several licences (``shared``), and whole texts."""
    owners = Counter(t for texts in WHOLE_TEXTS.values() for t in set(texts))
    out, seen = [], set()
    for name, texts in TEMPLATES.items():
        out += [(name, "unit", t) for t in texts]
        for t in WHOLE_TEXTS.get(name, ()):
            if t not in seen and t not in texts:
                out.append((name, "unit" if owners[t] == 1 else "shared", t))
                seen.add(t)
    return out + [(name, "whole", " ".join(texts)) for name, texts in WHOLE_TEXTS.items()]


@dataclass
class LicenceModel:
    """Templates as sparse unit vectors; idf from the corpus, for their terms."""

    idf: dict[str, float]
    threshold: float = 0.6
    postings: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    rare: frozenset[str] = frozenset()
    other: float = 1.0  # what terms outside all templates weigh: the templates' median

    def __post_init__(self) -> None:
        self.other = sorted(self.idf.values())[len(self.idf) // 2] if self.idf else 1.0
        vectors = []
        for name, kind, text in templates():
            vector = self.weigh(Counter(terms(text)))
            norm = math.sqrt(sum(w * w for w in vector.values()))
            for t, w in vector.items():
                self.postings.setdefault(t, []).append((len(self.names), w / norm))
            vectors.append({t: w / norm for t, w in vector.items()})
            self.names.append(name)
            self.kinds.append(kind)
        self.pairs = frozenset(tuple(t.split(" ")) for t in self.postings if " " in t)
        # Without any of these words, of each term its rarest, no text reaches the
        # threshold: what is left of each template is too short.
        rare: set[str] = set()
        for vector in vectors:
            left = 1.0
            for t, w in sorted(vector.items(), key=lambda x: (-self.idf.get(x[0], self.other), x[0])):
                if left < 0.99 * self.threshold**2:
                    break
                rare.add(max(t.split(" "), key=lambda w: (self.idf.get(w, self.other), w)))
                left -= w * w
        self.rare = frozenset(rare)

    def weigh(self, counts: Counter) -> dict[str, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.other) for t, c in counts.items()}

    def _best(self, text: str, kinds: tuple[str, ...]) -> tuple[float, int]:
        """The best cosine to a template of these kinds, and its number (-1: none)."""
        vector = self.weigh(Counter(terms(text)))
        norm = math.sqrt(sum(w * w for w in vector.values()))
        dots: dict[int, float] = {}
        for t, w in vector.items():
            for k, x in self.postings.get(t, ()):
                if self.kinds[k] in kinds:
                    dots[k] = dots.get(k, 0.0) + w * x
        best = max(dots, key=lambda k: (dots[k], -k), default=-1)
        return (0.0, -1) if best < 0 else (min(1.0, dots[best] / norm), best)

    def match(self, text: str) -> tuple[float, str | None]:
        """The best cosine of a unit of text, and its licence."""
        score, k = self._best(text, ("unit", "shared"))
        return score, self.names[k] if k >= 0 else None

    def ceiling(self, words: list[str]) -> float:
        """What no cosine of a text of these words to any template exceeds.

        Of its norm only the templates' terms can be shared, and each further
        distinct word adds to it; further pairs, which add too, are left out.
        """
        known = self.weigh(Counter(w for w in words if w in self.postings))
        known |= self.weigh(Counter(" ".join(p) for p in zip(words, words[1:]) if p in self.pairs))
        shared = sum(w * w for w in known.values())
        return math.sqrt(shared / (shared + len(set(words) - known.keys()) * self.other**2)) if shared else 0.0

    def scan(self, text: str | None) -> tuple[float, str | None, bool]:
        """Score and licence of the best paragraph, line or sentence, or of the
        whole text, and whether licence terms make up most of the text's words.

        A unit that several licences share only names one where no other does.
        """
        words = _WORD.findall(text.lower()) if text else []
        if self.rare.isdisjoint(words):
            return 0.0, None, False
        best, own = {"unit": (0.0, -1), "shared": (0.0, -1)}, 0
        for paragraph in _PARAGRAPH.split(text):
            if self.rare.isdisjoint(_WORD.findall(paragraph.lower())):
                continue
            most = 0
            for parts in units(paragraph):
                covered = 0
                for part in parts:
                    found = _WORD.findall(part.lower())
                    if not self.rare.isdisjoint(found):
                        score, k = self._best(part, ("unit", "shared"))
                        if score >= self.threshold:
                            covered += len(found)
                            best[self.kinds[k]] = max(best[self.kinds[k]], (score, k), key=lambda x: x[0])
                most = max(most, covered)
            own += most
        score, k = best["unit"] if best["unit"][1] >= 0 else best["shared"]
        file = k >= 0 and 5 * own >= 4 * len(words)
        if file or self.ceiling(words) >= WHOLE:
            whole = self._best(text, ("whole",))
            if whole[0] >= WHOLE:
                (score, k), file = whole, True
        return score, self.names[k] if k >= 0 else None, file


def corpus_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Smoothed idf of the templates' terms, counted over all documents' whole texts.

    Each batch gives one count a term, so the driver receives a row for each
    of the templates' few thousand terms.
    """
    wanted = {t for _, _, text in templates() for t in terms(text)}
    words = frozenset(t for t in wanted if " " not in t)
    pairs = frozenset(tuple(t.split(" ")) for t in wanted if " " in t)

    def run(columns: list) -> list:
        seen: Counter = Counter()
        for text in columns[0]:
            found = _WORD.findall(text.lower()) if text else []
            seen.update(words.intersection(found))
            seen.update(" ".join(p) for p in pairs.intersection(zip(found, found[1:])))
        return [["", *seen], [len(columns[0]), *seen.values()]]

    rows = {r["term"]: r["n"] for r in map_rows(docs.select(text_col), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = rows.pop("", 0)
    return {t: math.log((1 + n) / (1 + rows.get(t, 0))) + 1 for t in sorted(wanted)}


def scan_licences(docs: DataFrame, path: Column, *, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, path, licence, score, origin, licence_path`` for each row.

    ``origin`` is ``own`` where a paragraph, line or sentence has a cosine
    of ``threshold`` or more to a header or paragraph of a licence, or the whole text one of ``WHOLE`` to a whole licence.
    A document of which licence terms make up four fifths of the words, that resembles a
    licence as a whole, or that holds one and is named like a licence file (``FILE_NAME``), is a licence file; it also covers what
    lies in its directory and below.  A document without a licence of its own
    is ``inherited`` from the nearest directory upwards that holds a licence
    file (the best score of it, then the least path), else ``none``.  Null and
    empty texts have none of their own; texts of any length are scanned whole; a null path inherits nothing; repeated
    rows are scanned each; other columns, whatever their names, play no part; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    model = LicenceModel(corpus_idf(docs, text_col), threshold)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list) -> list:
        found = [shared.value.scan(t) for t in columns[2]]
        return [columns[0], columns[1], [f[1] for f in found], [f[0] for f in found], [f[2] for f in found]]

    own = checkpoint(map_rows(docs.select(F.col(id_col), path.alias("_path"), F.col(text_col)), run, f"doc_id {kind}, path string, licence string, score double, whole boolean"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    files = own.filter(F.col("path").isNotNull() & F.col("licence").isNotNull() & (F.col("whole") | F.col("path").rlike(FILE_NAME))).groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("f"))
    files = checkpoint(files.select("folder", F.col("f.licence").alias("up_licence"), (-F.col("f.s")).alias("up_score"), F.col("f.path").alias("up_path")))
    # only the distinct folders climb, not their documents
    wanting = own.filter("licence is null and path is not null").select(folder.alias("at")).distinct()
    parts = F.split("at", "/")
    climb = wanting.select("at", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = climb.join(sized(files), "folder").groupBy("at").agg(F.max(F.struct("depth", "up_licence", "up_score", "up_path")).alias("u"))
    nearest = checkpoint(nearest.select("at", "u.up_licence", "u.up_score", "u.up_path"))
    out = own.withColumn("at", F.when(F.col("licence").isNull(), folder)).join(sized(nearest), "at", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("up_licence").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id", "path", F.coalesce("licence", "up_licence").alias("licence"), F.when(F.col("licence").isNotNull(), F.col("score")).otherwise(F.coalesce("up_score", F.lit(0.0))).alias("score"),
        origin.alias("origin"), F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("up_path")).alias("licence_path"),
    )
