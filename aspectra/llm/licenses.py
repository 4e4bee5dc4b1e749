"""Licence statements by a trained paragraph classifier (operator 7).

A paragraph is a block of lines between blank ones; comment marks and line
breaks do not count.  It is read in overlapping windows of words.  Sparse
logistic regressions over word 1- to 3-grams give each window a probability
per licence family, and one that it states a licence at all.  They are fitted
on the templates below, on statements worded around the families' names, alone
and in pairs, and on statements of licences outside the families, against
sentences that use similar words.  Scores are calibrated (Platt) on a held-out
part.  A window may state several families; one that states a licence, but no
known family, is of the class ``unknown``.  A prediction is confirmed by
comparing the words around with the family's templates: enough of a template's
words, in order.

Windows whose words cannot reach a probability of one half, by the sum of
their positive weights, are passed over.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import require, spread, text_or_empty

#: Share of a template's words that a paragraph must hold in order.
CONFIRM = 0.7
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 60, 30
#: The class of windows that state a licence of no known family.
UNKNOWN = "unknown"
#: Weight of the ridge in the regressions.
PENALTY = 0.3

#: Statements of licence families (fixed values).
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
}

#: Names that statements use for the families (fixed values), for training only.
NAMES = {
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache 2.0 license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "2-clause BSD license"),
    "cc": ("CC BY 4.0", "CC BY-NC 4.0", "Creative Commons Attribution license", "CC BY-NC-SA 3.0"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPL version 3", "GNU General Public License, version 2", "GNU General Public License version 3"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 2"),
    "mit": ("MIT License", "MIT licence"),
    "mpl": ("Mozilla Public License", "MPL 2.0", "Mozilla Public License, v. 2.0"),
    "unlicense": ("Unlicense", "CC0 1.0 Universal", "public domain dedication"),
}

#: How statements are worded around a name, for training only.
FRAMES = (
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This library is licensed under the {}.",
    "This tool is distributed under the terms of the {}.",
    "The software is available under the {}, see the file.",
)

#: Sentences with similar words that state no licence (fixed values).
LOOKALIKES = (
    "The driver must show a valid driving license to the officer.",
    "Her licence plate was registered under a different name.",
    "The general public was invited to the opening of the work.",
    "Version 2.0 of the program was released under pressure in May.",
    "The foundation granted permission to use the building free of charge.",
    "Public transport is free of charge for any person under six.",
    "This work is the result of ten years in the field.",
    "He was released under the condition that he report weekly.",
    "The terms of the agreement were published by the board.",
    "Copyright law is taught in the second year of the course.",
    "The Mozilla and Apache projects have many contributors.",
    "Fishing is licensed under state law and subject to a fee.",
    "Students at MIT released a new study of source and binary stars.",
    "Creative people in common rooms share without conditions.",
)

#: Names of licences outside the families (fixed values), for training only.
OTHERS = (
    "Zlib License", "Eclipse Public License 2.0", "Artistic License", "Boost Software License", "ISC License",
    "European Union Public Licence", "Python Software Foundation License", "vendor license agreement",
    "terms of a separate licence", "Example Corp Source Licence, version 1",
)

#: Frequent words that say nothing about licences (fixed values), for training only.
FREQUENT = (
    "the of in and to a or is for this with that be by on as it from under any you may not are use was were has have "
    "an at its their which general public free work works version terms source 1 2 3 0"
).split()

_WORD = re.compile(r"[^\W_]+")
_BLOCK = re.compile(r"(?:[^\n]*\S[^\n]*(?:\n|$))+")


def words_of(text: str) -> list[str]:
    """Lower-cased words, digits included."""
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    """The 1-, 2- and 3-grams of a word sequence."""
    out = set(words)
    out.update(map(" ".join, zip(words, words[1:])))
    out.update(map(" ".join, zip(words, words[1:], words[2:])))
    return out


@dataclass
class Classifier:
    """Per class (families, then the licence class): weights, bias and Platt scale."""

    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # n-grams x classes
    bias: np.ndarray
    scale: np.ndarray
    offset: np.ndarray

    def __post_init__(self):
        self.singles = {g for g in self.vocabulary if " " not in g}
        self.positive = np.maximum(self.weights, 0)
        # Scores at which a probability is one half.
        self.half = -self.offset / self.scale

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Calibrated probabilities by class."""
        rows = [self.vocabulary[g] for g in sorted(grams_of(words)) if g in self.vocabulary]
        score = self.weights[rows].sum(axis=0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * score + self.offset, -40, 40)))

    def classify(self, words: list[str]) -> list[tuple[str, float]]:
        """All families of at least one half, or unknown if a licence is stated, or nothing."""
        p = self.probabilities(words)
        found = [(f, float(x)) for f, x in zip(self.families, p) if x >= 0.5]
        return found or ([(UNKNOWN, float(p[-1]))] if p[-1] >= 0.5 else [])

    def windows(self, words: list[str]) -> list[int]:
        """Where windows begin that can reach one half for some class."""
        starts = list(range(0, max(1, len(words) - STRIDE), STRIDE))
        get = self.vocabulary.get
        one = [get(w, -1) for w in words]
        rows, places = [], []
        for i, k in enumerate(one):
            if k >= 0:
                rows.append(k)
                places.append(i)
                if i + 1 < len(one) and one[i + 1] >= 0:
                    two = f"{words[i]} {words[i + 1]}"
                    if (k := get(two, -1)) >= 0:
                        rows.append(k)
                        places.append(i)
                    if i + 2 < len(one) and one[i + 2] >= 0 and (k := get(f"{two} {words[i + 2]}", -1)) >= 0:
                        rows.append(k)
                        places.append(i)
        total = np.zeros((len(rows) + 1, self.positive.shape[1]))
        np.cumsum(self.positive[rows], axis=0, out=total[1:])
        low = np.searchsorted(places, starts)
        high = np.searchsorted(places, np.array(starts) + WINDOW)
        most = total[high] - total[low] + self.bias
        return [s for s, ok in zip(starts, (most >= self.half).any(axis=1).tolist()) if ok]


# -- templates --------------------------------------------------------------


@lru_cache(maxsize=1)
def _template_words() -> dict[str, list[list[str]]]:
    return {family: [words_of(t) for t in templates] for family, templates in TEMPLATES.items()}


def best_stretch(words: list[str], template: list[str]) -> tuple[float, int, int]:
    """(share of the template found in order, first word, last word + 1), densest stretch."""
    best = (0.0, 0, 0)
    blocks = [b for b in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if b.size]
    for i, first in enumerate(blocks):
        near = [b for b in blocks[i:] if b.a + b.size - first.a <= 2 * len(template)]
        if near:
            share = sum(b.size for b in near) / len(template)
            if share > best[0]:
                best = (share, first.a, near[-1].a + near[-1].size)
    return best


def similarity(words: list[str], family: str) -> tuple[float, int, int]:
    """The best stretch of the family's templates."""
    return max((best_stretch(words, t) for t in _template_words()[family]), key=lambda x: x[0])


def stretches(words: list[str], family: str) -> list[tuple[float, int, int]]:
    """All disjoint stretches that confirm a family, or else the best one there is."""
    found: list[tuple[float, int, int]] = []
    known = set(words)
    for template in _template_words()[family]:
        if sum(w in known for w in template) < CONFIRM * len(template):
            continue
        parts = [(0, len(words))]
        while parts:
            a, b = parts.pop()
            share, first, last = best_stretch(words[a:b], template)
            if share >= CONFIRM:
                found.append((share, a + first, a + last))
                parts += [(a, a + first), (a + last, b)]
    kept: list[tuple[float, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1])):
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1]) or [similarity(words, family)]


# -- training -----------------------------------------------------------------


def _examples() -> tuple[list[list[str]], list[tuple[str, ...]]]:
    """Training windows and their families (() for none); deterministic."""
    rng = np.random.default_rng(11)
    plain = [words_of(t) for t in LOOKALIKES]
    loose = sorted({w for t in plain for w in t})
    mixtures = [[loose[int(i)] for i in rng.integers(len(loose), size=int(n))] for n in rng.integers(5, WINDOW, size=600)]
    texts, family = [], []

    def add(words, *families):
        texts.append(words)
        family.append(families)

    for words in plain * 8 + mixtures:
        add(words)
    for n in rng.integers(3, WINDOW, size=800):  # prose of unknown words and frequent ones, and frequent ones alone
        add([FREQUENT[int(i)] for i in rng.integers(len(FREQUENT), size=int(n))])
    for _ in range(300):  # several sentences, as a window has
        add([w for k in rng.integers(len(plain), size=4) for w in plain[int(k)]][:WINDOW])

    def around(words, i):
        spare = mixtures[int(rng.integers(len(mixtures)))][:25]
        return [words, spare + words, words + spare][i % 3]

    names = {**NAMES, UNKNOWN: OTHERS}
    for name in names:
        fixed = TEMPLATES.get(name, ())
        framed = [f.format(n) for n in names[name] for f in FRAMES]
        for template in [*fixed, *framed]:
            own = words_of(template)
            for i in range(24 if template in fixed else 9):
                add(around([w for w in own if i < 8 or rng.random() > 0.1], i), name)
    known = sorted(NAMES)
    for a in known:  # two families in one statement
        for b in known:
            if a != b and {a, b} != {"gpl", "lgpl"}:  # the one's words are among the other's
                for i in range(3):
                    pair = [NAMES[k][int(rng.integers(len(NAMES[k])))] for k in (a, b)]
                    frame = FRAMES[int(rng.integers(len(FRAMES)))]
                    add(around(words_of(frame.format(" or the ".join(pair))), i), a, b)
    return texts, family


@lru_cache(maxsize=1)
def train() -> Classifier:
    """Fits the classifier on its fixed statements.

    One regression per family against all else and one for any licence, on
    lists of n-grams; every fourth example is held out to calibrate.
    Deterministic.
    """
    from .quality import fit_terms, sigmoid

    texts, family = _examples()
    sets = [grams_of(w[: 2 * WINDOW]) for w in texts]
    counts: dict[str, int] = {}
    for s, f in zip(sets, family):
        if f:
            for g in s:
                counts[g] = counts.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 6))}
    has = [sorted(vocabulary[g] for g in s if g in vocabulary) for s in sets]
    held = np.array([zlib.crc32(" ".join(w).encode()) % 4 == 0 for w in texts])
    families = sorted(TEMPLATES)
    classes = len(families) + 1
    y = np.array([[*(name in f for name in families), bool(f)] for f in family], float)
    w, b = np.zeros((len(vocabulary), classes)), np.zeros(classes)
    fitted = [h for h, out in zip(has, held) if not out]
    scale, offset = np.ones(classes), np.zeros(classes)
    for k in range(classes):
        w[:, k], b[k] = fit_terms(fitted, y[~held, k], len(vocabulary), PENALTY, rounds=15, tolerance=1e-3)
        s = np.array([w[h, k].sum() + b[k] for h, out in zip(has, held) if out])
        t = y[held, k]
        a, c = 1.0, 0.0
        n1, n0 = t.sum(), len(t) - t.sum()
        target = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(200):  # Platt's two parameters, with his smoothed targets
            error = sigmoid(a * s + c) - target
            a -= 0.1 * float((error * s).mean())
            c -= 0.1 * float(error.mean())
        scale[k], offset[k] = max(a, 0.1), c
    return Classifier(families, vocabulary, w, b, scale, offset)


# -- scanning -------------------------------------------------------------------


def scan(text: str, classifier: Classifier) -> list[tuple[int, str, float, float, bool, int, int]]:
    """(paragraph, family, probability, similarity, confirmed, start, end).

    start and end are character offsets in the text.  All disjoint statements
    of a family are listed.  Windows of the unknown class that touch no
    statement of a family are one finding where they overlap.
    """
    out = []
    for number, block in enumerate(_BLOCK.finditer(text)):
        raw = block.group()
        spans = [m.span() for m in _WORD.finditer(raw)]
        words = [raw[a:b].lower() for a, b in spans]
        if classifier.singles.isdisjoint(words):
            continue
        found: dict[str, list] = {}
        other: list[list] = []
        for at in classifier.windows(words):
            for name, p in classifier.classify(words[at : at + WINDOW]):
                if name == UNKNOWN:
                    if other and at < other[-1][1]:
                        other[-1] = [other[-1][0], at + WINDOW, max(p, other[-1][2])]
                    else:
                        other.append([at, at + WINDOW, p])
                    continue
                first = max(0, at - WINDOW)  # a statement may begin before its window
                for share, a, b in stretches(words[first : at + 2 * WINDOW], name):
                    own = found.setdefault(name, [])
                    a, b = a + first, b + first
                    if b > a and all(b <= x or a >= y for _, _, x, y in own):
                        own.append((p, share, a, b))
        stated = [f for own in found.values() for f in own]
        rows = [(name, *f) for name, own in found.items() for f in own]
        for a, b, p in other:
            b = min(b, len(words))
            if all(b <= x or a >= y for _, _, x, y in stated):
                rows.append((UNKNOWN, p, max(similarity(words[a:b], f)[0] for f in classifier.families), a, b))
        # What no template confirms, where a surer family is stated, is that family's words.
        surer = lambda r: any(o[1] > r[1] and r[3] < o[4] and o[3] < r[4] for o in rows)
        rows = [r for r in rows if r[2] >= CONFIRM or not surer(r)]
        for name, p, share, a, b in sorted(rows, key=lambda r: (r[3], r[0])):
            start, end = block.start() + spans[a][0], block.start() + spans[b - 1][1]
            out.append((number, name, p, share, share >= CONFIRM and name != UNKNOWN, start, end))
    return out


def scan_licenses(
    docs: DataFrame,
    classifier: Classifier | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed, start, end).

    One row per licence statement: known families, confirmed or not, and
    statements of unknown licences.  Whole texts are read.  Null and empty
    texts give no rows, repeated rows repeat, other columns are dropped.
    Without a classifier the one of the fixed statements is trained.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    classifier = classifier or train()

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["id", "paragraph", "family", "probability", "similarity", "confirmed", "start", "end"]
        for batch in batches:
            rows = [
                (i, n, f, round(p, 4), round(s, 4), c, a, b)
                for i, text in enumerate(batch.column(1).to_pylist())
                for n, f, p, s, c, a, b in scan(text, classifier)
            ]
            if rows:
                columns = list(zip(*rows))
                owner = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [owner, *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:]))], names=names
                )

    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    return picked.mapInArrow(
        run,
        f"id {kind}, paragraph int, family string, probability double, similarity double,"
        " confirmed boolean, start long, end long",
    )
