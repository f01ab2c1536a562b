"""License scans: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over word 1- to 3-grams tells licence
families apart from each other and from ordinary prose. It is trained here: on
notices written from public licence wordings with words dropped, swapped and
surrounded, and, for the unknown class, on a bounded sample of corpus
paragraphs without licence wording (``SAMPLE`` paragraphs, lowest by hash).
Probabilities are calibrated by a temperature fitted on a held-out part; below
``CUTOFF`` a paragraph is unknown. A prediction is confirmed only if its words
also cover a template of the family (share of the template's word pairs found
in the paragraph, at least ``SIMILARITY``).

The scan reads whole texts, line by line; a line is a paragraph. Lines up to a
blank one are also judged joined, so a notice may be wrapped. A line or joined
lines that aren't confirmed as a whole are confirmed by any window of about a
template's length that is. Weights are a table of bounded size that travels
with the tasks.

Result: one row a document (doc_id, family, families, n_paragraphs,
n_licensed, probability, similarity): ``family`` is the most probable
confirmed one, ``families`` all of them in order, both '' where there is none.
``n_paragraphs`` counts lines that aren't blank, ``n_licensed`` the confirmed
ones and, once each, families that only the joined lines confirm.

Defined results: null, empty and blank texts have no paragraphs and no
family. Ties go to the family that sorts first. Repeated rows are scanned
alike; null ids are kept; extra columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.memory import tidy

SAMPLE, CUTOFF, SIMILARITY, COPIES, SEED = 1500, 0.8, 0.5, 60, 3
UNKNOWN = "unknown"
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "MIT License",
        "This project is available under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Distributed under the GPL version 3 or later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "GNU Lesser General Public License version 3",
        "Distributed under the LGPL version 2.1 or later",
    ],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "Distributed under the AGPL version 3 or later"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License",
        "Licensed under the BSD license",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without prior written permission", "Copyright. All rights reserved."],
}
_WORD = re.compile(r"[^\W_]+")
_FILLER = "project file code see details here the a this and of our new data note page book text first software for use terms version public work general under license free open".split()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(w: list[str]) -> list[str]:
    return w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] + [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]


def pairs(w: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset((x, "") for x in w)


LEXICON = frozenset(x for rows in TEMPLATES.values() for t in rows for x in words(t))
_STRONG = frozenset("license licensed licence gpl lgpl agpl mit apache bsd mozilla creative commons cc cc0 gnu copyright copyleft reserved redistribution permission granted".split())


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last one is UNKNOWN
    index: dict[str, int]  # n-gram -> row
    weights: np.ndarray  # n-gram x family
    bias: np.ndarray
    temperature: float

    def probabilities(self, w: list[str]) -> np.ndarray:
        rows = sorted({self.index[g] for g in grams(w) if g in self.index})
        z = self.bias + (self.weights[rows].sum(axis=0) if rows else 0.0)
        return softmax(z[None, :] / self.temperature)[0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def notices(copies: int = COPIES, seed: int = SEED) -> list[tuple[list[str], str]]:
    """Training notices: templates as they are, worn, and between other words."""
    rng, out = random.Random(seed), []
    for family, rows in TEMPLATES.items():
        for t in rows:
            base = words(t)
            out.append((base, family))
            for _ in range(copies):
                w = [x for x in base if rng.random() > 0.08 or x in _STRONG or len(base) < 5]
                w = [x if not x.isdigit() or rng.random() < 0.6 else str(rng.randint(1, 4)) for x in w]
                w = rng.choices(_FILLER, k=rng.choice((0, 0, 1, 3, 6))) + w + rng.choices(_FILLER, k=rng.choice((0, 0, 2, 5)))
                out.append((w, family))
    for _ in range(copies * 12):  # licence words in no licence's order
        w = rng.choices(sorted(LEXICON - _STRONG), k=rng.randint(1, 14))
        out.append((w + rng.choices(_FILLER, k=rng.randint(0, 8)), UNKNOWN))
    return out


def train(others: list[str], seed: int = SEED, steps: int = 300) -> Model:
    """Fits weights on four fifths and the temperature on the rest."""
    data = notices(seed=seed) + [(words(t), UNKNOWN) for t in others]
    random.Random(seed).shuffle(data)
    families = (*sorted(TEMPLATES), UNKNOWN)
    held = len(data) // 5
    vocabulary: dict[str, int] = {}
    for w, _ in (notices(0, seed)):
        for g in grams(w):
            vocabulary.setdefault(g, len(vocabulary))
    for x in _FILLER:
        vocabulary.setdefault(x, len(vocabulary))
    a = np.zeros((len(data), len(vocabulary)), np.float32)
    for i, (w, _) in enumerate(data):
        a[i, [vocabulary[g] for g in grams(w) if g in vocabulary]] = 1
    y = np.array([families.index(f) for _, f in data])
    one = np.eye(len(families), dtype=np.float32)[y]
    weights, bias = np.zeros((a.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    x, target = a[held:], one[held:]
    balance = (1 / np.maximum(1, target.sum(axis=0)))[target.argmax(axis=1)][:, None] * len(target) / len(families)
    mw, vw = np.zeros_like(weights), np.zeros_like(weights)
    mb, vb = np.zeros_like(bias), np.zeros_like(bias)
    for k in range(1, steps + 1):
        e = (softmax(x @ weights + bias) - target) * balance / len(x)
        for p, g, m, v in ((weights, x.T @ e + 1e-5 * weights, mw, vw), (bias, e.sum(axis=0), mb, vb)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    z = a[:held] @ weights + bias
    loss = lambda t: -np.log(softmax(z / t)[np.arange(held), y[:held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.5, 5, 40), key=loss))
    return Model(families, vocabulary, weights, bias, temperature)


def sample_paragraphs(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` whole corpus paragraphs without licence wording, the lowest by hash of those of some sampled texts.

    Texts are sampled by hash first, about twice as many as there are paragraphs
    wanted, so that what the tasks hand in doesn't grow with the corpus.
    """
    few = 2 * sample / max(1, docs.count())
    texts = docs.select("text") if few >= 1 else docs.select("text").where(F.xxhash64(F.lit(SEED), "text") < int(-(2**63) + few * 2**64))
    lines = texts.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("p")).where(F.length(F.trim("p")) > 0)
    strong = "(?i)(^|[^\\p{L}\\p{N}])(" + "|".join(sorted(_STRONG)) + ")($|[^\\p{L}\\p{N}])"
    rows = lines.where(~F.col("p").rlike(strong)).distinct().orderBy(F.xxhash64(F.lit(SEED), "p"), "p").limit(sample)
    return [r["p"] for r in rows.collect()]


def judge(model: Model, templates: dict[str, list[frozenset]], line: str) -> tuple[str, float, float] | None:
    """(family, probability, similarity) of a confirmed paragraph, else None."""
    w = words(line)
    p = model.probabilities(w)
    best = int(np.argmax(p))
    family = model.families[best]
    if family == UNKNOWN or p[best] < CUTOFF:
        return None
    have = pairs(w) | {(x, "") for x in w}
    sim = max(len(t & have) / len(t) for t in templates[family])
    return (family, float(p[best]), sim) if sim >= SIMILARITY else None


def template_pairs() -> dict[str, list[frozenset]]:
    return {f: [pairs(words(t)) for t in rows] for f, rows in TEMPLATES.items()}


def windows(templates: dict[str, list[frozenset]], w: list[str]) -> Iterator[list[str]]:
    """The stretches of ``w`` of about a template's length that cover enough of it, from each of its word pairs on."""
    every = frozenset().union(*(t for rows in templates.values() for t in rows))
    at = [(i, p) for i, p in enumerate(zip(w, w[1:])) if p in every]
    have = {p for _, p in at}
    for rows in templates.values():
        for t in rows:
            if len(t & have) < SIMILARITY * len(t):
                continue
            size = len(t) + len(t) // 4 + 2
            for i, p in at:
                if p in t and len(t.intersection(zip(w[i : i + size], w[i + 1 : i + size]))) >= SIMILARITY * len(t):
                    yield w[i : i + size]


def confirmed(model: Model, templates: dict[str, list[frozenset]], text: str) -> list[tuple[str, float, float]]:
    """The families of a line or of joined lines, as a whole or else by windows."""
    whole = judge(model, templates, text)
    if whole:
        return [whole]
    best: dict[str, tuple[str, float, float]] = {}
    seen: set[str] = set()
    for x in windows(templates, words(text)):
        part = " ".join(x)
        if part not in seen:
            seen.add(part)
            h = judge(model, templates, part)
            if h and (h[0] not in best or h[1] > best[h[0]][1]):
                best[h[0]] = h
    return list(best.values())


def hits_of(model: Model, templates: dict[str, list[frozenset]], needed: re.Pattern, text: str) -> list[tuple[str, float, float]]:
    """All that is confirmed in a text, line by line and, for what no line shows, in lines joined up to a blank one."""
    hits = []
    for blank, group in groupby(text.split("\n"), key=lambda x: not x.strip()):
        lines = [] if blank else list(group)
        alone = [h for x in lines if needed.search(x) for h in confirmed(model, templates, x)]
        hits += alone
        if len(lines) > 1 and needed.search(joined := " ".join(lines)):
            shown = {h[0] for h in alone}
            hits += [h for h in confirmed(model, templates, joined) if h[0] not in shown]
    return hits


def scan(docs: DataFrame, sample: int = SAMPLE, model: Model | None = None) -> DataFrame:
    model = model or train(sample_paragraphs(docs, sample))
    templates = template_pairs()
    needed = telling_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                lines = [x for x in (text or "").split("\n") if x.strip()]
                hits = hits_of(model, templates, needed, text) if text and needed.search(text) else []
                hits.sort(key=lambda h: (-h[1], h[0]))
                top = hits[0] if hits else ("", 0.0, 0.0)
                out.append((top[0], ",".join(sorted({h[0] for h in hits})), len(lines), len(hits), round(top[1], 6), round(top[2], 6)))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))],
                names=["doc_id", "family", "families", "n_paragraphs", "n_licensed", "probability", "similarity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, family string, families string, n_paragraphs bigint, n_licensed bigint, probability double, similarity double"
    )


def telling_pattern() -> re.Pattern:
    """A confirmed paragraph covers half of a template, so it holds one of the template's words that
    prose has only by chance; a text without any of them can't be confirmed and needs no score."""
    return re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(sorted(telling(), key=len, reverse=True)) + r")(?![^\W_])")


def telling() -> frozenset[str]:
    """A set of words of which every half of every template's pairs uses at least one.

    Built greedily: for each template, its words by strength until fewer than
    half of its pairs avoid them all.
    """
    chosen = set(_STRONG & LEXICON)
    for rows in TEMPLATES.values():
        for t in rows:
            p = pairs(words(t))
            free = lambda: [x for x in p if not (set(x) & chosen)]
            while len(free()) >= SIMILARITY * len(p):
                left = free()
                count: dict[str, int] = {}
                for x in left:
                    for v in x:
                        if len(v) > 5:
                            count[v] = count.get(v, 0) + 1
                pool = count or {v: 1 for x in left for v in x if v}
                chosen.add(min(pool, key=lambda v: (-pool[v], v)))
    return frozenset(chosen)
