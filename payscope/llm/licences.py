"""Licence scans by a trained paragraph classifier (operator 10).

*Paragraphs.* Lines; a line that does not end a sentence is joined with the next, unless that is blank.  What is classified is a
passage: the words around vocabulary words, ``MARGIN`` to either side, so a notice inside a long paragraph counts like one of its own.
*Classifier.* Multinomial logistic regression over the word 1- to 3-grams of a passage (binary, digits as '#').  It is trained here: positives are
the templates of each licence family with words dropped, neighbours added and versions changed; negatives are fixed sentences that use the vocabulary otherwise, and
windows around vocabulary words that touch no shingle of a template.  Such windows are sought in every document's whole text; of the distinct ones the model is
fitted on the ``fit_passages`` of least hash (default ``FIT_PASSAGES``, the only bound), whatever the order of rows and partitions.
*Unknown.* A fixed share of the training passages is set aside; on it, and on templates robbed of their family's own words, the margin of the best family over the rest is calibrated (a logistic function of
the margin), and a passage without a confirmed template is of unknown class where the calibrated probability is below one half, or where "no licence" leads with less
than ``SURE_NONE``.
*Confirmation.* A prediction counts as confirmed where the text holds at least ``SIMILARITY`` of the five-word shingles of one of the family's
templates (templates under five words: the whole of it) within ``WINDOW`` words.
*Several notices.* A passage may hold many.  Every stretch of a passage that confirms a template is classified by itself, and what is left of the passage in
windows of ``WINDOW`` words that overlap by half; a passage gives a row for each notice found.
*Gate.* Features are n-grams that hold a vocabulary word.  The vocabulary is fixed (``GATE``), whatever the documents hold, and every template has a
word of it.  A passage without such a word has no feature and is no licence text by the model itself, so texts are first matched against the
vocabulary (Aho-Corasick) and only passages around matches are classified; this loses nothing.

Cases: null and empty texts have no passages; every document gives one row, with empty lists where it holds no licence text; repeated rows
give a row each; texts of any length are read whole; an empty table gives an empty result; other columns of the documents, whatever their
names, are not read and not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from payscope.llm.common import table

FIT_PASSAGES = 2000
MARGIN = 30
SIMILARITY = 0.8
SHINGLE = 5
COPIES = 40
SURE_NONE = 0.8
WINDOW = 4 * MARGIN  # over the longest template's words, with room for words put in
NONE, UNKNOWN = "none", "unknown"

#: Notices of licence families (fixed values).
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This software is distributed under the Apache License 2.0.",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "This software is released under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."],
}
#: Words that open the gate (fixed values); every template holds some.
GATE = ("affero apache attribution binary bsd cc commons creative dedicated domain foundation gnu gpl granted hereby isc lesser license licensed mit "
        "mozilla noncommercial permission permitted redistribute redistribution sharealike software sublicense unencumbered").split()
#: Sentences that use licence words otherwise (fixed values).
OTHERWISE = ["A driver's license is needed to rent a car.", "The license plate was stolen last night.", "Her medical license was revoked by the board.",
             "The bar lost its liquor license in May.", "Poets take some license with the facts.", "They asked permission to cross the public garden.",
             "The general public was not admitted.", "Free software is a matter of liberty, the speaker said.", "The foundation published its annual report.",
             "Copyright law was debated in parliament.", "The creative writing course is open to the public.", "He works at MIT on robots.",
             "Apache helicopters flew over the base.", "The version of events he gave was false.", "All rights of appeal were exhausted.",
             "The gnu is an African antelope.", "A copy of the software was found on the disk.", "Commons and lords debated the bill.",
             "No warranty covers damage by water.", "The terms of the loan were harsh.", "Distribution of food began at noon.", "The software was slow."]

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_JOIN = re.compile(r"(?<=[^\s.!?:;])[^\S\n]*\n(?=[^\S\n]*\S)")
_BLOCK = re.compile(r"\n")


def tokens_of(text: str) -> list[str]:
    return ["#" if t[0].isdigit() else t for t in _TOKEN.findall(text.lower().replace("licence", "license"))]


def grams_of(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i: i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def _shingles(tokens: list[str]) -> list[tuple[str, ...]]:
    n = min(SHINGLE, len(tokens))
    return [tuple(tokens[i: i + n]) for i in range(len(tokens) - n + 1)]


def similarity(tokens: list[str], template: list[str]) -> float:
    """Share of the template's shingles that the passage holds."""
    wanted = set(_shingles(template))
    n = min(SHINGLE, len(template))
    return len(wanted & {tuple(tokens[i: i + n]) for i in range(len(tokens) - n + 1)}) / max(len(wanted), 1)


TEMPLATE_TOKENS = [(f, tokens_of(t)) for f, ts in TEMPLATES.items() for t in ts]
_OF_TEMPLATES = {s for _, t in TEMPLATE_TOKENS for s in _shingles(t)}
_LENGTHS = sorted({len(s) for s in _OF_TEMPLATES})
#: Of each shingle: the templates that hold it; of each template: how many distinct shingles confirm it.
_HOLDERS = {s: [k for k, (_, t) in enumerate(TEMPLATE_TOKENS) if s in _shingles(t)] for s in _OF_TEMPLATES}
_ENOUGH = [SIMILARITY * len(set(_shingles(t))) - 1e-9 for _, t in TEMPLATE_TOKENS]


def confirmed_spans(tokens: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, family) of the stretches of at most ``WINDOW`` words that confirm a template; those of one template do not overlap."""
    at: dict[int, list[tuple[int, int, tuple]]] = {}
    for n in _LENGTHS:
        for i in range(len(tokens) - n + 1):
            s = tuple(tokens[i: i + n])
            for k in _HOLDERS.get(s, ()):
                at.setdefault(k, []).append((i, i + n, s))
    out = []
    for k, found in at.items():
        seen: dict[tuple, int] = {}
        first, j = 0, 0
        while j < len(found):
            seen[found[j][2]] = seen.get(found[j][2], 0) + 1
            while found[j][1] - found[first][0] > WINDOW or seen[found[first][2]] > 1:  # too far, or there again later
                seen[found[first][2]] -= 1
                if not seen[found[first][2]]:
                    del seen[found[first][2]]
                first += 1
            j += 1
            if len(seen) >= _ENOUGH[k]:
                while j < len(found) and found[j][2] not in seen and found[j][1] - found[first][0] <= WINDOW:  # the rest of the same notice
                    seen[found[j][2]] = 1
                    j += 1
                out.append((found[first][0], found[j - 1][1], TEMPLATE_TOKENS[k][0]))
                first, seen = j, {}
    return sorted(out)


def ordinary(tokens: list[str]) -> list[list[str]]:
    """Overlapping windows that touch no shingle of a template."""
    touched = [i for n in _LENGTHS for i in range(len(tokens) - n + 1) if tuple(tokens[i: i + n]) in _OF_TEMPLATES for i in range(i, i + n)]
    marks = np.zeros(len(tokens) + 1, dtype=np.int64)
    marks[np.array(touched, dtype=np.int64) + 1] = 1
    before = np.cumsum(marks)
    size = 2 * MARGIN
    return [tokens[i: i + size] for i in range(0, len(tokens), MARGIN) if before[min(i + size, len(tokens))] == before[i]]


def matcher_of(vocabulary: list[str]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in vocabulary or ["\0"]:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def passages_of(matcher, own: frozenset[str], text: str) -> Iterator[list[str]]:
    """Passages around the words ``own``, which ``matcher`` finds, as tokens."""
    for block in _BLOCK.split(_JOIN.sub(" ", text)):
        if not _holds_word(matcher, block.lower().replace("licence", "license")):
            continue
        tokens = tokens_of(block)
        hits = [i for i, t in enumerate(tokens) if t in own]
        at = 0
        while at < len(hits):
            end = at
            while end + 1 < len(hits) and hits[end + 1] - hits[end] <= MARGIN:
                end += 1
            yield tokens[max(0, hits[at] - MARGIN): hits[end] + MARGIN + 1]
            at = end + 1


def _holds_word(matcher, text: str) -> bool:
    """A match that no letter goes before or follows."""
    end = len(text)
    return any(not text[last + 1: last + 2].isalpha() and not (last >= n and text[last - n].isalpha()) if last + 1 < end
               else not (last >= n and text[last - n].isalpha()) for last, n in matcher.iter(text))


@dataclass
class Model:
    families: list[str]  # the last is NONE
    vocabulary: list[str]
    features: dict[str, int]
    weights: np.ndarray  # (features + 1, families)
    scale: float
    shift: float

    def passages(self, matcher, text: str) -> Iterator[list[str]]:
        return passages_of(matcher, self.own, text)

    def __post_init__(self):
        self.own = frozenset(self.vocabulary)
        self.templates = {f: [tokens_of(t) for t in ts] for f, ts in TEMPLATES.items()}

    def matcher(self):
        return matcher_of(self.vocabulary)

    def classify(self, tokens: list[str]) -> tuple[str, float, float]:
        """(family, calibrated probability, similarity to its nearest template)."""
        rows = [self.features[g] for g in grams_of(tokens) if g in self.features]
        z = self.weights[-1] + self.weights[rows].sum(axis=0)
        best = int(z.argmax())
        if self.families[best] == NONE:
            p = np.exp(z - z.max())
            return (NONE if p[best] / p.sum() >= SURE_NONE else UNKNOWN), 0.0, 0.0
        p = 1 / (1 + np.exp(-(self.scale * _margin(z, best) + self.shift)))
        near = max(similarity(tokens, t) for t in self.templates[self.families[best]])
        return (self.families[best] if p >= 0.5 or near >= SIMILARITY else UNKNOWN), float(p), near


    def notices(self, tokens: list[str]) -> list[tuple[str, float, float]]:
        """(family, calibrated probability, similarity) of every notice of a passage, in order; runs of equal unconfirmed findings once."""
        out, left = [], np.ones(len(tokens), dtype=bool)
        for start, end, f in confirmed_spans(tokens):
            family, p, near = self.classify(tokens[start:end])
            if family == f and near >= SIMILARITY:
                out.append((start, family, p, near))
                left[start:end] = False
        sure = {f for _, f, _, _ in out}
        edges = np.flatnonzero(np.diff(np.r_[False, left, False].astype(np.int8)))
        before = None
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for i in range(a, max(b - WINDOW // 2, a + 1), WINDOW // 2):
                part = tokens[i: min(i + WINDOW, b)]
                family, p, near = self.classify(part) if self.own.intersection(part) else (NONE, 0.0, 0.0)
                if family not in (NONE, before) and family not in sure:  # beside a notice: the rest of its text
                    out.append((i, family, p, near))
                before = family
        return [row[1:] for row in sorted(out, key=lambda row: row[0])]


def _margin(z: np.ndarray, best: int) -> float:
    rest = np.delete(z, best)
    top = rest.max()
    return float(z[best] - top - np.log(np.exp(rest - top).sum()))


def _softmax(x: list[list[int]], y: np.ndarray, n_features: int, n_classes: int, rounds: int = 60, step: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression on sparse binary rows, by AdaGrad over the whole set."""
    w, g2 = np.zeros((n_features + 1, n_classes)), np.full((n_features + 1, n_classes), 1e-8)
    flat = np.concatenate([np.array(r + [n_features]) for r in x])
    owner = np.repeat(np.arange(len(x)), [len(r) + 1 for r in x])
    want = np.eye(n_classes)[y]
    for _ in range(rounds):
        z = np.zeros((len(x), n_classes))
        np.add.at(z, owner, w[flat])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = np.zeros_like(w)
        np.add.at(grad, flat, ((p - want) / len(x))[owner])
        grad += decay * w
        g2 += grad * grad
        w -= step * grad / np.sqrt(g2)
    return w


def _varied(rng: np.random.Generator, words: list[str], fillers: list[str]) -> list[str]:
    out = [w for w in words if rng.random() > 0.04 or len(words) < 4]
    around = lambda: [fillers[i] for i in rng.integers(0, len(fillers), rng.integers(0, 12))] if fillers else []
    return around() + out + around()


def train(negatives: list[list[str]], fillers: list[str], seed: int = 11) -> Model:
    """Fit the classifier; ``negatives`` are passages without licence text that hold words of the gate, ``fillers`` words of theirs."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, NONE]
    templates = [(k, tokens_of(t)) for k, f in enumerate(families[:-1]) for t in TEMPLATES[f]]
    positives = [(k, _varied(rng, t, fillers)) for k, t in templates for _ in range(COPIES)] + templates
    vocabulary = list(GATE)
    own = set(vocabulary)
    if not all(own.intersection(t) for _, t in templates):
        raise ValueError("every template must hold a word of the gate")
    features: dict[str, int] = {}
    for _, t in templates:
        for g in sorted(grams_of(t)):
            if own.intersection(g.split(" ")):
                features.setdefault(g, len(features))
    other = [tokens_of(t) for t in OTHERWISE]
    rows = positives + [(len(families) - 1, t) for t in other for _ in range(COPIES // 4)] + [(len(families) - 1, _varied(rng, t, fillers)) for t in other for _ in range(COPIES // 4)]
    rows += [(len(families) - 1, n) for n in negatives] + [(len(families) - 1, [])] * COPIES
    order = rng.permutation(len(rows))
    aside, used = order[: len(order) // 5], order[len(order) // 5:]
    sparse = lambda t: sorted({features[g] for g in grams_of(t) if g in features})
    x, y = [sparse(t) for _, t in rows], np.array([k for k, _ in rows])
    w = _softmax([x[i] for i in used], y[used], len(features), len(families))
    # calibration: is the best family right, by margin, on the passages set aside and on half-familiar ones
    margins, right = [], []
    for i in aside.tolist():
        z = w[-1] + w[x[i]].sum(axis=0)
        best = int(z[:-1].argmax())
        margins.append(_margin(z, best))
        right.append(float(y[i] == best))
    for k, t in templates:
        for _ in range(6):  # half of a template's words, out of order: not that licence
            z = w[-1] + w[sparse([t[i] for i in rng.permutation(len(t))[: max(1, len(t) // 2)]])].sum(axis=0)
            margins.append(_margin(z, int(z[:-1].argmax())))
            right.append(0.0)
    of = {}
    for k, t in templates:
        for word in t:
            of.setdefault(word, set()).add(k)
    for k, t in [(k, t) for k, t in templates if any(len(of[word]) == 1 for word in t)]:
        for _ in range(6):  # a template without the words of that family alone: another licence
            z = w[-1] + w[sparse(_varied(rng, [word if len(of[word]) > 1 else "\0" for word in t], fillers))].sum(axis=0)
            margins.append(_margin(z, int(z[:-1].argmax())))
            right.append(0.0)
    m, r = np.array(margins), np.array(right)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        grad = np.array([((p - r) * m).mean() + 1e-3 * a, (p - r).mean()])
        hess = np.array([[(p * (1 - p) * m * m).mean() + 1e-3, (p * (1 - p) * m).mean()], [(p * (1 - p) * m).mean(), (p * (1 - p)).mean() + 1e-6]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return Model(families, vocabulary, features, w, float(max(a, 1e-3)), float(b))


def ordinary_passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(passage): distinct windows of all texts that hold a word of the gate and touch no shingle of a template, as words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matcher = frozenset(GATE), matcher_of(list(GATE))
        for b in batches:
            found = {" ".join(w) for text in b.column(0) for tokens in passages_of(matcher, own, text.as_py() or "")
                     for w in ordinary(tokens) if own.intersection(w)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["passage"])

    return docs.select(text_col).mapInArrow(run, "passage string").distinct()


def fit(docs: DataFrame, text_col: str = "text", fit_passages: int = FIT_PASSAGES) -> Model:
    """Train on templates and on at most ``fit_passages`` ordinary passages: of the distinct ones of all documents those of least hash."""
    rows = ordinary_passages(docs, text_col).orderBy(F.xxhash64("passage"), "passage").limit(fit_passages).collect()  # at most fit_passages windows
    negatives = [r["passage"].split(" ") for r in rows]
    return train(negatives, sorted({w for n in negatives for w in n}.difference(GATE)))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, families (confirmed, distinct, sorted), unconfirmed (predicted, not confirmed), n_unknown, passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        matcher = own.matcher()
        for b in batches:
            found = []
            for text in b.column(1):
                rows = []
                for tokens in own.passages(matcher, text.as_py() or ""):
                    rows += [(family, p, near, near >= SIMILARITY and family != UNKNOWN) for family, p, near in own.notices(tokens)]
                found.append(rows)
            sure = [sorted({f for f, _, _, c in rows if c}) for rows in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sure, pa.list_(pa.string())),
                 pa.array([sorted({f for f, _, _, c in rows if not c and f != UNKNOWN}) for rows in found], pa.list_(pa.string())),
                 pa.array([sum(f == UNKNOWN for f, *_ in rows) for rows in found], pa.int64()),
                 pa.array([[dict(zip([k for k, _ in kinds], r)) for r in rows] for rows in found], pa.list_(pa.struct(kinds)))],
                [id_col, "families", "unconfirmed", "n_unknown", "passages"])

    more = "families array<string>, unconfirmed array<string>, n_unknown long, passages array<struct<family:string,probability:double,similarity:double,confirmed:boolean>>"
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL(more).fields])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs)).drop("passages")


QUERIES = {"op10_licence_scan": op10_licence_scan}
ORACLE_SQL: dict[str, str] = {}  # the trained classifier has no SQL form; tests/llm holds planted and held-out notices
