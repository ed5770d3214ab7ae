r"""Licence scans by a positional index of rare licence words.

A template is a sentence of a licence or of a notice, as a list of words.
Inverse document frequencies of all template words are counted over all
documents.  A template counts as found where words of `SHARE` of its weight
stand at their places, so of its highest-weighted words that together hold more
than the rest, one at least stands there: these are its rare words, and the
index holds the (template, position) postings of them alone.  A file's words
are looked up there, which are its licence words of the highest frequency
weights; each posting implies where its template begins, and postings are
intersected by that beginning.  What is proposed is verified: the words at
their places within the document, and the mandatory phrases.  Beside that stand
the base places: every place where a fixed phrase's words are consecutive.

Null and empty texts have no words and score 0.  A score is the largest
matched share of a template that was found, 1.0 where a base phrase stands.
Each document is judged by its own words alone; repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .storage import mapped

# The phrases whose places are counted, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and sentences of licences as they are written, their labels, and the phrases that must stand in them.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["without any warranty", "gnu general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["gnu general public license"]),
    ("gpl-3.0-only", "spdx license identifier gpl 3 0 only", ["gpl 3 0 only"]),
    ("gpl-2.0-only", "spdx license identifier gpl 2 0 only", ["gpl 2 0 only"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["as is basis", "warranties or conditions of any kind"]),
    ("apache-2.0", "spdx license identifier apache 2 0", ["apache 2 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "spdx license identifier mit", ["identifier mit"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted", "free of charge"]),
    ("mit", "and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["deal in the software without restriction", "merge publish distribute sublicense"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included", "substantial portions"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["provided as is", "noninfringement"]),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software", ["authors or copyright holders be liable"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code", "list of conditions"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form", "list of conditions"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["hereby granted", "without fee"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["authors be held liable"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
]

#: Share of a template's weight that must match in place.
SHARE = 0.75

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, "
    "places array<struct<label:string,start:bigint,score:double>>"
)


class Index:
    """Template postings by word; weights come from document frequencies."""

    def __init__(self) -> None:
        self.words = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()})
        hashes = tx.hash_words(self.words)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.words = [self.words[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        self.templates = [np.array([number[w] for w in t.split()]) for _, t, _ in TEMPLATES]
        self.required = []
        for (_, t, must), ids in zip(TEMPLATES, self.templates, strict=True):
            need = np.zeros(len(ids), bool)
            words = t.split()
            for phrase in must:
                p = phrase.split()
                at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
                need[at : at + len(p)] = True
            self.required.append(need)
        self.base = [(np.array([number[w] for w in p.split()]), label) for p, label in BASE.items()]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """A template word's number from 0, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def weigh(self, df: np.ndarray, n: int) -> Index:
        """Weights of all template words, and the postings of each template's rare ones."""
        self.idf = np.log((n + 1) / (df + 0.5))
        self.weights = [self.idf[t] for t in self.templates]
        found = []
        for t, (ids, weight) in enumerate(zip(self.templates, self.weights, strict=True)):
            rare = np.argsort(-weight, kind="stable")
            # what may fail is less than the weight of these together
            many = int(np.searchsorted(np.cumsum(weight[rare]), (1 - SHARE) * weight.sum() * (1 + 1e-9), "right")) + 1
            found += [(int(ids[p]), t, int(p)) for p in rare[:many]]
        word, template, position = (np.array(c, np.int64) for c in zip(*sorted(found), strict=True))
        self.bounds = np.searchsorted(word, np.arange(len(self.words) + 1))
        self.postings = template, position
        return self

    def proposed(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, word where it would begin, word that proposes it) for all words that have postings, each beginning once."""
        at = np.flatnonzero(number >= 0)
        many = self.bounds[number[at] + 1] - self.bounds[number[at]]
        where = np.repeat(self.bounds[number[at]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = np.repeat(at, many)
        return self.postings[0][where], at - self.postings[1][where], at


def _places(data: np.ndarray, offs: np.ndarray, index: Index) -> tuple:
    """Rows, word numbers in the row and template word numbers of the template words in a slab."""
    low = tx.LOWER[data]
    starts, ends, first = tx.word_spans(low, offs, tx.ALNUM)
    longest = max(map(len, index.words))
    some = np.flatnonzero(ends - starts <= longest)
    number = np.full(len(starts), -1, np.int64)
    if len(some):
        number[some] = index.numbers(tx.word_hashes(low, starts, ends)[some])
    return first, tx.row_of(first, len(starts)), number


def document_frequencies(own: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """How many documents have each template word, over all documents; and how many there are."""

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.words), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, data, offs in tx.slabs(b.column(1)):
                _, row, number = _places(data, offs, index)
                at = number >= 0
                own = np.unique(row[at] * len(df) + number[at])
                df += np.bincount(own % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(df)), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["word", "df"])

    got = {r[0]: r[1] for r in mapped(own, run, "word int, df bigint").groupBy("word").agg(F.sum("df")).collect()}
    return np.array([got.get(k, 0) for k in range(len(index.words))], float), got.get(-1, 0)


def _runs(ids: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Where ids stand consecutively in one row."""
    n = len(number) - len(ids) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:n] == ids[0])
    for j in range(1, len(ids)):
        at = at[(number[at + j] == ids[j]) & (row[at + j] == row[at])]
    return at


def scan_slab(data: np.ndarray, offs: np.ndarray, index: Index) -> list[tuple]:
    first, row, number = _places(data, offs, index)
    rows = len(offs) - 1
    places: list[list[tuple]] = [[] for _ in range(rows)]
    found: list[list[tuple]] = [[] for _ in range(rows)]
    for ids, label in index.base:
        for g in _runs(ids, row, number).tolist():
            places[row[g]].append((g - int(first[row[g]]), label))
    template, begin, by = index.proposed(number)
    # a beginning belongs to the row of the word that proposes it, and nothing outside that row counts
    home = row[by]
    if len(by):
        template, home, begin = np.unique(np.stack([template, home, begin]), axis=1)
    for t in np.unique(template).tolist():
        ids, weight, need = index.templates[t], index.weights[t], index.required[t]
        own = template == t
        where, r = begin[own][:, None] + np.arange(len(ids)), home[own]
        inside = (where >= first[r][:, None]) & (where < first[r + 1][:, None])
        same = inside & (number[np.clip(where, 0, len(number) - 1)] == ids)
        share = (same * weight).sum(axis=1) / weight.sum()
        for k in np.flatnonzero((same | ~need).all(axis=1) & (share >= SHARE)).tolist():
            found[r[k]].append((TEMPLATES[t][0], int(where[k, np.argmax(same[k])] - first[r[k]]), float(min(1.0, share[k]))))
    out = []
    for r in range(rows):
        base = sorted(places[r])
        own = sorted({b[1] for b in base})
        every = sorted({*own, *(f[0] for f in found[r])})
        score = max([f[2] for f in found[r]] + [1.0] * bool(base), default=0.0)
        out.append((int(first[r + 1] - first[r]), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(every), score, sorted(found[r])))
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (`SCHEMA`): base places and labels, all labels, the found templates with the first of their words that stands in place."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = Index()
    index.weigh(*document_frequencies(own, index))
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(place)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for _, _, data, offs in tx.slabs(b.column(1)) for x in scan_slab(data, offs, index)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            cols[-1] = [[{"label": a, "start": s, "score": v} for a, s, v in x] for x in cols[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return mapped(own, run, SCHEMA)
