"""Licence notices by a positional index of rare words.

Every text is read once: the places of all licence words (words of any template) are
kept.  Document frequencies of these words over the whole corpus give their IDF; the
index holds each template's words of highest IDF with their positions.  A file's
words are looked up in it, postings of a template are intersected by relative
position, and a place counts once the template's mandatory phrases stand there.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import Words, slices, table, texts_of
from plansift.staging import stage

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_APART = np.zeros(256, bool)
_APART[0x00:0x30] = _APART[0x3A:0x61] = _APART[0x7B:0x80] = True


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


#: Phrases of the contract and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """A notice, and the phrases without which it is not this licence."""
    label: str
    text: str
    keys: tuple[str, ...]


#: Notices as published with the licences (fixed values).
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
                    "the Software", ("permission is hereby granted", "to deal in the software without restriction")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2",)),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                      "Software Foundation; either version 2 of the License, or (at your option) any later version",
             ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                      "Software Foundation, either version 3 of the License, or (at your option) any later version",
             ("gnu general public license", "version 3 of the license")),
    Template("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
                         "either version 2.1 of the License", ("gnu lesser general public license", "version 2 1")),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
                       "either version 3 of the License", ("gnu affero general public license", "version 3")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "Use of this source code is governed by a BSD-style license", ("governed by a bsd style license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                    "granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license v 2",)),
    Template("boost-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
                    "work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
)


@dataclass(frozen=True)
class Index:
    """``rare`` words a template has in the index; ``agree`` of them (a share) must stand at one relative position,
    give or take ``slack`` words for each word of the template (two words at least)."""
    rare: int = 5
    agree: float = 0.6
    slack: float = 0.125


class Vocabulary:
    """Numbers of all words in templates and phrases; its size follows from the templates alone."""

    def __init__(self, templates: tuple[Template, ...], phrases):
        texts = [t.text for t in templates] + [k for t in templates for k in t.keys] + [p for p, _ in phrases]
        self.words = sorted({w for t in texts for w in words_of(t)})
        self.number = {w: i for i, w in enumerate(self.words)}
        self.bytes = [np.frombuffer(w.encode(), np.uint8) for w in self.words]
        hashes = Words([w.encode() for w in self.words], spaces=_APART).hash if self.words else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def ids(self, text: str) -> list[int]:
        return [self.number[w] for w in words_of(text)]

    def find(self, words: Words) -> np.ndarray:
        """Number of each word, -1 for words of no template; equal hashes are told apart by their bytes."""
        found = np.full(len(words.hash), -1, np.int32)
        if not self.words or not len(words.hash):
            return found
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == words.hash)
        number, data = self.order[at[hit]], np.frombuffer(words.data, np.uint8)
        for n in np.unique(number):
            same, word = hit[number == n], self.bytes[n]
            same = same[words.end[same] - words.start[same] == len(word)]
            exact = (data[words.start[same][:, None] + np.arange(len(word))] == word).all(1)
            found[same[exact]] = n
        return found


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def sightings(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, phrases) -> DataFrame:
    """key, n_words, places of licence words and of the phrases; one pass over the texts."""
    wanted = [vocabulary.ids(p) for p, _ in phrases]
    kind = docs.schema[key].dataType.simpleString()

    def look(batches):
        for batch in batches:
            texts, done = texts_of(batch.column(1)), 0
            for start, end in slices(texts):
                words = Words(texts[start:end], lower=True, spaces=_APART)
                number, n = vocabulary.find(words), end - start
                hit = np.flatnonzero(number >= 0)
                columns = [pa.array(words.count, pa.int64()),
                           _lists(hit - words.first[words.doc[hit]], np.bincount(words.doc[hit], minlength=n), pa.int32()),
                           _lists(number[hit], np.bincount(words.doc[hit], minlength=n), pa.int16())]
                at, which = [], []
                for p, ids in enumerate(wanted):
                    here = hit[number[hit] == ids[0]]
                    here = here[here + len(ids) <= words.first[words.doc[here] + 1]]
                    for k, w in enumerate(ids):
                        here = here[number[here + k] == w]
                    at.append(here)
                    which.append(np.full(len(here), p))
                at, which = np.concatenate(at), np.concatenate(which)
                order = np.argsort(at, kind="stable")
                at, which = at[order], which[order]
                counts = np.bincount(words.doc[at], minlength=n)
                columns += [_lists(at - words.first[words.doc[at]], counts, pa.int32()), _lists(which, counts, pa.int16())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], *columns],
                                                 names=["id", "n_words", "at", "word", "base_at", "base"])
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        look, f"id {kind}, n_words long, at array<int>, word array<smallint>, base_at array<int>, base array<smallint>")


def inverse_frequencies(seen: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """IDF of each licence word over all rows; the driver gets one number a word of the templates."""
    counts = seen.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").count().collect()
    total, df = seen.count(), np.zeros(len(vocabulary.words))
    for r in counts:
        df[r["word"]] = r["count"]
    return np.log((total + 1) / (df + 1)) + 1


class Matcher:
    """The positional index over the rarest words of each template, and the check of candidate places."""

    def __init__(self, templates, vocabulary: Vocabulary, idf: np.ndarray, index: Index):
        self.rows = []
        self.index = {}  # word: templates that have it among their rare words
        for t, template in enumerate(templates):
            ids = vocabulary.ids(template.text)
            rare = sorted(set(ids), key=lambda w: (-idf[w], w))[:index.rare]
            slack = max(2, math.ceil(index.slack * len(ids)))
            self.rows.append((template.label, ids, rare, math.ceil(index.agree * len(rare)), slack,
                              [vocabulary.ids(k) for k in template.keys], [float(idf[w]) for w in ids]))
            for w in rare:
                self.index.setdefault(w, []).append(t)
        self.rare = np.zeros(len(vocabulary.words), bool)
        self.rare[list(self.index)] = True

    @staticmethod
    def _within(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a sorted place lies in low..high, for each pair of bounds."""
        return np.searchsorted(places, low, "left") < np.searchsorted(places, high, "right")

    def places(self, at: np.ndarray, word: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, score) of the notices in one file, from its licence words."""
        where = {int(w): at[word == w] for w in np.unique(word[self.rare[word]])}
        met: dict[int, int] = {}
        for w in where:
            for t in self.index[w]:
                met[t] = met.get(t, 0) + 1
        everything, found = None, []
        for t in sorted(met):
            label, ids, rare, need, slack, keys, weights = self.rows[t]
            if met[t] < need:
                continue
            if everything is None:
                everything = {int(w): at[word == w] for w in np.unique(word)}
            none = np.zeros(0, at.dtype)
            offsets = {w: [q for q, x in enumerate(ids) if x == w] for w in rare}
            starts = np.unique(np.concatenate([where.get(w, none) - q for w in rare for q in offsets[w]]))
            votes = sum(np.any([self._within(where.get(w, none), starts + q, starts + q + slack) for q in offsets[w]], axis=0).astype(int)
                        for w in rare)
            starts = starts[votes >= need]
            for phrase in keys:
                stands = everything.get(phrase[0], none)
                for k, w in enumerate(phrase):
                    stands = stands[np.isin(stands + k, everything.get(w, none))]
                starts = starts[self._within(stands, starts, starts + len(ids) + slack - len(phrase))]
            if not len(starts):
                continue
            held = sum(v * self._within(everything.get(w, none), starts + q, starts + q + slack) for q, (w, v) in enumerate(zip(ids, weights)))
            scores, i = held / sum(weights), 0
            while i < len(starts):  # starts of one notice lie next to each other
                j = int(np.searchsorted(starts, starts[i] + len(ids) + slack, "left"))
                best = j - 1 - int(np.argmax(scores[i:j][::-1]))  # the last of equals: words may stand later, not earlier
                found.append((label, max(0, int(starts[best])), int(starts[best]) + len(ids) + slack, float(scores[best])))
                i = j
        return found


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES,
                  phrases=PHRASES, index: Index = Index()) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and the places of every row of ``docs``.

    Words are counted from 0 over the whole text, A-Z in lower case.  ``places``
    are the notices found through the index (label, first_word, end_word, score);
    ``score`` is the best place's share of its template, weighted by IDF, and 1
    where a base phrase stands; 0 where nothing does.  Null and empty texts have no
    words, null places and empty labels.  Repeated rows and rows without a key are
    results of their own; a notice that stands many times gives many places.  An
    empty table gives no rows, texts may be of any length, other columns are not
    read whatever their names.

    Only the places of licence words leave the scan, in one row a text; nothing is
    shuffled but counts of at most as many words as the templates have, and that
    many numbers reach the driver and the tasks.
    """
    vocabulary = Vocabulary(templates, phrases)
    seen = stage(sightings(docs, key, text, vocabulary, phrases), "licence-words")
    matcher = Matcher(templates, vocabulary, inverse_frequencies(seen, vocabulary), index)
    kind = docs.schema[key].dataType.simpleString()
    names = [label for _, label in phrases]

    def match(batches):
        for batch in batches:
            at, word, base_at, base = (batch.column(i) for i in range(2, 6))
            bounds, base_bounds = at.offsets.to_numpy(), base_at.offsets.to_numpy()
            at, word, base_at, base = (x.values.to_numpy(zero_copy_only=False) for x in (at, word, base_at, base))
            rare = np.concatenate([[0], np.cumsum(matcher.rare[word])]) if len(word) else np.zeros(1, int)
            out = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")}
            for i in range(batch.num_rows):
                a, b, c, d = bounds[i], bounds[i + 1], base_bounds[i], base_bounds[i + 1]
                places = matcher.places(at[a:b], word[a:b]) if rare[b] > rare[a] else []
                labels = {names[k] for k in base[c:d]}
                out["n_base"].append(d - c)
                out["first_word"].append(int(base_at[c]) if d > c else None)
                out["last_word"].append(int(base_at[d - 1]) if d > c else None)
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {p[0] for p in places})))
                out["score"].append(1.0 if d > c else min(1.0, max((p[3] for p in places), default=0.0)))
                out["places"].append([dict(zip(("label", "first_word", "end_word", "score"), p)) for p in places])
            place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), place)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]],
                                             names=["id", "n_words", *out])
    found = seen.mapInArrow(match, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                   "score double, places array<struct<label: string, first_word: long, end_word: long, score: double>>")
    return found.withColumnRenamed("id", key)


def op12_licences(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents")).drop("places")
