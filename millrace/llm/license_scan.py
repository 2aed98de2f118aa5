"""License scans with a positional index of rare licence words.

Texts become sequences of words. The words of all licence templates and phrases are counted once over the
whole corpus; a template's anchors are its words of highest inverse document frequency, and each file's
anchors, its highest-IDF licence words, are looked up in the index: posting (template, position). An anchor
at word i of a file and position p of a template votes for the template starting at i - p. Votes that
agree up to a few words make a candidate, which counts if every mandatory key phrase of the template stands
near the place its position says. Phrases are found the same way: by their rarest word, then verified
word by word. Every occurrence of every anchor is looked up, so no place of a phrase is missed.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import alphanumeric_words, slices

#: Highest-IDF words of a template that are looked up, distinct ones that must agree, and how many words
#: agreeing votes and key phrases may be apart (edited names and years shift what follows).
ANCHORS, AGREEING, SLACK = 12, 3, 20


@dataclass(frozen=True)
class Template:
    """A licence text or notice; ``keys`` are phrases out of it that must be there."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Phrase -> label, fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public licence notices as they are commonly written, and the short lines that stand for them.
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at",
        ("apache license version 2", "in compliance with the license"),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version",
        ("gnu general public license", "free software foundation", "version 3"),
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version",
        ("gnu general public license", "free software foundation", "version 2"),
    ),
    Template(
        "gpl-3",
        "licensed under the GNU General Public License, version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl-2",
        "licensed under the GNU General Public License, version 2",
        ("gnu general public license version 2",),
    ),
    Template(
        "lgpl-3",
        "licensed under the GNU Lesser General Public License, version 3",
        ("gnu lesser general public license version 3",),
    ),
    Template(
        "agpl-3",
        "licensed under the GNU Affero General Public License, version 3",
        ("gnu affero general public license version 3",),
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at",
        ("mozilla public license", "source code form is subject to the terms"),
    ),
    Template(
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products",
        ("redistribution and use in source and binary forms", "neither the name of"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies",
        ("with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("mit", "Released under the MIT License", ("under the mit license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("under cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("under cc by sa",)),
    Template(
        "cc-by-sa",
        "licensed under a Creative Commons Attribution-ShareAlike International License",
        ("creative commons attribution sharealike",),
    ),
    Template(
        "cc-by-nc",
        "licensed under a Creative Commons Attribution-NonCommercial International License",
        ("creative commons attribution noncommercial",),
    ),
)

def _words(text: str) -> tuple[bytes, ...]:
    return tuple(alphanumeric_words(text.encode()))


class Index:
    """Postings of anchors: word -> (template, position) and word -> (phrase, position)."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str], df: dict[bytes, int], n: int):
        idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1))
        rarest = lambda words: sorted(set(words), key=lambda w: (-idf(w), w))
        self.labels = [t.label for t in templates]
        self.templates = [_words(t.text) for t in templates]
        self.phrases = list(dict.fromkeys([*map(_words, phrases), *(_words(k) for t in templates for k in t.keys)]))
        number = {p: i for i, p in enumerate(self.phrases)}
        self.base = {number[_words(p)]: label for p, label in phrases.items()}
        self.keys, self.need, at = [], [], defaultdict(lambda: ([], []))
        for no, (t, words) in enumerate(zip(templates, self.templates)):
            anchors = rarest(words)[:ANCHORS]
            self.need.append(min(AGREEING, len(anchors)))
            for p, w in enumerate(words):
                if w in anchors:
                    at[w][0].append((no, p))
            self.keys.append([(number[k], _place(words, k)) for k in map(_words, t.keys)])
        for no, phrase in enumerate(self.phrases):
            anchor = rarest(phrase)[0]
            at[anchor][1].append((no, phrase.index(anchor)))
        self.at = dict(at)

    def places(self, words: list[bytes]) -> list[tuple[str, int, int, bool, float]]:
        """``(label, first word, words, base, share)`` of every phrase and template found, in order."""
        at = self.at
        starts, votes = defaultdict(list), defaultdict(list)
        for i in [i for i, w in enumerate(words) if w in at]:
            postings, phrases = at[words[i]]
            for no, p in postings:
                votes[no].append((i - p, words[i]))
            for no, p in phrases:
                phrase = self.phrases[no]
                if i >= p and tuple(words[i - p : i - p + len(phrase)]) == phrase:
                    starts[no].append(i - p)
        found = [(self.base[no], s, len(self.phrases[no]), True, 1.0) for no in starts if no in self.base for s in starts[no]]
        for no, own in votes.items():
            if all(starts[k] for k, _ in self.keys[no]):
                found += self._aligned(no, sorted(own), starts, words)
        return sorted(found, key=lambda x: (x[1], x[0], not x[3], x[2]))

    def _aligned(self, no: int, votes: list, starts: dict, words: list[bytes]) -> Iterator[tuple]:
        text, first = self.templates[no], 0
        for i in range(1, len(votes) + 1):
            if i < len(votes) and votes[i][0] - votes[i - 1][0] <= SLACK:
                continue
            group, first = votes[first:i], i
            low, high = group[0][0] - SLACK, group[-1][0] + SLACK
            if len({w for _, w in group}) < self.need[no] or not all(
                _any_within(starts[k], low + p, high + p) for k, p in self.keys[no]
            ):
                continue
            counts = Counter(o for o, _ in group)
            best = min(counts, key=lambda o: (-counts[o], o))
            same = sum(0 <= best + p < len(words) and words[best + p] == w for p, w in enumerate(text))
            yield self.labels[no], max(best, 0), len(text), False, same / len(text)


def _place(words: tuple, phrase: tuple) -> int:
    """Where ``phrase`` stands in ``words``; its longest beginning if it is not whole there."""
    for n in range(len(phrase), 0, -1):
        for p in range(len(words) - n + 1):
            if words[p : p + n] == phrase[:n]:
                return p
    return 0


def _any_within(sorted_: list[int], low: int, high: int) -> bool:
    at = bisect.bisect_left(sorted_, low)
    return at < len(sorted_) and sorted_[at] <= high


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.string()), "").cast(pa.large_binary()).to_pylist()


def build_index(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES
) -> Index:
    """The index, with document frequencies of the licence words counted over all ``docs(text)``. The count
    is combined per batch and task; the driver gets a row per licence word."""
    vocabulary = {w for t in templates for w in _words(t.text)} | {
        w for p in [*phrases, *(k for t in templates for k in t.keys)] for w in _words(p)
    }

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in slices(batches):
            for text in _texts(batch.column(0)):
                seen.update(vocabulary.intersection(alphanumeric_words(text)))
            n += batch.num_rows
        # The empty word counts the documents.
        rows = [(b"", n), *seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64())], ["word", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {bytes(r["word"]): r["n"] for r in counted.collect()}
    return Index(templates, phrases, df, df.pop(b"", 0))


def license_places(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id, n_words, places`` of every row of ``docs(doc_id, text)``: each place's label, first word,
    number of words, whether it is a base phrase, and the share of the template that stands there as it is."""
    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    place = pa.struct(
        [("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, places = [], []
            for text in _texts(batch.column(1)):
                words = alphanumeric_words(text)
                n.append(len(words))
                places.append([dict(zip(place.names, p)) for p in index.places(words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(place))],
                ["doc_id", "n_words", "places"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, "
        "places array<struct<label:string,first:long,words:long,base:boolean,share:double>>",
    )


def scanned(docs: DataFrame) -> DataFrame:
    """The digest of every row of ``docs(doc_id, text)``, in whatever order and with whatever other columns.

    Null and empty texts have no words: 0 words, 0 places, no labels, score 0. Rows that share an id, or are
    equal, are scanned each; rows with a null id too. Of equally rare words the alphabetically first is the
    anchor. Whole texts are read however long; memory is that of one text's words. An empty table gives
    no rows. ``score`` is 1 where a base phrase stands, else the largest share of a template in place.
    """
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(
        F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ","
    )
    starts = F.transform(F.col("__base"), lambda p: p["first"])
    return (
        license_places(docs, build_index(docs))
        .withColumn("__base", base)
        .select(
            "doc_id",
            "n_words",
            F.size("__base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            labels(F.col("__base")).alias("base_labels"),
            labels(F.col("places")).alias("labels"),
            F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        )
    )
