"""Licence scan with a positional index of rare words.

1. The document frequency of every licence word is counted over all documents.
2. Each template enters the index with its ``RARE`` words of highest IDF and their places.
3. The rare words found in a file are looked up, and their postings are intersected by
   relative position (place in the file minus place in the template): ``AGREE`` different rare
   words (or all that a short template has) must agree on one alignment.
4. At that alignment the mandatory key phrases of the template must stand word for word.

The score of a file is the largest share of a found template's words that stand in place; a
file that only mentions a base phrase scores 0.5, any other 0.

Cases: a null text is empty; empty texts have no words and null places; very long texts are
handled a slice at a time; equal documents give equal rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.llm.text import Words, slices, words_of

# Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Label, words of the notice, mandatory key phrases inside it.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        ["permission is hereby granted free of charge"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0",
        ["in compliance with the license", "apache org licenses license 2 0"],
    ),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ["gnu general public license version 3"],
    ),
    (
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ["gnu general public license version 2"],
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        ["free software", "gnu general public license as published by"],
    ),
    (
        "lgpl-notice",
        "under the terms of the gnu lesser general public license as published by the free "
        "software foundation",
        ["gnu lesser general public license"],
    ),
    (
        "agpl-notice",
        "under the terms of the gnu affero general public license as published by the free "
        "software foundation",
        ["gnu affero general public license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license v 2 0"],
    ),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    (
        "cc-by-4.0",
        "licensed under a creative commons attribution 4 0 international license",
        ["creative commons attribution 4 0"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ["with or without fee is hereby granted"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ["free and unencumbered software"],
    ),
]
RARE = 5
AGREE = 2
_SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, licenses array<string>"
)


def _vocabulary(templates: list[tuple[str, str, list[str]]]) -> list[str]:
    """All words of the templates and base phrases: its size does not depend on the corpus."""
    texts = [text for _, text, _ in templates] + list(BASE_PHRASES)
    return sorted({word for text in texts for word in text.split()})


class _Lookup:
    """Word keys of a small vocabulary, found in a slice by a bitmap and a sorted search."""

    def __init__(self, words: list[str]):
        keys = words_of(pa.array(words)).key
        order = np.argsort(keys)
        self.keys, self.words = keys[order], [words[i].encode() for i in order]
        self.present = np.zeros(1 << 16, bool)
        self.present[self.keys >> np.uint64(48)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers in ``self.words``) by key and length; phrases are compared in full later."""
        at = np.flatnonzero(self.present[words.key >> np.uint64(48)])
        slot = np.minimum(np.searchsorted(self.keys, words.key[at]), len(self.keys) - 1)
        same = self.keys[slot] == words.key[at]
        at, slot = at[same], slot[same]
        lengths = np.array([len(w) for w in self.words])
        same = (words.end[at] - words.start[at]) == lengths[slot]
        return at[same], slot[same]


def _frequencies(vocabulary: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total, found = _Lookup(vocabulary), 0, Counter()
        for batch in batches:
            for part in slices(batch, "_text"):
                words = words_of(part.column("_text"))
                at, slot = lookup.find(words)
                pairs = np.unique(words.row[at] * len(lookup.words) + slot)
                found.update((pairs % len(lookup.words)).tolist())
                total += part.num_rows
        names = [lookup.words[i].decode() for i in found]
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([*names, None], pa.string()),
                "n": pa.array([*found.values(), total], pa.int64()),
            }
        )

    return run


def license_word_frequencies(docs: DataFrame, text: str = "text", templates=None) -> DataFrame:
    """Number of documents that hold each licence word; the null word counts all documents."""
    counted = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(
        _frequencies(_vocabulary(templates or TEMPLATES)), "word string, n bigint"
    )
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class _Index:
    """Postings of the rare words of every template, and its key phrases by place."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], idf: dict[str, float]):
        self.templates = [(label, text.split(), keys) for label, text, keys in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed, self.phrases = [], []
        for number, (_, words, keys) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-idf.get(w, math.inf), w))[:RARE]
            self.needed.append(min(AGREE, len(rare)))
            for place, word in enumerate(words):
                if word in rare:
                    self.postings[word.encode()].append((number, place))
            spots = []
            for key in keys:
                parts = key.split()
                spots.append(next(i for i in range(len(words)) if words[i : i + len(parts)] == parts))
            self.phrases.append(list(zip(spots, [k.split() for k in keys])))


def _stands(words: Words, first: int, stop: int, phrase: list[str]) -> bool:
    """Whether the words of a phrase stand at word ``first`` of a row ending at ``stop``."""
    if first + len(phrase) > stop or first < 0:
        return False
    return words.joined(first, len(phrase)) == " ".join(phrase).encode()


def _scan(templates, idf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lookup = _Index(templates, idf), _Lookup(_vocabulary(templates))
        base = {}
        for phrase, label in BASE_PHRASES.items():
            base.setdefault(phrase.split()[0].encode(), []).append((phrase.split(), label))
        for batch in batches:
            for part in slices(batch, "_text"):
                words = words_of(part.column("_text"))
                counts, first = words.counts(), words.first()
                starts: list[list[int]] = [[] for _ in range(part.num_rows)]
                labels: list[set] = [set() for _ in range(part.num_rows)]
                votes: dict[tuple[int, int, int], set] = defaultdict(set)
                at, slot = lookup.find(words)
                for place, number in zip(at.tolist(), slot.tolist()):
                    word, row = lookup.words[number], int(words.row[place])
                    for phrase, label in base.get(word, ()):
                        if _stands(words, place, int(first[row + 1]), phrase):
                            starts[row].append(place - int(first[row]))
                            labels[row].add(label)
                    for template, offset in index.postings.get(word, ()):
                        votes[row, template, place - offset].add(word)
                found: list[set] = [set() for _ in range(part.num_rows)]
                score = [0.5 if x else 0.0 for x in labels]
                for (row, template, origin), agreeing in votes.items():
                    if len(agreeing) < index.needed[template]:
                        continue
                    begin, stop = int(first[row]), int(first[row + 1])
                    if not all(
                        origin + spot >= begin and _stands(words, origin + spot, stop, phrase)
                        for spot, phrase in index.phrases[template]
                    ):
                        continue
                    label, body, _ = index.templates[template]
                    places = [origin + i for i in range(len(body))]
                    standing = sum(
                        begin <= p < stop and words.joined(p, 1) == w.encode()
                        for p, w in zip(places, body)
                    )
                    found[row].add(label)
                    score[row] = max(score[row], standing / len(body))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("_id"),
                        "n_words": pa.array(counts),
                        "n_base": pa.array([len(x) for x in starts], pa.int64()),
                        "first_word": pa.array([min(x, default=None) for x in starts], pa.int64()),
                        "last_word": pa.array([max(x, default=None) for x in starts], pa.int64()),
                        "base_labels": pa.array([",".join(sorted(x)) for x in labels]),
                        "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(labels, found)]),
                        "score": pa.array(score, pa.float64()),
                        "licenses": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                    }
                )

    return run


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=None) -> DataFrame:
    """One row per document with base places, labels, score and the templates found."""
    templates = templates or TEMPLATES
    counts = {r["word"]: r["n"] for r in license_word_frequencies(docs, text, templates).collect()}
    total = counts.pop(None, 0)
    idf = {word: math.log((total + 1) / (n + 1)) for word, n in counts.items()}
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text")
    )
    return narrow.mapInArrow(_scan(templates, idf), _SCHEMA)
