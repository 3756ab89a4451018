"""Operator 7: licence scans with a positional rare-token index.

Templates are notices with mandatory key phrases.  Document frequencies of the
templates' words are counted over the whole table; the index keeps, for each
template, its highest-IDF words with their positions.  In a file those words are
looked up, each occurrence votes for the offset at which its template would
start, and offsets where postings agree are verified: the share of the template's
words that stand in place, and every key phrase, word by word.

The index is as large as the templates, whatever the data.  Each pass is per
document; only word counts of the templates' vocabulary are shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.arrow import keyed_text, slices
from fieldlake.llm.pieces import separate_hashes

# Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory key phrases (separated by "/"), in the public wording of each licence.
TEMPLATES = [
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Licensed under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge/to any person obtaining a copy"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license/version 3"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu general public license/version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general public license/version 2"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gnu general public license/version 2"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Released under the BSD License", "bsd license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license version 1 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public license"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY SA 4.0", "cc by sa 4 0"),
    ("cc0-1.0", "released under the Creative Commons CC0 1.0 Universal public domain dedication", "cc0 1 0 universal"),
]
RARE_WORDS, MIN_SHARE, DRIFT = 4, 0.75, 6

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[ord("0") : ord("9") + 1] = _WORD_BYTES[ord("a") : ord("z") + 1] = _WORD_BYTES[0x80:] = True


@dataclass
class Words:
    """Words of a slice of texts: their hashes, and where each text's words begin."""

    flat: bytes
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.flat[self.begin[i] : self.end[i]]


def words_of(texts: list[str]) -> Words:
    """A-Z lower-cased; a word is a run of ASCII digits, letters and characters beyond ASCII."""
    blobs = [t.encode().lower() for t in texts]
    flat = b"\n".join(blobs) + b"\n"
    codes = np.frombuffer(flat, dtype=np.uint8)
    change = np.flatnonzero(np.diff(_WORD_BYTES[codes], prepend=False, append=False))
    begin, end = change[::2], change[1::2]
    starts = np.cumsum([0] + [len(b) + 1 for b in blobs])
    return Words(flat, begin, end, separate_hashes(codes, begin, end), np.searchsorted(begin, starts))


def places(words: Words, phrase: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Word indices in the slice where the phrase's words stand consecutively in one text."""
    n, k = len(words.hashes), len(phrase)
    if n < k:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(words.hashes[: n - k + 1] == hashes[0])
    for j in range(1, k):
        at = at[words.hashes[at + j] == hashes[j]]
    text = np.searchsorted(words.first, at, side="right")
    at = at[at + k <= words.first[np.minimum(text, len(words.first) - 1)]]
    return at[[all(words.word(i + j) == w for j, w in enumerate(phrase)) for i in at.tolist()]] if len(at) else at


def _split(text: str) -> list[bytes]:
    found = words_of([text])
    return [found.word(i) for i in range(len(found.begin))]


def _hash(words: list[bytes]) -> np.ndarray:
    return words_of([b" ".join(words).decode()]).hashes


class Index:
    """Postings of the templates' rarest words: word hash to (template, position)."""

    def __init__(self, templates: list[tuple[str, str, str]], idf: dict[bytes, float] | None = None, rare_words: int = RARE_WORDS):
        self.templates = [(label, _split(text), [_split(p) for p in keys.split("/")]) for label, text, keys in templates]
        self.hashes = [_hash(words) for _, words, _ in self.templates]
        self.vocabulary = sorted({w for _, words, _ in self.templates for w in words})
        self.base = [(_split(p), label) for p, label in BASE_PHRASES.items()]
        self.base_hashes = [_hash(p) for p, _ in self.base]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.anchors = []
        for t, (_, words, _) in enumerate(self.templates):
            order = sorted(set(words), key=lambda w: (-(idf or {}).get(w, 0.0), w))[:rare_words]
            self.anchors.append(sum(w in order for w in words))
            for q, w in enumerate(words):
                if w in order:
                    self.postings[int(self.hashes[t][q])].append((t, q))
        self.known = np.array(sorted(self.postings), dtype=np.uint64)

    def scan(self, texts: list[str]) -> list[tuple]:
        """For each text: words, base places, first and last base word, base labels, labels, score."""
        words = words_of(texts)
        text_of = lambda at: np.searchsorted(words.first, at, side="right") - 1
        base: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for (phrase, label), hashes in zip(self.base, self.base_hashes, strict=True):
            at = places(words, phrase, hashes)
            for i, text in zip(at.tolist(), text_of(at).tolist(), strict=True):
                base[text].append((i - int(words.first[text]), label))
        hits = np.flatnonzero(np.isin(words.hashes, self.known))
        votes: dict[int, Counter] = defaultdict(Counter)
        for i, text in zip(hits.tolist(), text_of(hits).tolist(), strict=True):
            for t, q in self.postings[int(words.hashes[i])]:
                votes[text][t, i - q] += 1
        out = []
        for text in range(len(texts)):
            low, high = int(words.first[text]), int(words.first[text + 1])
            found = {}
            for (t, offset), n in votes.get(text, {}).items():
                if 2 * n > self.anchors[t]:
                    share = self._verify(words, low, high, t, offset)
                    if share >= MIN_SHARE:
                        found[self.templates[t][0]] = max(share, found.get(self.templates[t][0], 0.0))
            at = sorted(i for i, _ in base.get(text, []))
            labels = {label for _, label in base.get(text, [])}
            score = max([1.0 if labels else 0.0, *found.values()])
            out.append((high - low, len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), score))
        return out

    def _verify(self, words: Words, low: int, high: int, t: int, offset: int) -> float:
        """Share of the template's words in place at ``offset``; 0 if a key phrase is missing near there."""
        _, template, phrases = self.templates[t]
        inside = np.arange(offset, offset + len(template))
        ok = (inside >= low) & (inside < high)
        share = float((words.hashes[inside[ok]] == self.hashes[t][ok]).sum() / len(template))
        begin, end = max(low, offset - DRIFT), min(high, offset + len(template) + DRIFT)
        near = [words.word(i) for i in range(begin, end)]
        for phrase in phrases:
            if not any(near[i : i + len(phrase)] == phrase for i in range(len(near) - len(phrase) + 1)):
                return 0.0
        return share


def inverse_frequencies(docs: DataFrame, templates: list[tuple[str, str, str]]) -> dict[bytes, float]:
    """IDF of every template word over all rows of ``docs`` (``doc_id, text``); a word that no row has gets the largest."""
    vocabulary = Index(templates).vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.array([_hash([w])[0] for w in vocabulary], dtype=np.uint64)
        order = np.argsort(hashes)
        total, rows = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in slices(batches):
            words = words_of(batch.column("text").to_pylist())
            at = np.minimum(np.searchsorted(hashes[order], words.hashes), len(order) - 1)
            hit = np.flatnonzero(hashes[order][at] == words.hashes)
            text = np.searchsorted(words.first, hit, side="right") - 1
            pairs = np.unique(text * len(vocabulary) + order[at[hit]])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            rows += batch.num_rows
        yield pa.record_batch([pa.array([*range(len(vocabulary)), -1], pa.int64()), pa.array([*total.tolist(), rows], pa.int64())], names=["word", "n"])

    counts = {r.word: r.n for r in docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = counts.get(-1, 0)
    return {w: float(np.log((rows + 1) / (counts.get(i, 0) + 1))) for i, w in enumerate(vocabulary)}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """Licence labels of every whole text, a row per input row.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word``
    are the smallest and largest start (null if none), label lists are distinct,
    sorted and comma-joined.  ``score`` is 1 with a base label, else the largest
    share of a verified template's words in place, else 0.  A null text counts as
    empty; null ids and repeated rows are kept; an empty table gives no rows.
    """
    docs = keyed_text(df, id_col, text_col)
    index = df.sparkSession.sparkContext.broadcast(Index(templates, inverse_frequencies(docs, templates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in slices(batches):
            rows = index.value.scan(batch.column("text").to_pylist())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)
