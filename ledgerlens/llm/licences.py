"""Licence scan by a positional index of rare words.

1. The index holds templates, texts and phrases of licences: for every licence word its postings
   (template, place in it).
2. All documents are read to count how many hold each licence word. Of a template's words the `rare`
   ones of highest inverse document frequency lead into the index; ties go by the word.
3. A second reading looks up the words of every file that are such rare words. Each occurrence names, by
   its postings, the places where a template would begin; occurrences that agree on a place are
   its votes. A template with enough votes at a place is verified: its mandatory key phrases must
   stand there word by word, each at most `slack` words away from its relative place. `share` is the part
   of the template's words that stand in their relative places.

A phrase template is one mandatory phrase. Its rarest word is in every place of the phrase, so one
vote leads to all places and none is lost, whatever else a file holds.

Words are runs of digits, letters and characters beyond ASCII, after A-Z became a-z; they are compared
by 64-bit hashes. Texts are read whole, slice by slice of an Arrow batch (one document at least), so
memory follows the longest document; nothing is shuffled but a count for each licence word.

Defined results: a null text is empty, an empty one has no words and no places. Repeated rows and null
ids are rows like any others. Places of templates may overlap; every one is given, in order of start,
then label. Equal document frequencies go by the word. An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.text import chunks, word_hashes

# Letters, digits and all bytes beyond ASCII; lower case is applied by the hashing.
WORDS = np.zeros(256, dtype=np.uint8)
WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

NOT_WORDS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> tuple[str, ...]:
    """The words of a template, as they are found in documents."""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return tuple(w for w in NOT_WORDS.split(lower) if w)


@dataclass(frozen=True)
class Template:
    """A licence text and the key phrases that must stand in it; a phrase by itself has no others."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    votes: int = 1

    @property
    def words(self) -> tuple[str, ...]:
        return words_of(self.text)

    @property
    def mandatory(self) -> list[tuple[int, tuple[str, ...]]]:
        """(place in the template, words) of each key phrase."""
        own = self.words
        out = []
        for phrase in self.phrases or (self.text,):
            part = words_of(phrase)
            at = [k for k in range(len(own)) if own[k : k + len(part)] == part]
            if not at:
                raise ValueError(f"'{phrase}' is not part of the template of {self.label}")
            out.append((at[0], part))
        return out


# The phrases that name a licence.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
# Opening words of published licence texts and notices, and further names.
TEXTS = (
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in"
        " compliance with the license",
        ("apache license version 2 0", "in compliance with the license"),
        votes=3,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
        votes=3,
    ),
    Template("bsd", "bsd license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu"
        " general public license as published by the free software foundation",
        ("is free software", "gnu general public license"),
        votes=3,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee"
        " is hereby granted",
        ("permission to use copy modify", "is hereby granted"),
        votes=3,
    ),
    Template("lgpl", "gnu lesser general public license"),
    Template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files",
        ("permission is hereby granted", "free of charge"),
        votes=3,
    ),
    Template("mpl", "mozilla public license"),
)


@dataclass(frozen=True)
class Settings:
    rare: int = 6  # words of a template that lead into the index
    slack: int = 3  # words that a key phrase may be away from its relative place


def hashes(words: list[str]) -> np.ndarray:
    """The hashes that these words have in documents."""
    return np.concatenate([word_hashes(pa.array([w]), WORDS)[1] for w in words])


def document_frequencies(documents: DataFrame, words: list[str]) -> dict[str, int]:
    """How many rows of `documents(text)` hold each of `words`; as many numbers as words come back."""
    known = hashes(words)
    order = np.argsort(known)
    known = known[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for whole in batches:
            for batch in chunks(whole, "text"):
                doc, word = word_hashes(batch.column(0), WORDS)
                at, hit = _looked_up(known, word)
                held = np.unique(doc[hit] * len(known) + at[hit]) % len(known)
                total += np.bincount(held, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(total)], names=["word", "docs"])

    found = documents.select("text").mapInArrow(count, "word long, docs long")
    rows = found.groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return dict.fromkeys(words, 0) | {words[r["word"]]: r["docs"] for r in rows}


def _looked_up(known: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in the sorted `known`, and which of them are there."""
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    return at, np.flatnonzero(known[at] == word)


class Index:
    """Postings of rare words, and templates as word numbers."""

    def __init__(self, templates: tuple[Template, ...], docs: dict[str, int], s: Settings) -> None:
        self.settings = s
        vocabulary = sorted({w for t in templates for w in t.words})
        known = hashes(vocabulary)
        order = np.argsort(known)
        self.known = known[order]  # a word's number is its place here
        number = {vocabulary[k]: i for i, k in enumerate(order.tolist())}
        self.labels = [t.label for t in templates]
        self.votes = np.array([t.votes for t in templates])
        self.words = [np.array([number[w] for w in t.words]) for t in templates]
        self.mandatory = [
            [(at, np.array([number[w] for w in part])) for at, part in t.mandatory] for t in templates
        ]
        self.phrase = [not t.phrases for t in templates]
        postings: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(templates):
            # A phrase needs only the rarest of its words, a longer text several that can vote.
            some = 1 if not t.phrases else max(s.rare, t.votes)
            for w in sorted(set(t.words), key=lambda w: (docs[w], w))[:some]:
                for place in (k for k, x in enumerate(t.words) if x == w):
                    postings.setdefault(number[w], []).append((i, place))
        size = np.zeros(len(vocabulary), dtype=np.int64)
        for k, own in postings.items():
            size[k] = len(own)
        self.size, self.first = size, np.cumsum(size) - size
        flat = [p for k in sorted(postings) for p in postings[k]]
        self.template = np.array([i for i, _ in flat], dtype=np.int64)
        self.place = np.array([at for _, at in flat], dtype=np.int64)

    def found(self, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, template, start as place among all words, share) of verified places."""
        at, hit = _looked_up(self.known, word)
        number = np.full(len(word), -1, dtype=np.int64)
        number[hit] = at[hit]
        rare = hit[self.size[at[hit]] > 0]
        size, first = self.size[number[rare]], self.first[number[rare]]
        which = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(rare, size)
        template, start = self.template[which], owner - self.place[which]
        # Votes of one document for one place of one template.
        span = len(word) + max((len(w) for w in self.words), default=0) + 1
        key, votes = np.unique(
            (doc[owner] * len(self.words) + template) * span + start + span - len(word) - 1, return_counts=True
        )
        start = key % span - (span - len(word) - 1)
        template, own = key // span % len(self.words), key // span // len(self.words)
        enough = votes >= self.votes[template]
        template, own, start = template[enough], own[enough], start[enough]
        share, verified = np.zeros(len(start)), np.zeros(len(start), dtype=bool)
        for t in np.unique(template).tolist():
            rows = np.flatnonzero(template == t)
            verified[rows], share[rows] = self._verified(t, own[rows], start[rows], doc, number)
        return own[verified], template[verified], start[verified], share[verified]

    def _verified(self, t: int, own, start, doc, number) -> tuple[np.ndarray, np.ndarray]:
        def stands(words: np.ndarray, at: np.ndarray) -> np.ndarray:
            """For each row and word, whether the word stands in its place in the row's document."""
            place = at[:, None] + np.arange(len(words))
            inside = (place >= 0) & (place < len(doc))
            place = np.where(inside, place, 0)
            return inside & (doc[place] == own[:, None]) & (number[place] == words)

        share = stands(self.words[t], start).mean(axis=1)
        slack = 0 if self.phrase[t] else self.settings.slack
        verified = np.ones(len(start), dtype=bool)
        for at, words in self.mandatory[t]:
            verified &= np.any(
                [stands(words, start + at + k).all(axis=1) for k in range(-slack, slack + 1)], axis=0
            )
        return verified, share


PLACE = "struct<label: string, template: int, start: long, share: double>"


def scan(
    documents: DataFrame, templates: tuple[Template, ...] = BASE + TEXTS, settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, n_words, places) of every row of `documents(doc_id, text)`.

    A place is (label, number of the template, first word, share of the template's words).
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    vocabulary = sorted({w for t in templates for w in t.words})
    index = Index(templates, document_frequencies(documents, vocabulary), settings)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([
            ("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("share", pa.float64())
        ])
        label = pa.array(index.labels, type=pa.string())
        by_label = np.argsort(np.argsort(np.array(index.labels), kind="stable"))
        for whole in batches:
            for batch in chunks(whole, "text"):
                rows = batch.num_rows
                doc, word = word_hashes(batch.column(1), WORDS)
                count = np.bincount(doc, minlength=rows)
                own, template, start, share = index.found(doc, word)
                order = np.lexsort((by_label[template], start, own))
                own, template, start, share = own[order], template[order], start[order], share[order]
                start = start - (np.cumsum(count) - count)[own]
                cuts = np.searchsorted(own, np.arange(rows + 1))
                columns = [label.take(pa.array(template)), *map(pa.array, (template, start, share))]
                places = pa.StructArray.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, place)], fields=list(place)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), places),
                    ],
                    names=["doc_id", "n_words", "places"],
                )

    schema = f"doc_id {kind}, n_words long, places array<{PLACE}>"
    return documents.select("doc_id", "text").mapInArrow(scanned, schema)
