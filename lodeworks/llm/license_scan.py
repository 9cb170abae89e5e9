"""Licence scan over a positional rare-token index.

Templates are short public licence notices and bare licence names. Of every template the index posts its rarest words
(highest inverse document frequency over the scanned corpus) among those of its mandatory key phrases, with their
positions. A file's words that the index knows are looked up, rarest first; postings of one template that agree on a
relative position (within ``slack`` words) give a candidate place, and there every mandatory phrase is verified. As the
posted words belong to mandatory phrases, a place that holds all phrases always has all its postings: the index loses
nothing.

Defined results: a null or empty text has no words, no labels, null places and score 0; long texts are scanned whole;
a place is counted once per phrase; several labels are sorted and comma-joined; repeated rows get equal results; an
empty table gives an empty table. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: UTF-8 bytes: A-Z to a-z, ASCII that is no letter or digit to a space. Words are then what bytes.split() finds.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Base phrases and their labels, fixed by the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, notice, mandatory key phrases. Notices are the customary short statements of each licence.
NOTICES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "software and associated documentation files"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ["you can redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("bsd", "Licensed under the BSD License", ["bsd license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ["mozilla public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    ("proprietary", "All rights reserved", ["all rights reserved"]),
]

#: Words that a phrase may drift from its place in the notice.
SLACK = 2
#: Key of the count of all documents; no word holds a zero byte.
ALL = b"\x00"
#: Postings of each template.
ANCHORS = 3
#: Score of a file that names a licence without a notice.
BARE_SCORE = 0.5


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words of a UTF-8 text; a word is a run of ASCII letters, digits and characters beyond ASCII."""
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(FOLD).split() if raw else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: (offset of the phrase in the template, its words)
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    slack: int
    base: bool

    def mandatory(self) -> list[tuple[bytes, int]]:
        return [(w, at + i) for at, phrase in self.phrases for i, w in enumerate(phrase)]


def offset_of(phrase: list[bytes], words: list[bytes]) -> int:
    for i in range(len(words) - len(phrase) + 1):
        if words[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"the notice doesn't hold its phrase {b' '.join(phrase)!r}")


def templates(notices=NOTICES, base=BASE, slack: int = SLACK) -> list[Template]:
    out = [Template(label, tuple(w := words_of(phrase)), ((0, tuple(w)),), 0, True) for phrase, label in base.items()]
    for label, notice, phrases in notices:
        w = words_of(notice)
        out.append(Template(label, tuple(w), tuple((offset_of(p, w), tuple(p)) for p in map(words_of, phrases)), slack, False))
    return out


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the templates, and all documents; at most one small row a word and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            held[ALL] += b.num_rows
            for t in b.column(0).to_pylist():
                held.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    return n, n.pop(ALL, 0)


class RareIndex:
    """word -> [(template, position)] over each template's rarest mandatory words, with the words' idf."""

    def __init__(self, found: list[Template], df: dict[bytes, int], n: int, anchors: int = ANCHORS):
        self.templates = found
        self.idf = {w: math.log(1 + (n + 1) / (df.get(w, 0) + 1)) for t in found for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: list[list[tuple[bytes, int]]] = []
        for k, t in enumerate(found):
            # one posting a word: its first mandatory place
            first: dict[bytes, int] = {}
            for w, at in t.mandatory():
                first.setdefault(w, at)
            rare = sorted(first.items(), key=lambda x: (-self.idf[x[0]], x[1]))[:anchors]
            self.anchors.append(rare)
            for w, at in rare:
                self.postings[w].append((k, at))
        self.known = set(self.postings)

    def places(self, words: list[bytes]) -> dict[int, set[int]]:
        """template -> starts at which all its mandatory phrases stand (its phrase places may drift by its slack)."""
        known = self.known
        at: dict[bytes, list[int]] = defaultdict(list)
        if known.isdisjoint(words):
            return {}
        for i, w in enumerate(words):
            if w in known:
                at[w].append(i)
        out: dict[int, set[int]] = {}
        seen: set[int] = set()
        for w in sorted(at, key=lambda w: (-self.idf[w], w)):  # the file's rarest licence words first
            for k, _ in self.postings[w]:
                if k in seen:
                    continue
                seen.add(k)
                t, rare = self.templates[k], self.anchors[k]
                if any(x not in at for x, _ in rare):
                    continue
                lead, lead_at = rare[0]
                starts = {p - lead_at for p in at[lead]}
                for x, q in rare[1:]:  # intersect by relative position
                    near = {p - q for p in at[x]}
                    starts = {s for s in starts if any(s + d in near for d in range(-2 * t.slack, 2 * t.slack + 1))}
                good = {s for s in starts if self.verified(t, words, s)}
                if good:
                    out[k] = good
        return out

    @staticmethod
    def stands(phrase: tuple[bytes, ...], words: list[bytes], at: int) -> bool:
        return at >= 0 and tuple(words[at : at + len(phrase)]) == phrase

    def verified(self, t: Template, words: list[bytes], start: int) -> bool:
        reach = range(-2 * t.slack, 2 * t.slack + 1)
        return all(any(self.stands(p, words, start + o + d) for d in reach) for o, p in t.phrases)

    def likeness(self, t: Template, words: list[bytes], start: int) -> float:
        """Share of the notice's words that stand at their relative position, within the slack."""
        n = len(words)
        return sum(any(0 <= start + i + d < n and words[start + i + d] == w for d in range(-t.slack, t.slack + 1)) for i, w in enumerate(t.words)) / len(t.words)

    def scan(self, text: str | None) -> tuple:
        """(words, base places, first, last, base labels, labels, score)"""
        words = words_of(text)
        found = self.places(words)
        base = [(s, s + len(t.words) - 1, t.label) for k, starts in found.items() if (t := self.templates[k]).base for s in starts]
        starts = [s for s, _, _ in base]
        base_labels: set[str] = {label for _, _, label in base}
        notices = {k: max(self.likeness(self.templates[k], words, s) for s in starts_) for k, starts_ in found.items() if not self.templates[k].base}
        labels = base_labels | {self.templates[k].label for k in notices}
        score = max([0.0, *([BARE_SCORE] if base else []), *notices.values()])
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", notices=NOTICES, base=BASE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = templates(notices, base)
    df, n = document_frequency(docs, {w for t in found for w in t.words}, text)
    index = RareIndex(found, df, n)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [index.scan(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [b.schema.names[0], *names])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("binary")).mapInArrow(scan, f"`{id_column}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
