"""License scans by template markup.

A template is licence wording with two kinds of regions: [[words]] may be absent, and
{{n}} stands for up to n words of any kind. It compiles to an automaton over words,
which accepts a text whose mandatory words match exactly, in order. Words of a whole
chunk are hashed at once; an automaton runs only where the first two mandatory words of
its template stand, and compares words, not hashes.

Base labels come from plain phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import _flat

_SEP = _flat.separators("alnum")

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence wording as templates: label and markup.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license]] [[you may not use this file except in compliance with the license]]",
    "cc-by-nc-4.0-notice": "licensed under [[a]] [[the]] [[creative commons attribution noncommercial]] cc by nc 4 0 [[license]]",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3 [[or later]] [[or any later version]]",
    "gpl-3.0-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 3 [[of the license]] [[or {{3}} any later version]]",
    "isc-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {{3}} to deal in the {{3}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{3}}",
}


@dataclass
class Automaton:
    """edges[s]: (word or None for any word, next state); skips[s]: states reached
    without a word. The last state accepts."""

    edges: list[list[tuple[bytes | None, int]]]
    skips: list[list[int]]
    anchor: tuple[bytes, bytes]
    entry: int

    def accepts(self, words: list[bytes]) -> bool:
        """Whether a prefix of words, read from the anchor on, is accepted."""
        last = len(self.edges) - 1
        now = self._closure({self.entry})
        for w in words:
            if last in now:
                return True
            now = self._closure({t for s in now for word, t in self.edges[s] if word is None or word == w})
            if not now:
                return False
        return last in now

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self) -> int:
        """No accepted reading has more words than there are edges."""
        return len(self.edges)


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; its first two mandatory words must be adjacent."""
    edges: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    plain: list[tuple[int, bytes]] = []

    def step(word: bytes | None) -> None:
        edges[-1].append((word, len(edges)))
        edges.append([])
        skips.append([])

    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        if part == "[[":
            opened.append(len(edges) - 1)
        elif part == "]]":
            skips[opened.pop()].append(len(edges) - 1)
        elif part.startswith("{{"):
            begin = len(edges) - 1
            for _ in range(int(part[2:-2])):
                step(None)
            end = len(edges) - 1
            for s in range(begin, end):
                skips[s].append(end)
        else:
            if not opened:
                plain.append((len(edges) - 1, part.encode()))
            step(part.encode())
    if opened:
        raise ValueError("an optional region is not closed")
    if len(plain) < 2 or plain[1][0] != plain[0][0] + 1:
        raise ValueError("a template needs two adjacent mandatory words first")
    return Automaton(edges, skips, (plain[0][1], plain[1][1]), plain[0][0])


def _hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return _flat.Words(data, np.array([0, len(data)]), _SEP).hash[0]


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.templates = {label: compile_template(m) for label, m in templates.items()}
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        data = _flat.lower_ascii(data)
        words, n_docs = _flat.Words(data, offsets, _SEP), len(offsets) - 1
        h = words.hash[0]
        raw = data.tobytes()
        word = lambda i: raw[words.start[i] : words.end[i]]
        doc = lambda i: int(np.searchsorted(words.of, i, "right")) - 1
        starts: list[list[int]] = [[] for _ in range(n_docs)]
        base: list[set[str]] = [set() for _ in range(n_docs)]
        labels: list[set[str]] = [set() for _ in range(n_docs)]

        def places(sequence: list[bytes]) -> Iterator[tuple[int, int]]:
            n = len(h) - len(sequence) + 1
            if n <= 0:
                return
            hit = np.ones(n, bool)
            for k, x in enumerate(_hash(sequence)):
                hit &= h[k : k + n] == x
            for i in np.flatnonzero(hit).tolist():
                d = doc(i)
                if i + len(sequence) <= words.of[d + 1] and all(word(i + k) == w for k, w in enumerate(sequence)):
                    yield i, d

        for sequence, label in self.phrases:
            for i, d in places(sequence):
                starts[d].append(i - int(words.of[d]))
                base[d].add(label)
        for label, automaton in self.templates.items():
            for i, d in places(list(automaton.anchor)):
                if label not in labels[d] and automaton.accepts([word(j) for j in range(i, min(int(words.of[d + 1]), i + automaton.longest()))]):
                    labels[d].add(label)
        sizes = np.diff(words.of)
        return [
            (int(n), len(s), min(s, default=None), max(s, default=None), ",".join(sorted(b)), ",".join(sorted(b | t)), 1.0 if t else 0.5 if b else 0.0)
            for n, s, b, t in zip(sizes, starts, base, labels)
        ]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start; null without any), base_labels and
    labels (distinct, sorted, comma-joined; labels has those of accepted templates
    too) and score (1 if a template accepts, 0.5 if only a phrase stands, else 0).

    A-Z count as a-z; words are runs of digits, letters and non-ASCII characters.
    Null counts as empty; texts without words have zeros and empty labels. Rows with
    equal ids are rows of their own; other columns are ignored."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            data, offsets = _flat.utf8(batch.column(1))
            for i, j in _flat.chunks(offsets):
                at = offsets[i : j + 1]
                columns = zip(*scanner.scan(data[at[0] : at[-1]], at - at[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *names])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)
