"""Licence scan through a positional rare-token index.

Templates are indexed by word with their positions. In each file the rarest words of a template, one more of its places
than may be missing, are looked up: a match must hold one of them. Every place where one stands proposes starts, the other
words of the template are then intersected there by relative position, and the mandatory phrases are verified."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Phrases whose every consecutive occurrence counts, and the label each gives.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Label, notice text, phrases that must stand in it.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", ("gnu general public license", "redistribute it and or modify")),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
     "general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("mit-release", "released under the mit license", ("mit license",)),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ("for any purpose with or without fee",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
)
# Words are runs of letters, digits and anything beyond ASCII; A-Z is lower-cased.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

OUT = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
       "matches array<struct<label:string,start:long,score:double>>")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool

    @property
    def slack(self) -> int:
        """Words that may be missing or extra before a place; none in a base phrase."""
        return 0 if self.base else 2


def templates() -> list[Template]:
    cut = lambda s: tuple(words_of(s))
    base = [Template(label, cut(phrase), (cut(phrase),), True) for phrase, label in PHRASES.items()]
    return base + [Template(label, cut(body), tuple(map(cut, keys)), False) for label, body, keys in TEMPLATES]


def document_frequencies(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of texts, and of those with each template word, over all rows. Tasks count; only the vocabulary is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = defaultdict(int), 0
        for batch in batches:
            for value in batch.column(0):
                total += 1
                for word in vocabulary.intersection(words_of(value.as_py() or "")):
                    seen[word] += 1
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in seen)], "n": pa.array([total, *seen.values()], pa.int64())})

    rows = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """Word -> (template, position) postings, with inverse document frequencies of the template words."""

    def __init__(self, known: list[Template], total: int, seen: dict[bytes, int], least: float):
        self.known, self.least = known, least
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(known):
            for at, word in enumerate(template.words):
                self.postings[word].append((t, at))
        self.idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in self.postings}
        self.vocabulary = frozenset(self.postings)
        self.needed = [math.ceil(len(t.words) * (1.0 if t.base else least) - 1e-9) for t in known]
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(known):
            ranked = sorted(range(len(template.words)), key=lambda at: (-self.idf[template.words[at]], template.words[at], at))
            for at in ranked[:len(template.words) - self.needed[t] + 1]:
                self.anchors[template.words[at]].append((t, at))

    def match(self, words: list[bytes]) -> list[tuple[str, int, float, bool]]:
        """(label, start, score, base) of every verified place."""
        present = self.vocabulary.intersection(words)
        likely = {t for t, template in enumerate(self.known) if sum(w in present for w in template.words) >= self.needed[t]
                  and all(w in present for key in template.keys for w in key)}
        if not likely:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for place, word in enumerate(words):
            for t, at in self.anchors.get(word, ()):
                if t in likely:
                    starts[t].update(range(place - at - self.known[t].slack, place - at + self.known[t].slack + 1))
        found = []
        for t, proposed in starts.items():
            template, near = self.known[t], []
            for start in sorted(proposed):
                score = self.agreement(words, template, start)
                if score < self.needed[t] / len(template.words) or not self.has_keys(words, template, start):
                    continue
                if near and (template.base or start - near[-1][2] > template.slack):
                    found.append(self.best(template, near))
                    near = []
                exact = sum(words[start + at:start + at + 1] == [w] for at, w in enumerate(template.words) if start + at >= 0)
                near.append((score, exact, start))
            if near:
                found.append(self.best(template, near))
        return found

    @staticmethod
    def best(template: Template, near: list[tuple[float, int, int]]) -> tuple[str, int, float, bool]:
        """One place of a notice that also agrees when shifted by a word or two: the best score, most words exactly in place, the first."""
        score, _, start = max(near, key=lambda n: (n[0], n[1], -n[2]))
        return template.label, max(start, 0), score, template.base

    @staticmethod
    def agreement(words: list[bytes], template: Template, start: int) -> float:
        hits = 0
        for at, word in enumerate(template.words):
            low = max(start + at - template.slack, 0)
            hits += word in words[low:max(start + at + template.slack + 1, 0)]
        return hits / len(template.words)

    @staticmethod
    def has_keys(words: list[bytes], template: Template, start: int) -> bool:
        span = words[max(start - template.slack, 0):max(start + len(template.words) + template.slack, 0)]
        return all(any(tuple(span[i:i + len(key)]) == key for i in range(len(span) - len(key) + 1)) for key in template.keys)

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        found = self.match(words)
        base = sorted(start for _, start, _, is_base in found if is_base)
        labels = sorted({label for label, _, _, is_base in found if is_base})
        return (len(words), len(base), base[0] if base else None, base[-1] if base else None, labels,
                sorted({f[0] for f in found}), max((f[2] for f in found), default=0.0),
                [{"label": f[0], "start": f[1], "score": f[2]} for f in sorted(found, key=lambda f: (f[1], f[0]))])


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text", least: float = 0.75) -> DataFrame:
    """`keep` and the columns of `OUT`, one row per input row.

    A base phrase counts at every place where its words stand consecutively, overlaps included. A notice counts where at
    least the share `least` of its words stands within two words of its place and its key phrases are whole; no such place is
    lost, wherever else in the text its words stand. Places within two words of each other are one. `score` is
    the best agreement, 0 without a match. Null and empty texts have no words and no labels. Rows are judged alone: ties
    and repeated rows get equal results; other columns are not read; an empty table gives no rows. Two scans of the texts
    (document frequencies, lookup), no shuffle but of the template vocabulary."""
    known = templates()
    total, seen = document_frequencies(docs, text, frozenset(w for t in known for w in t.words))

    def make():
        return Index(known, total, seen, least).scan

    return map_texts(docs, keep, text, OUT, make)
