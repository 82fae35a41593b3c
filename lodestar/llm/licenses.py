"""License scans by a positional index of rare template words.

Each template's words have an IDF over the templates, and each template is posted under its
rarest words with their positions. A file's rare licence words are looked up from the highest
IDF down; each meeting of a word at p with a posting at q votes for a start p - q, and starts on
which enough rare words of a template agree are verified: the share of the template's IDF that
stands at its place, and the template's mandatory key phrases word by word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import PLAIN, rounds, tidy


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Each must stand word by word where the template was found.
    keys: tuple[str, ...]
    #: The whole template must stand word by word, and each place counts.
    base: bool = False


#: The base phrases and the notices that the index knows.
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Rare words of a template that are posted, and how many of them must agree on a start.
POSTED, AGREEING = 3, 2
#: Words by which a template's word may be off its place, and the least share of IDF in place.
SLACK, LEAST_SHARE = 2, 0.6


class LicenseIndex:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [t.text.split() for t in templates]
        self.keys = [[k.split() for k in t.keys] for t in templates]
        counts: dict[str, int] = defaultdict(int)
        for words in self.words:
            for w in set(words):
                counts[w] += 1
        self.idf = {w: math.log(1 + len(templates) / n) for w, n in counts.items()}
        self.weight = [sum(self.idf[w] for w in words) for words in self.words]
        #: Word: (template, its position, bit of the rare word).
        self.postings: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        self.needed = []
        for t, words in enumerate(self.words):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[: len(set(words)) if templates[t].base else POSTED]
            self.needed.append(len(rare) if templates[t].base else min(AGREEING, len(rare)))
            for bit, word in enumerate(rare):
                self.postings[word] += [(t, q, 1 << bit) for q, w in enumerate(words) if w == word]
        self.rare_bytes = frozenset(w.encode() for w in self.postings)

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, float, bool]]]:
        """Number of words, and the (label, first word, words, score, base) found, in order."""
        words = text.encode("utf-8", "surrogatepass").translate(PLAIN).split()
        rare = {w.decode(): [] for w in self.rare_bytes.intersection(words)}
        if len(rare) < 2:
            return len(words), []
        own = {w.encode(): w for w in rare}
        for at, w in enumerate(words):
            if w in own:
                rare[own[w]].append(at)
        votes: list[dict[int, int]] = [defaultdict(int) for _ in self.templates]
        for word in sorted(rare, key=lambda w: (-self.idf[w], w)):
            for t, q, bit in self.postings[word]:
                mine = votes[t]
                for p in rare[word]:
                    mine[p - q] |= bit
        found = []
        for t, starts in enumerate(votes):
            found += self._verified(t, starts, words)
        return len(words), sorted(found, key=lambda x: (x[1], x[0], x[2]))

    def _verified(self, t: int, starts: dict[int, int], words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        template, mine, need = self.templates[t], self.words[t], self.needed[t]
        out, last = [], None
        for start in sorted(starts):
            if template.base:
                if starts[start].bit_count() >= need and start >= 0 and self._stands(mine, words, start):
                    out.append((template.label, start, len(mine), 1.0, True))
                continue
            agree = 0
            for near in range(start - SLACK, start + SLACK + 1):
                agree |= starts.get(near, 0)
            if agree.bit_count() < need or last is not None and start - last < len(mine) // 2:
                continue
            share = self._share(mine, words, start) / self.weight[t]
            low, high = max(0, start - SLACK), start + len(mine) + SLACK
            if share >= LEAST_SHARE and all(any(self._stands(k, words, p) for p in range(low, high - len(k) + 1)) for k in self.keys[t]):
                out.append((template.label, max(0, start), len(mine), min(1.0, share), False))
                last = start
        return out

    @staticmethod
    def _stands(phrase: list[str], words: list[bytes], start: int) -> bool:
        return start + len(phrase) <= len(words) and all(words[start + i] == w.encode() for i, w in enumerate(phrase))

    def _share(self, mine: list[str], words: list[bytes], start: int) -> float:
        total = 0.0
        for q, w in enumerate(mine):
            low, high = max(0, start + q - SLACK), min(len(words), start + q + SLACK + 1)
            if low < high and w.encode() in words[low:high]:
                total += self.idf[w]
        return total


MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, matches array of (label, start, length, score, base)), a row for each row of ``docs``.

    Whole texts, no shuffle. Null and empty texts have no words and no matches; a base phrase
    that stands several times gives as many matches; repeated rows are scanned each; other columns
    aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates)
        for batch in batches:
            for at, texts in rounds(batch, 1):
                found = [index.scan(t) for t in texts]
                matches = [[dict(zip(("label", "start", "length", "score", "base"), m, strict=True)) for m in x] for _, x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([n for n, _ in found], pa.int64()), pa.array(matches, MATCH)],
                    names=["doc_id", "n_words", "matches"],
                )

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    match = "array<struct<label: string, start: long, length: long, score: double, base: boolean>>"
    return picked.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, matches {match}")
