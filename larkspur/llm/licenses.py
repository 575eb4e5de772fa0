"""License scans by matching templates with markup.

A template is the wording of a license or notice. Words have to stand as they are, one after the other; a region in
square brackets may be missing, {a-b} stands for a to b words of any kind (names, years, places), and round brackets hold
wordings that replace each other. Every template is compiled to states of one token automaton, which reads the words of a
text once; a place is accepted where all mandatory wording has been read. Base phrases are templates without markup.

Only texts with a cue are read by the automaton. The cue of a template is the longest word that all of its wordings have,
so that a text without any cue can't be accepted; the words of all texts are counted, from bytes.

Edge cases: a null or wordless text has no words, places or labels and the score 0; repeated rows are told again; an empty
table gives an empty result; places may overlap and all count; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

# Base phrases, and the wordings of licenses and their notices.
PHRASES = """
mit: under the mit license
apache-2: apache license version 2
cc-by-nc: cc by nc
"""
TEMPLATES = """
mit: (licensed|released|distributed|published|available|provided) under the [terms of the] mit license
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software
apache-2: (licensed|released|distributed|published|available|provided) under the [terms of the] apache license [version] 2 [0]
apache-2: licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license you may obtain a copy of the license at {2-12} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl-2: (licensed|released|distributed|published|available|provided) under the [terms of the] gnu general public license [as published by the free software foundation] (version 2|v2) [0]
gpl-2: under the terms of the gnu general public license as published by the free software foundation [either] version 2 [0] of the license
gpl-3: (licensed|released|distributed|published|available|provided) under the [terms of the] gnu general public license [as published by the free software foundation] (version 3|v3) [0]
gpl-3: under the terms of the gnu general public license as published by the free software foundation [either] version 3 [0] of the license
lgpl: under the [terms of the] gnu (lesser|library) general public license [as published by the free software foundation]
agpl-3: under the [terms of the] gnu affero general public license [as published by the free software foundation] [either] (version 3|v3)
bsd-2-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [this software is provided by {1-12} as is]
bsd-3-clause: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [3] neither the name of {1-16} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
isc: permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
mpl-2: subject to the terms of the mozilla public license v 2 0
cc0: cc0 1 0 [universal]
cc0: under [the] creative commons (zero|cc0)
cc-by: licensed under [a|the] (cc by|creative commons attribution) (2 0|2 5|3 0|4 0|license|international)
cc-by-sa: licensed under [a|the] (cc by sa|creative commons attribution (sharealike|share alike)) [2 0|2 5|3 0|4 0] [international] [license]
cc-by-nc: licensed under [a|the] (cc by nc|creative commons attribution (noncommercial|non commercial)) [2 0|2 5|3 0|4 0] [international] [license]
unlicense: this is free and unencumbered software released into the public domain
all-rights-reserved: [copyright [c] {1-12}] all rights reserved
"""
WORD = rb"[0-9a-z\x80-\xff]+"
#: A wording of n mandatory words scores n / (n + HALF): longer exact wordings tell more.
HALF = 4


def parsed(wording: str) -> list:
    """The markup as a list of words, ("gap", a, b), ("optional", choices) and ("choice", choices); choices are lists of such lists."""
    marks = iter(re.findall(r"[\[\](|)]|\{\d+-\d+\}|[^\s\[\](|){}]+", wording))

    def choices(closing: str | None) -> list[list]:
        out: list[list] = [[]]
        for mark in marks:
            if mark == closing:
                return out
            if mark == "|":
                out.append([])
            elif mark in "[(":
                out[-1].append(("optional", choices("]")) if mark == "[" else ("choice", choices(")")))
            elif mark[0] == "{":
                out[-1].append(("gap", *map(int, mark[1:-1].split("-"))))
            else:
                out[-1].append(mark)
        if closing:
            raise ValueError(f"{closing!r} is missing in {wording!r}")
        return out

    (made,) = choices(None)
    return made


def mandatory(parts: list) -> list[str]:
    """Words that every accepted text has."""
    return [p for p in parts if isinstance(p, str)]


def shortest(parts: list) -> int:
    """Words of the shortest accepted text, without replaceable ones."""
    return sum(1 if isinstance(p, str) else min(map(shortest, p[1])) if p[0] == "choice" else 0 for p in parts)


def as_regex(parts: list) -> str:
    """The wordings as a regular expression over words that each have one space after them."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += f"{p} "
        elif p[0] == "gap":
            out += f"(?:[^ ]+ ){{{p[1]},{p[2]}}}"
        else:
            out += f"(?:{'|'.join(map(as_regex, p[1]))})" + ("?" if p[0] == "optional" else "")
    return out


def listed(text: str) -> list[tuple[str, list]]:
    lines = [line.split(": ", 1) for line in text.strip().splitlines()]
    return [(label, parsed(wording)) for label, wording in lines]


class TemplateAutomaton:
    """All templates as states of one automaton over words.

    A state waits for one word, or for any (None); after it, the states of `follow` are live. A negative number -1 - k
    says that template k is accepted.
    """

    def __init__(self, templates: list[tuple[str, list]]):
        self.labels = [label for label, _ in templates]
        self.scores = [shortest(parts) / (shortest(parts) + HALF) for _, parts in templates]
        self.waits: list[bytes | None] = []
        self.follow: list[tuple[int, ...]] = []
        self.begin: dict[bytes, list[int]] = {}
        cues = set()
        for k, (label, parts) in enumerate(templates):
            if not mandatory(parts):
                raise ValueError(f"a wording of {label} has no mandatory word")
            cues.add(max(mandatory(parts), key=len).encode())
            for q in self._before(parts, frozenset({-1 - k})):
                if q < 0 or self.waits[q] is None:
                    raise ValueError(f"a wording of {label} doesn't begin with a word")
                self.begin.setdefault(self.waits[q], []).extend(self.follow[q])
        self.cue = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:%s)(?![0-9a-z\x80-\xff])" % b"|".join(sorted(cues)), re.IGNORECASE)

    def _state(self, word: bytes | None, after: frozenset[int]) -> int:
        self.waits.append(word)
        self.follow.append(tuple(sorted(after)))
        return len(self.waits) - 1

    def _before(self, parts: list, after: frozenset[int]) -> frozenset[int]:
        """States that are live before parts, if those of `after` are live behind them; made from the end on."""
        for p in reversed(parts):
            if isinstance(p, str):
                after = frozenset({self._state(p.encode(), after)})
            elif p[0] == "gap":
                for k in range(p[2], 0, -1):
                    one = frozenset({self._state(None, after if k == p[2] else step)})
                    step = one | (after if k - 1 >= p[1] else frozenset())
                after = step
            else:
                inner = frozenset().union(*(self._before(choice, after) for choice in p[1]))
                after = inner | after if p[0] == "optional" else inner
        return after

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, last word) of every accepted end, with the smallest first word for it."""
        live: dict[int, int] = {}
        waits, follow, begin = self.waits, self.follow, self.begin
        for at, word in enumerate(words):
            if not live and word not in begin:
                continue
            after: dict[int, int] = {}
            for q, start in live.items():
                if q >= 0 and (waits[q] is None or waits[q] == word):
                    for r in follow[q]:
                        if after.get(r, at) >= start:
                            after[r] = start
            for r in begin.get(word, ()):
                after.setdefault(r, at)
            for r, start in after.items():
                if r < 0:
                    yield -1 - r, start, at
            live = after


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes whose words are counted at once.
SLICE = 1 << 20


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text data[offsets[i]:offsets[i + 1]]."""
    total, base = np.zeros(len(offsets), np.int64), 0
    for low in range(int(offsets[0]) if len(offsets) else 0, int(offsets[-1]) if len(offsets) else 0, SLICE):
        high = min(low + SLICE, int(offsets[-1]))
        solid = _IS_WORD[data[low:high]]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        if low and _IS_WORD[data[low - 1]]:
            first[0] = False
        a, b = np.searchsorted(offsets, [low, high])
        cuts = offsets[a:b] - low
        first[cuts] = solid[cuts]
        # words before each bound that lies in this slice
        sums = np.concatenate([[0], np.cumsum(first)])
        total[a:b] = base + sums[cuts]
        base += int(sums[-1])
        total[b:] = base
    return np.diff(total)


def find_licenses(docs: DataFrame, doc: str = "doc_id", text: str = "text", phrases: str = PHRASES, templates: str = TEMPLATES) -> DataFrame:
    """doc, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:first:last word of every accepted place, by place)."""
    base, all_templates = listed(phrases), listed(phrases) + listed(templates)
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = TemplateAutomaton(all_templates)
        words_of = re.compile(WORD)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
            whole = texts.buffers()[2] or pa.py_buffer(b"")
            counts, rows = word_counts(np.frombuffer(whole, np.uint8), offsets), []
            for k in range(len(texts)):
                a, b = int(offsets[k]), int(offsets[k + 1])
                found = []
                if machine.cue.search(whole, a, b):
                    found = sorted(machine.places(words_of.findall(bytes(whole[a:b]).lower())), key=lambda p: (p[1], p[2], p[0]))
                starts = [p[1] for p in found if p[0] < len(base)]
                told = lambda some: ",".join(sorted({machine.labels[p[0]] for p in some}))
                rows.append((
                    len(starts), min(starts, default=None), max(starts, default=None), told(p for p in found if p[0] < len(base)), told(found),
                    max((machine.scores[p[0]] for p in found), default=0.0), ",".join(f"{machine.labels[p[0]]}:{p[1]}:{p[2]}" for p in found),
                ))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *made], [doc, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, f"`{doc}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """Wordings as regular expressions over the words joined by spaces; the template files' text decides both, the automaton has no part here."""
    rows = [(k < len(listed(PHRASES)), label, " " + as_regex(parts), shortest(parts)) for k, (label, parts) in enumerate(listed(PHRASES) + listed(TEMPLATES))]
    known = ", ".join(f"({str(b).lower()}, '{label}', '{regex}', {n})" for b, label, regex, n in rows)
    phrases = ", ".join(f"('{label}', '{' '.join(parts)}', {len(parts)})" for label, parts in listed(PHRASES))
    return rf"""
WITH w AS (SELECT row_number() OVER () AS doc_row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) AS t(label, phrase, n)),
b AS (SELECT doc_row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM (SELECT doc_row, ws, unnest(range(len(ws))) AS place FROM w) x JOIN p ON array_to_string(ws[place + 1:place + n], ' ') = phrase GROUP BY doc_row),
t AS (SELECT * FROM (VALUES {known}) AS t(base, label, regex, n)),
l AS (SELECT doc_row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(n / (n + {HALF}.0)::DOUBLE) AS score FROM w JOIN t ON regexp_matches(' ' || array_to_string(ws, ' ') || ' ', regex) GROUP BY doc_row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_row = w.doc_row LEFT JOIN l ON l.doc_row = w.doc_row
"""


OP13_SQL = _sql()
