"""License scans by templates: markup compiled to token automata.

A template is wording with regions in markup:

    <<optional>> ... <</optional>>   words that may be missing
    <<any:N>>                        up to N words of the writer's own, such as a holder's name
    <<one:a b|c>>                    one of several wordings

Everything else is mandatory: a text is accepted where its words, compared one by one, run through
the whole automaton. Regions may be nested. All templates run as one automaton, and of each label the
longest run from a start counts. Runs are only tried at words, or pairs of words, with which a template
can begin; those are found for many texts at once by hashes.

Null texts count as empty; repeated rows give repeated results; extra columns are ignored. An empty
text has no words, no spans and score 0. Spans of several labels may begin at the same word; they are
in the order of their start, then of the templates. A text of any length is scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigrain.llm import textvec
from verdigrain.llm.shared import buffers, slices
from verdigrain.session import on_workers

# The phrases that always count, and the label of each.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_LICENSED = "<<one:licensed|released|distributed|available|provided>> under"
_VERSIONED = "<<optional>>the<</optional>> <<optional>>terms of the<</optional>>"
_COPYRIGHT = "copyright <<any:16>>"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_NOTICE = "the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_TWO = "<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THREE = "<<optional>>3<</optional>> neither the name of <<any:16>> nor the names of <<one:its|any|other>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GPL_HEADER = "this <<one:program|library|file>> is free software you can redistribute it and or modify it under the terms of the GNU {0} public license as published by the free software foundation either version <<one:2|2.1|3>> of the license or at your option any later version"

# Identifiers of the SPDX list that have a template of their own, and the kinds of Creative Commons licenses.
SPDX = ("MIT", "MIT-0", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "0BSD", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
CREATIVE_COMMONS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}

# Wording of public licenses and notices, with its optional and replaceable regions.
TEMPLATES = {
    "mit-notice": f"{_LICENSED} {_VERSIONED} MIT license",
    "apache-2.0": f"{_LICENSED} {_VERSIONED} Apache license version 2.0 <<optional>>the license you may not use this file except in compliance with the license<</optional>>",
    "apache-2.0-header": f"{_COPYRIGHT} licensed under the Apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3.0": f"{_LICENSED} {_VERSIONED} GNU general public license version 3 <<optional>>or any later version<</optional>>",
    "gpl-2.0": f"{_LICENSED} {_VERSIONED} GNU general public license version 2 <<optional>>or any later version<</optional>>",
    "gpl-header": _GPL_HEADER.format("general"),
    "lgpl-header": _GPL_HEADER.format("<<one:lesser|library>> general"),
    "agpl-header": _GPL_HEADER.format("affero general"),
    "lgpl": "GNU lesser general public license <<optional>>version <<one:2|2.1|3>><</optional>>",
    "mpl-2.0": "this source code form is subject to the terms of the Mozilla public license v 2.0 <<optional>>if a copy of the MPL was not distributed with this file you can obtain one at <<any:8>><</optional>>",
    "mit-text": _MIT,
    "mit": f"{_COPYRIGHT} {_MIT} {_MIT_NOTICE}",
    "isc-text": "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": _BSD,
    "bsd-2-clause": f"{_COPYRIGHT} {_BSD} {_BSD_TWO}",
    "bsd-3-clause": f"{_COPYRIGHT} {_BSD} {_BSD_TWO} {_BSD_THREE}",
    "unlicense": "this is free and unencumbered software released into the public domain <<optional>>anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means<</optional>>",
    "cc0-1.0": "<<one:cc0 1.0 universal|creative commons zero v1.0 universal>>",
    **{
        f"cc-{kind}": f"{_LICENSED} <<optional>><<one:a|the>><</optional>> <<one:cc {kind}|creative commons {wording}>> <<one:1.0|2.0|2.5|3.0|4.0>> <<optional>><<one:international|unported|generic>><</optional>> <<optional>>public<</optional>> <<optional>>license<</optional>>"
        for kind, wording in CREATIVE_COMMONS.items()
    },
    **{f"spdx-{name}": f"spdx license identifier {name}" for name in SPDX},
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(/?[a-z]+)(?::([^>]*))?>>")
_ANY = b""


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@dataclass(frozen=True)
class Automaton:
    """steps: by state, a word and the states that it leads to; the empty word stands for any word.

    ends: by accepting state, its label, number of mandatory words and place among the templates. first: by
    first word, states.
    """

    steps: tuple[dict[bytes, tuple[int, ...]], ...]
    ends: dict[int, tuple[str, int, int]]
    first: dict[bytes, tuple[int, ...]]

    def beginnings(self) -> tuple[set[bytes], set[tuple[bytes, bytes]]]:
        """Words that a run may begin with whatever follows, and pairs of words that it may begin with."""
        alone, pairs = set(), set()
        for word, to in self.first.items():
            for state in to:
                if state in self.ends or _ANY in self.steps[state]:
                    alone.add(word)
                pairs |= {(word, after) for after in self.steps[state] if after}
        return alone, {(a, b) for a, b in pairs if a not in alone}


class Gate:
    """Where runs of some automata may begin, among the words of many texts."""

    def __init__(self, automata: Iterable[Automaton]) -> None:
        alone, pairs = map(set, ((), ()))
        for one, two in (a.beginnings() for a in automata):
            alone |= one
            pairs |= two
        self.alone = self._hashes(sorted(alone))
        self.pairs = self._paired(self._hashes([a for a, _ in sorted(pairs)]), self._hashes([b for _, b in sorted(pairs)]))

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        stops = np.cumsum([len(w) for w in words], dtype=np.int64)
        return textvec.span_hashes(np.frombuffer(b"".join(words), np.uint8), stops - [len(w) for w in words], stops)

    @staticmethod
    def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return textvec.mixed(a * np.uint64(0x2545F4914F6CDD1D) + b)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words at which a run may begin; a few others may be among them, as hashes can be equal."""
        good = np.isin(hashes, self.alone)
        good[:-1] |= np.isin(self._paired(hashes[:-1], hashes[1:]), self.pairs)
        return np.flatnonzero(good)


def compiled(templates: Iterable[tuple[str, str]]) -> Automaton:
    """One automaton for all (label, markup)."""
    jumps: list[set[int]] = []
    moves: list[dict[bytes, set[int]]] = []

    def state() -> int:
        jumps.append(set())
        moves.append({})
        return len(moves) - 1

    def literal(at: int, words: list[bytes]) -> int:
        for word in words:
            to = state()
            moves[at].setdefault(word, set()).add(to)
            at = to
        return at

    start, accepted = state(), {}
    for number, (label, markup) in enumerate(templates):
        begin = at = state()
        jumps[start].add(begin)
        opened: list[int] = []
        mandatory: list[bytes] = []
        where = 0
        for mark in [*_MARK.finditer(markup), None]:
            words = words_of(markup[where : mark.start() if mark else len(markup)])
            if not opened:
                mandatory += words
            at = literal(at, words)
            if mark is None:
                break
            where, (name, value) = mark.end(), mark.groups()
            if name == "optional":
                opened.append(at)
            elif name == "/optional":
                if not opened:
                    raise ValueError(f"{label}: an optional region ends that didn't begin")
                to = state()
                jumps[at].add(to)
                jumps[opened.pop()].add(to)
                at = to
            elif name == "any":
                to = state()
                jumps[at].add(to)
                for _ in range(int(value)):
                    after = state()
                    moves[at].setdefault(_ANY, set()).add(after)
                    jumps[after].add(to)
                    at = after
                at = to
            elif name == "one":
                to = state()
                for wording in value.split("|"):
                    jumps[literal(at, words_of(wording))].add(to)
                at = to
            else:
                raise ValueError(f"{label}: unknown region {name}")
        if opened:
            raise ValueError(f"{label}: an optional region doesn't end")
        if not mandatory and "<<one:" not in markup:
            raise ValueError(f"{label}: nothing in the template is mandatory")
        accepted[at] = (label, len(mandatory), number)

    def closure(states: Iterable[int]) -> set[int]:
        found, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in found:
                found.add(s)
                todo += jumps[s]
        return found

    closed = [closure({s}) for s in range(len(moves))]
    steps = tuple({w: tuple(sorted({c for t in to for c in closed[t]})) for w, to in move.items()} for move in moves)
    first: dict[bytes, set[int]] = {}
    for s in closed[start]:
        for word, to in steps[s].items():
            first.setdefault(word, set()).update(to)
    return Automaton(steps, accepted, {w: tuple(sorted(to)) for w, to in first.items()})


def spans(automaton: Automaton, words: list[bytes], at: Iterable[int] | None = None) -> list[tuple[int, int, str, int]]:
    """(first word, end, label, mandatory words) of each label's longest run from each start, or from those of `at`."""
    found = []
    for i in range(len(words)) if at is None else at:
        states = automaton.first.get(words[i])
        if states is None:
            continue
        longest: dict[int, tuple[int, str, int]] = {}
        j = i + 1
        while True:
            for s in states:
                if s in automaton.ends:
                    label, size, number = automaton.ends[s]
                    longest[number] = (j, label, size)
            if j >= len(words):
                break
            after: set[int] = set()
            for s in states:
                step = automaton.steps[s]
                after.update(step.get(words[j], ()), step.get(_ANY, ()))
            if not after:
                break
            states, j = after, j + 1
        found += [(i, end, label, size) for _, (end, label, size) in sorted(longest.items())]
    return found


def scan_licenses(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """License spans of every text: id, n_words, base_spans, spans (arrays of first, end, label), score.

    The score is 1 - 1/(1+m) with m the mandatory words of the longest wording that was accepted.
    """
    on_workers(df.sparkSession)
    phrases = BASE_PHRASES if phrases is None else phrases
    base = compiled([(label, phrase) for phrase, label in phrases.items()])
    more = compiled((TEMPLATES if templates is None else templates).items())
    gate = Gate((base, more))
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    kind = pa.schema([("n_words", pa.int64()), ("base_spans", pa.list_(span)), ("spans", pa.list_(span)), ("score", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            counts, own, added, scores = [], [], [], []
            for i, j in slices(offsets):
                low = textvec.lowered(data[offsets[i] : offsets[j]])
                starts, ends, first = textvec.words(low, offsets[i : j + 1] - offsets[i])
                counts.append(np.diff(first))
                places = gate.places(textvec.span_hashes(low, starts, ends))
                cuts = np.searchsorted(places, first)
                whole = low.tobytes()
                for k in range(j - i):
                    at = (places[cuts[k] : cuts[k + 1]] - first[k]).tolist()
                    words = [whole[a:b] for a, b in zip(starts[first[k] : first[k + 1]].tolist(), ends[first[k] : first[k + 1]].tolist(), strict=True)] if at else []
                    one, two = spans(base, words, at), spans(more, words, at)
                    own.append([{"first": a, "end": b, "label": c} for a, b, c, _ in one])
                    added.append([{"first": a, "end": b, "label": c} for a, b, c, _ in two])
                    scores.append(1 - 1 / (1 + max([0, *(x[3] for x in (*one, *two))])))
            n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(own, kind.field(1).type), pa.array(added, kind.field(2).type), pa.array(scores, pa.float64())], names=[id_column, *kind.names])

    id_type = dict(df.dtypes)[id_column]
    spans_type = "array<struct<first:bigint,end:bigint,label:string>>"
    return df.select(id_column, text_column).mapInArrow(scanned, f"`{id_column}` {id_type}, n_words bigint, base_spans {spans_type}, spans {spans_type}, score double")
