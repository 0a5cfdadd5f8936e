"""Licence scan by template markup: texts are matched by token automata compiled from marked-up wording.

A template is wording with two kinds of regions. ``[[ .. ]]`` is optional and may nest; ``<<name:lo..hi>>`` is
replaceable by lo to hi words of any kind, ``<<name:lo..hi:digits>>`` only by words of digits. Everything else is
mandatory and must stand word for word. Templates become one automaton over words, which is made deterministic as
texts ask for it; it is entered at every word a template can begin with and left at the longest accepted end. The
phrases of the base are templates without regions and run through the same automaton.

Words are the contract's: maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
Texts are read in pieces that end between words, keeping as many words as the longest template spans, so memory
does not grow with a text's length; time grows with its words. Tasks read rows as they lie: no shuffle.

Defined cases: a null text counts as empty and has no words, places or labels, score 0. A null doc_id is returned
as it is, repeated rows each. Of overlapping matches of one template the leftmost longest counts (base phrases
count at every place). An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases of the base with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licences and of their usual notices, with the regions that may vary.
WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
<<holders:1..8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
arising from out of or in connection with the software or the use or other dealings in the software"""
BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution"""
BSD_THIRD = """[[3]] neither the name of <<holder:1..20>> nor the names of [[its]] [[the]] contributors may be used to endorse or
promote products derived from this software without specific prior written permission"""
BSD_END = """this software is provided by <<holder:1..20>> as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
PUBLISHED = "[[as published by the free software foundation]]"
LATER = "[[of the license]] [[or [[at your option]] any later version]]"
TEMPLATES = [
    ("mit", f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use
copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
[[including the next paragraph]] shall be included in all copies or substantial portions of the software {WARRANTY}"""),
    ("isc", """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", f"{BSD_START} {BSD_END}"),
    ("bsd-3-clause", f"{BSD_START} {BSD_THIRD} {BSD_END}"),
    ("apache-2.0", "[[licensed under the]] apache license [[january 2004]] version 2 0 [[january 2004]] [[the license]]"),
    ("gpl-2.0", f"[[under the terms of the]] gnu general public license [[gpl]] {PUBLISHED} [[either]] version 2 {LATER}"),
    ("gpl-3.0", f"[[under the terms of the]] gnu general public license [[gpl]] {PUBLISHED} [[either]] version 3 {LATER}"),
    ("lgpl-2.1", f"[[under the terms of the]] gnu lesser general public license {PUBLISHED} [[either]] version 2 1 {LATER}"),
    ("lgpl-3.0", f"[[under the terms of the]] gnu lesser general public license {PUBLISHED} [[either]] version 3 {LATER}"),
    ("agpl-3.0", f"[[under the terms of the]] gnu affero general public license {PUBLISHED} [[either]] version 3 {LATER}"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("cc0-1.0", "[[creative commons]] cc0 1 0 [[universal]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "[[released]] [[licensed]] under the [[terms of the]] [[<<name:1..2>>]] mit license"),
] + [
    (f"cc-by{short.replace(' ', '-')}-{version}.0", text.format(version=version))
    for version in (3, 4)
    for short, long in [
        ("", ""), (" sa", " sharealike"), (" nc", " noncommercial"), (" nd", " noderivatives"),
        (" nc sa", " noncommercial sharealike"), (" nc nd", " noncommercial noderivatives"),
    ]
    for text in (
        f"[[licensed under]] cc by{short} {{version}} 0",
        f"creative commons attribution{long} {{version}} 0 [[international]] [[unported]] [[license]]",
    )
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
MARKS = re.compile(r"\[\[|\]\]|<<(\w+):(\d+)\.\.(\d+)(:digits)?>>|[^\s\[\]<>]+")
PIECE = 1 << 20
# Transitions kept of the automaton; beyond, it is built anew, with the same results.
KNOWN = 200_000
ANY, DIGITS = "any", "digits"


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@dataclass(frozen=True)
class Found:
    """Template ``label`` at the words from ``start`` up to ``stop``."""

    label: str
    base: bool
    start: int
    stop: int
    mandatory: int


class Automaton:
    """Token automaton of (label, markup, is a phrase of the base) templates."""

    def __init__(self, templates: list[tuple[str, str, bool]]):
        self.free: list[list[int]] = []  # moves without a word
        self.by_word: list[tuple[bytes | str, int] | None] = []  # the one move that takes a word
        self.accepts: dict[int, int] = {}
        self.rules: list[tuple[str, bool, int]] = []
        self.reach = 0
        starts = []
        for label, markup, base in templates:
            first = self._state()
            last, mandatory, most = self._compile(markup, first)
            if not mandatory:
                raise ValueError(f"template of {label} has no mandatory wording")
            if {ANY, DIGITS} & {self.by_word[s][0] for s in self._closure([first]) if self.by_word[s]}:
                raise ValueError(f"template of {label} begins with a replaceable region")
            self.accepts[last] = len(self.rules)
            self.rules.append((label, base, mandatory))
            self.reach = max(self.reach, most)
            starts.append(first)
        self.first = self._closure(starts)
        self.openers = frozenset(self.by_word[s][0] for s in self.first if self.by_word[s])
        self._forget()

    def _state(self) -> int:
        self.free.append([])
        self.by_word.append(None)
        return len(self.free) - 1

    def _compile(self, markup: str, at: int) -> tuple[int, int, int]:
        """Adds the states of a template; returns the last one, its mandatory words and its longest span."""
        opened, mandatory, most, end = [], 0, 0, 0
        for mark in MARKS.finditer(markup):
            if markup[end : mark.start()].strip():
                raise ValueError(f"unknown markup: {markup[end : mark.start()]}")
            end = mark.end()
            if mark[0] == "[[":
                opened.append(at)
            elif mark[0] == "]]":
                if not opened:
                    raise ValueError("an optional region ends that did not begin")
                to = self._state()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            elif mark[1]:
                low, high = int(mark[2]), int(mark[3])
                if low > high:
                    raise ValueError(f"replaceable region of {low} to {high} words")
                after = self._state()
                for i in range(high):
                    if i >= low:
                        self.free[at].append(after)
                    at = self._word(at, DIGITS if mark[4] else ANY)
                self.free[at].append(after)
                at, most = after, most + high
            else:
                for word in words_of(mark[0]):
                    at = self._word(at, word)
                    mandatory += not opened
                    most += 1
        if opened or markup[end:].strip():
            raise ValueError("an optional region does not end" if opened else f"unknown markup: {markup[end:]}")
        return at, mandatory, most

    def _word(self, at: int, word: bytes | str) -> int:
        middle, to = self._state(), self._state()
        self.free[at].append(middle)
        self.by_word[middle] = (word, to)
        return to

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def _forget(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.index: dict[frozenset[int], int] = {}
        self.moves: list[dict[bytes, int]] = []
        self.ends: list[tuple[int, ...]] = []
        self.vocabulary: list[frozenset[bytes]] = []
        self.known = 0
        self._number(self.first)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.index:
            self.index[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.ends.append(tuple(sorted(self.accepts[s] for s in states if s in self.accepts)))
            self.vocabulary.append(frozenset(self.by_word[s][0] for s in states if self.by_word[s]))
        return self.index[states]

    def _move(self, state: int, word: bytes) -> int:
        """Number of the state after ``word``, -1 if none; words no template names there share two entries."""
        named = self.vocabulary[state]
        key = word if word in named else (b"0" if word.isdigit() else b"") if ANY in named or DIGITS in named else None
        if key is None:
            return -1
        if key not in self.moves[state]:
            takes = {word, ANY} | ({DIGITS} if word.isdigit() else set())
            after = self._closure({self.by_word[s][1] for s in self.sets[state] if self.by_word[s] and self.by_word[s][0] in takes})
            self.moves[state][key] = self._number(after) if after else -1
            self.known += 1
        return self.moves[state][key]

    def longest(self, words: list[bytes], start: int) -> dict[int, int]:
        """For each template accepted from ``start``: its longest end."""
        if self.known > KNOWN:
            self._forget()
        state, at, ends = 0, start, {}
        while at < len(words):
            state = self._move(state, words[at])
            if state < 0:
                break
            at += 1
            for rule in self.ends[state]:
                ends[rule] = at
        return ends

    def scan(self, text: bytes, piece: int = PIECE) -> tuple[int, list[Found]]:
        """Number of words and all matches in a text of any length."""
        found, taken, done, held, at = [], {}, 0, [], 0
        while True:
            cut = len(text)
            if at + piece < len(text):
                gap = GAP.search(text, at + piece)
                cut = gap.start() if gap else len(text)
            held += WORD.findall(text[at:cut].lower())
            at = cut
            last = at >= len(text)
            ready = len(held) if last else max(0, len(held) - self.reach)
            openers = self.openers
            for start in [i for i, word in enumerate(held[:ready]) if word in openers]:
                for rule, stop in self.longest(held, start).items():
                    label, base, mandatory = self.rules[rule]
                    if base or done + start >= taken.get(rule, 0):
                        taken[rule] = done + stop
                        found.append(Found(label, base, done + start, done + stop, mandatory))
            done, held = done + ready, held[ready:]
            if last:
                return done, found


@lru_cache(maxsize=4)
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    """Automaton of the base phrases and of (label, markup) templates."""
    return Automaton([(label, phrase, True) for phrase, label in PHRASES.items()] + [(*t, False) for t in templates])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, piece: int = PIECE) -> DataFrame:
    """Licence statements of every whole text.

    Columns: doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and largest start
    of these), base_labels, labels (with those of accepted templates; both distinct, sorted, comma-joined), score
    (1 - 1/(1 + m) for the largest number m of mandatory words of an accepted template or phrase, 0 if none), and
    spans, an array of (label, start, stop) in words, base phrases included, by start.
    """
    chosen = tuple(TEMPLATES if templates is None else templates)
    automaton(chosen)  # broken markup fails here and not in a task
    doc_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = (
        f"doc_id {doc_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start:long,stop:long>>"
    )
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def row(text: bytes) -> tuple:
        n, found = automaton(chosen).scan(text, piece)
        starts = [f.start for f in found if f.base]
        return (
            n,
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted({f.label for f in found if f.base})),
            ",".join(sorted({f.label for f in found})),
            1 - 1 / (1 + max((f.mandatory for f in found), default=0)),
            [{"label": f.label, "start": f.start, "stop": f.stop} for f in sorted(found, key=lambda f: (f.start, f.stop, f.label))],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(text.as_py() or b"") for text in batch.column("text").cast(pa.binary())]
            columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(work, schema)
