"""Licence scans: fixed phrases, and templates with optional and replaceable regions compiled to token automata.

A template is text with `<<optional>>...<<end>>` (may be absent, may nest) and `<<any MIN-MAX>>` (so many arbitrary words). It becomes an
automaton over words: a text matches where all wording outside these regions stands exactly, word for word. Words are as in the
scan: A-Z lower-cased, runs of 0-9, a-z and everything beyond ASCII. An automaton starts where one of its first words stands and
its longest mandatory run is somewhere in the text; from each start the longest match counts, and the next one begins after it.

Defined results: null and empty texts have no words, no labels, and score 0; first_word and last_word are null without base places. The score
is the share of words that lie in a match of a phrase or template. Labels are distinct and sorted. Whole texts are scanned; a row's result depends on
that row alone, repeated rows included. Other columns are kept; one that has the name of an output is replaced.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases of the base scan and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>>
shall be included in all copies or substantial portions of the Software. <<optional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 1-40>> BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.<<end>>"""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

#: Public licence wordings by label; more can be passed to scan().
TEMPLATES = (
    ("mit", _GRANT_MIT),
    ("mit", "<<optional>>released<<end>><<optional>>licensed<<end>><<optional>>distributed<<end>> under the <<optional>>terms of the<<end>> MIT License"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", _BSD_HEAD),
    ("bsd-3-clause", _BSD_HEAD + """ <<optional>>3.<<end>> Neither the name of <<any 1-40>> nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 <<optional>>(the \"License\"); you may not use this file except in compliance with the License<<end>>"),
    ("gpl-2.0", "<<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 2"),
    ("gpl-3.0", "<<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("cc-by-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution 4.0 International License"),
    ("copyright", "Copyright <<optional>>c<<end>> <<optional>>©<<end>> <<any 1-40>> All rights reserved"),
)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KIND = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
])
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """A template's states: 0 is the start, each has word edges and, for arbitrary words, an edge for any."""

    def __init__(self, template: str):
        self.edges: list[dict[bytes | None, set[int]]] = [{}]
        self.skips: list[set[int]] = [set()]
        runs: list[list[bytes]] = [[]]
        at, opened = 0, []
        for part in re.split(r"(<<[^<>]*>>)", template):
            if part == "<<optional>>":
                opened.append(at)
                at = self._skip(at)
                runs.append([])
            elif part == "<<end>>":
                end = self._skip(at)
                self.skips[opened.pop()].add(end)
                at = end
                runs.append([])
            elif m := re.fullmatch(r"<<any (\d+)-(\d+)>>", part):
                low, high = int(m[1]), int(m[2])
                ends = []
                for k in range(high):
                    if k >= low:
                        ends.append(at)
                    at = self._step(at, None)
                end = self._skip(at)
                for x in ends:
                    self.skips[x].add(end)
                at = end
                runs.append([])
            elif part.startswith("<<"):
                raise ValueError(f"unknown markup {part}")
            else:
                for w in words(part):
                    at = self._step(at, w)
                    if not opened:
                        runs[-1].append(w)
        if opened:
            raise ValueError("an optional region has no end")
        self.last = at
        self.key = b" " + b" ".join(max(runs, key=len)) + b" "
        if self.key == b"  ":
            raise ValueError("a template needs mandatory wording")
        self.first = self.closed({0})
        begins = {w for s in self.first for w in self.edges[s]}
        if None in begins or self.last in self.first:
            raise ValueError("a template must begin with a word")
        self.begins = begins

    def _new(self) -> int:
        self.edges.append({})
        self.skips.append(set())
        return len(self.edges) - 1

    def _step(self, at: int, word: bytes | None) -> int:
        new = self._new()
        self.edges[at].setdefault(word, set()).add(new)
        return new

    def _skip(self, at: int) -> int:
        new = self._new()
        self.skips[at].add(new)
        return new

    def closed(self, states: set[int]) -> frozenset[int]:
        """The states and all that are reached from them without a word."""
        out, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def longest(self, text: list[bytes], start: int) -> int:
        """The end of the longest match from start, or -1."""
        states, best = self.first, -1
        for k in range(start, len(text)):
            states = self.closed({s for x in states for w in (text[k], None) for s in self.edges[x].get(w, ())})
            if not states:
                break
            if self.last in states:
                best = k + 1
        return best


@cache
def automata(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def _places(flat: bytes, phrase: bytes) -> list[int]:
    """The words at which the phrase stands; flat and phrase have one space before, between and after words."""
    out, at, before, word = [], flat.find(phrase), 0, 0
    while at >= 0:
        word += flat.count(b" ", before, at)
        out.append(word)
        before, at = at, flat.find(phrase, at + 1)
    return out


def scan_text(text: str | None, phrases=PHRASES, templates=TEMPLATES) -> dict:
    own = words(text)
    flat = b" " + b" ".join(own) + b" "
    base, labels, matches = [], set(), []
    for phrase, label in phrases:
        if places := _places(flat, f" {phrase} ".encode()):
            labels.add(label)
            base += places
            matches += [(label, p, p + phrase.count(" ") + 1) for p in places]
    more = set(labels)
    for label, a in automata(templates):
        if a.key not in flat:
            continue
        starts = sorted({p for w in a.begins for p in _places(flat, b" " + w + b" ")})
        until = 0
        for s in starts:
            if s >= until and (end := a.longest(own, s)) > 0:
                matches.append((label, s, end))
                more.add(label)
                until = end
    covered = until = 0
    for _, s, e in sorted(matches, key=lambda m: m[1:]):
        covered += max(0, e - max(s, until))
        until = max(until, e)
    return {
        "n_words": len(own), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None), "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(more)),
        "score": covered / len(own) if own else 0.0, "matches": [dict(zip(("label", "start", "end"), m, strict=True)) for m in sorted(matches, key=lambda m: (m[1], m[2], m[0]))],
    }


def scan(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (label, start, end in words)."""
    common.batches(docs.sparkSession)

    @F.arrow_udf(SCHEMA)
    def udf(t: pa.Array) -> pa.Array:
        return pa.array([scan_text(x, PHRASES, templates) for x in t.to_pylist()], KIND)

    return common.widened(docs, udf(F.col(text).cast("string")), KIND.names)
